"""Columns of clashing names, repeated ids and empty tables, for each operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from rillwork.llm import exact_dedup, html_text, line_dedup, mixing, nearest, ranked_search, sentencepiece_fst, sharding, simhash, token_counts, url_filters, vector_codes

from .common import docs, prose

ODD_ID, ODD_TEXT = "the.id`x", "the text"
#: Names that the operators use inside.
CLASH = ["id", "src", "kid", "block", "part", "row", "number", "fp", "host", "th", "__src", "vslot"]


def odd(spark, texts, ids):
    df = docs(spark, texts, ids).withColumnsRenamed({"doc_id": ODD_ID, "text": ODD_TEXT})
    return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASH)])


BY_ROW = {
    "token_counts": token_counts.token_counts, "sentencepiece": sentencepiece_fst.encode, "exact": exact_dedup.exact_dedup, "lines": line_dedup.line_dedup, "sharding": lambda d, **k: sharding.shard(d, 3, **k)[0],
    "simhash": simhash.simhash_groups, "mixing": lambda d, **k: mixing.mix(d, repeats=1.0, whole=True, **k),
}


@pytest.mark.parametrize("name", sorted(BY_ROW))
def test_operators_on_documents(spark, name):
    texts, ids = [*prose(6, 4), None, "", *prose(1, 4)], [1, 1, 2, 3, None, None, 4, 4, 5]
    df = odd(spark, texts, ids)
    out = BY_ROW[name](df, id_col=ODD_ID, text_col=ODD_TEXT)
    assert sorted(str(r[0]) for r in out.select(F.col("`the.id``x`")).collect()) == sorted(map(str, ids))
    assert BY_ROW[name](df.limit(0), id_col=ODD_ID, text_col=ODD_TEXT).count() == 0


def test_operators_on_other_tables(spark):
    df = odd(spark, prose(4, 5), [7, 7, None, 8])
    found = ranked_search.search(df, df, 2, ODD_ID, ODD_TEXT, "kid", ODD_TEXT).collect()
    assert {r["rank"] for r in found} == {1, 2}
    pages = odd(spark, ["<p>a</p>", None, "", "<article>b"], [7, 7, None, 8]).withColumn("url", F.lit("http://x.com/a"))
    assert sorted(r["text"] for r in html_text.extract_pages(pages, ODD_ID, "url", ODD_TEXT).collect()) == ["", "", "a", "b"]
    assert url_filters.judge(pages, id_col=ODD_ID).count() == 4
    vectors = df.select(F.col("`the.id``x`"), F.array(*[F.col("number").cast("double")] * 4).alias("a.vec"), *CLASH, F.lit(1).alias("label"))
    assert vector_codes.encode(vectors, ODD_ID, "a.vec")[0].count() == 4
    assert {r["query_id"] for r in nearest.nearest(vectors, 7, 1, ODD_ID, "a.vec").collect()} == {7}


@pytest.mark.parametrize("stage", [f for _, f in pipeline.STAGES], ids=[n for n, _ in pipeline.STAGES])
def test_stages(spark, stage, tmp_path):
    spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    df = docs(spark, [*prose(6, 4), None, ""], [1, 1, 2, 3, None, None, 4, 4]).select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASH)])
    assert stage(spark, df.limit(0), str(tmp_path)).count() == 0
    out = stage(spark, df, str(tmp_path))
    assert out.count() > 0 and (stage is pipeline.STAGES[-1][1] or out.columns == df.columns)
