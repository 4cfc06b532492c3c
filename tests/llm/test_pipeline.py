"""Each stage on its own input, and the whole on a small table."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from rillwork.llm import registry, simhash

from .common import ODD, docs, prose
from .test_lines import brute
from .test_toxicity import corpus

SF = Path("/root/testdata/sf0.001")


def test_toxic_documents_go_and_clean_ones_stay(spark, tmp_path):
    texts, toxic = corpus(400, 8)
    spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    df = docs(spark, texts)
    out = pipeline.drop_toxic(spark, df, str(tmp_path))
    assert out.columns == df.columns
    left = {r["doc_id"] for r in out.collect()}
    assert sum(1 - t for i, t in enumerate(toxic) if i in left) >= 0.97 * (400 - sum(toxic))
    assert sum(t for i, t in enumerate(toxic) if i in left) <= 0.1 * sum(toxic)


def test_toxicity_keeps_columns_of_any_name_and_all_rows_without_both_classes(spark, tmp_path):
    texts, toxic = corpus(60, 8)
    df = docs(spark, texts).withColumn("score", F.lit(1)).withColumn("a.b", F.lit(2)).withColumn("c0", F.lit(3))
    for name, labels in (("both", toxic), ("one", [1] * 60)):
        spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        out = pipeline.drop_toxic(spark, df, f"{tmp_path}/{name}")
        assert out.columns == df.columns and out.where("score <> 1 OR `a.b` <> 2 OR c0 <> 3").count() == 0
        assert (out.count() == 60) == (name == "one")
    assert pipeline.drop_near_copies(spark, df, "").columns == df.columns


def test_lines_go_and_documents_stay(spark):
    texts = ["\n".join(prose(3, k % 5, 12)) for k in range(20)] + ODD
    rows = pipeline.drop_repeated_lines(spark, docs(spark, texts), "").collect()
    want = brute(texts)
    assert {r["doc_id"]: r["text"] for r in rows} == dict(enumerate(want))
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in rows)


def test_one_of_each_group_stays(spark):
    base = prose(10, 3, 100)
    texts = base + base + [base[0].upper()]
    out = pipeline.drop_near_copies(spark, docs(spark, texts, [*range(20), None]), "")
    assert sorted(str(r["doc_id"]) for r in out.collect()) == sorted(map(str, [*range(10), None]))
    groups = simhash.simhash_groups(docs(spark, base), words_each=5)
    assert groups.where("doc_id <> component_id").count() == 0


def jaccard(a, b):
    x, y = (set(simhash.shingles(t, 5).tolist()) for t in (a, b))
    return len(x & y) / len(x | y)


def edited(text, least, most, rng):
    """The text with some words changed, so that its similarity is between the two."""
    while True:
        words = text.split()
        for _ in range(rng.randint(1, max(1, len(words) // 20))):
            words[rng.randrange(len(words))] = f"new{rng.randrange(10**9)}"
        if least <= jaccard(text, " ".join(words)) < most:
            return " ".join(words)


def many(seed, n, words):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) for _ in range(words)) for _ in range(n)]


WORDS = [f"w{k}" for k in range(3000)]


def test_recall_of_edited_copies(spark):
    rng, rows, want = random.Random(1), [], {}
    for least, most in ((0.8, 0.83), (0.84, 0.87), (0.89, 0.93)):
        for t in many(rng.random(), 100, 130):
            rows += [t, edited(t, least, most, rng)]
    for t in many(9, 40, 150):  # clean ones: not similar enough
        rows += [t, edited(t, 0.6, 0.79, rng)]
    df = spark.createDataFrame(list(enumerate(rows)), "number long, text string").repartition(5)
    got = {r["number"]: r["group"] for r in simhash.similar_groups(df, "number", "text").collect()}
    for k in range(3):
        assert sum(got[2 * i] == got[2 * i + 1] for i in range(100 * k, 100 * k + 100)) >= 98
    assert all(got[i] == i for i in range(600, 680))


@pytest.mark.parametrize("run", [64, 1 << 16])
def test_a_large_group_of_edited_copies(spark, monkeypatch, run):
    monkeypatch.setattr(simhash, "RUN", run)
    rng, base = random.Random(2), many(3, 1, 120)[0]
    shared = many(4, 1, 40)[0]  # a passage that others share
    rows = [base, *(edited(base, 0.8, 0.95, rng) for _ in range(300)), *(f"{t} {shared}" for t in many(5, 300, 150)), *many(6, 100, 100)]
    df = spark.createDataFrame(list(enumerate(rows)), "number long, text string").repartition(5)
    got = {r["number"]: r["group"] for r in simhash.similar_groups(df, "number", "text").collect()}
    assert sum(got[k] == 0 for k in range(301)) >= 299 and all(got[k] == k for k in range(301, 701))


def test_copies_go_by_row_whatever_their_ids(spark):
    t = prose(8, 11, 100)
    rows = [(3, t[0]), (5, t[0]), (5, t[1]), (6, t[1]), (7, t[2]), (7, t[2]), (7, t[2]), (None, t[3]), (None, t[3]), (8, t[4]), (8, t[5])]
    out = pipeline.drop_near_copies(spark, docs(spark, [x for _, x in rows], [i for i, _ in rows]), "")
    want = [(3, t[0]), (5, t[1]), (7, t[2]), (None, t[3]), (8, t[4]), (8, t[5])]
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in out.collect()))) == sorted(map(str, want))


def test_mixing_holds_all(spark):
    df = docs(spark, prose(60), sources=["a"] * 50 + ["b"] * 10)
    out = pipeline.mix_sources(spark, df, "")
    assert out.select("doc_id").distinct().count() == 60 and out.count() > 65


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_the_whole(spark):
    out = pipeline.run(spark, str(SF))
    assert out.columns == ["doc_id", "n_tokens", "ids", "round_trip"]
    assert out.where("NOT round_trip").count() == 0 and 0 < out.count()
    assert out.agg(F.min("n_tokens")).first()[0] >= 0


def test_all_are_registered():
    names = [n for n in registry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(registry.queries()) | {"pipeline"} <= set(entry.queries())
    assert len(pipeline.STAGES) == 5
