"""The corpus pipeline: stages over `documents`, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.functions.columns import named
from rillwork.functions.shared import cut
from rillwork.llm import line_dedup, mixing, sentencepiece_fst, simhash, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents with a score of 0.5 or more go.

    Defined cases: where the labels lack one of the two classes there is no model, and all documents stay; null and empty texts
    are scored as empty; null and repeated ids pass row by row; columns of any name are kept; an empty table stays empty.
    """
    model, prior = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if model is None:
        return docs
    scored = toxicity.score(docs.select(*[named(c).alias(f"c{k}") for k, c in enumerate(docs.columns)]), model, prior, text_col=_at(docs, "text"), keep=_all(docs), id_col=_at(docs, "doc_id"))
    return scored.where("score < 0.5").select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])


def _at(docs: DataFrame, name: str) -> str:
    return f"c{docs.columns.index(name)}"


def _all(docs: DataFrame) -> tuple[str, ...]:
    return tuple(f"c{k}" for k in range(len(docs.columns)))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: lines like earlier ones go; every document stays, with what is left of its text.

    Defined cases: those of line_dedup; n_chars is the length of what is left, null for a null text.
    """
    return line_dedup.line_dedup(docs).withColumn("n_chars", F.length("text").cast("long"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9, on shingles of five words, verified at a similarity of 0.8: one row of each group stays, that with the smallest id.

    Defined cases: rows are told apart by a number of their own, so rows that share an id stay or go each by its own text; ties
    go by a hash of the row. Rows with null ids are a group's copies among themselves: one of them stays besides the
    smallest id. Texts without words (null, empty, blank) are one group. Columns of any name are kept; an empty table stays
    empty.
    """
    kept = docs.select(*[named(c).alias(f"c{k}") for k, c in enumerate(docs.columns)])
    own = F.col(_at(docs, "doc_id"))
    whole = [F.isnull(own).alias("nameless"), own.alias("id"), F.xxhash64(*kept.columns).alias("hash"), F.monotonically_increasing_id().alias("number")]
    rows = cut(kept.withColumn("row", F.struct(*whole)).withColumn("number", F.col("row.number")), "zstd")  # written once, for numbers would change if read anew
    groups = simhash.similar_groups(rows, "number", _at(docs, "text")).join(rows.select("number", "row"), "number")
    stay = groups.groupBy("group", "row.nameless").agg(F.min("row").alias("row")).select(F.col("row.number").alias("number"))
    return rows.join(stay.hint("shuffle_hash"), "number", "left_semi").select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: small sources are read up to twice; the budget reads every document at least once.

    Defined cases: those of mixing.mix.
    """
    return mixing.mix(docs, repeats=2.0, whole=True)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: doc_id, n_tokens, ids, round_trip. Defined cases: those of sentencepiece_fst.encode."""
    return sentencepiece_fst.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("SentencePiece", encode),
]
#: SQL has neither the compressor nor the fingerprints nor the tokenizer: tested stage by stage.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, cut(docs, "zstd") if k else docs, sf_dir)
    return docs
