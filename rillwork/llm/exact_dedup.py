"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Each step looks only at what the step before left in groups of two or more:

1. a scan takes each text's normalised length and the hash of its first characters (a few bytes a row are kept);
2. lengths held by one row only end there; of the rest, (length, prefix hash) held by one row only end there;
3. a second scan hashes the full text of the surviving rows only, and equal hashes are equal texts.

The survivors of a step reach the next as a bit table of fixed size (see bits.py), so no text is ever shuffled, and the
groups are counted with map-side partial aggregation, so a group that holds a third of all rows is one row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.functions.columns import named
from rillwork.functions.shared import cut
from rillwork.llm import bits

PREFIX = 64


def normalised(text: Column) -> Column:
    """White space runs as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _repeated(keys: DataFrame, *by: str) -> DataFrame:
    return keys.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False) -> DataFrame:
    """One row per row of docs: `id_col`, keep_id, group_size, kept, text_sha256.

    Defined cases: a null text is an empty one, and all empty texts are one group. Of a group the smallest id stays
    (keep_id); rows that repeat this id too all stay kept=true, for nothing tells them apart. A null id never stays
    beside a non-null one; in a group of null ids only, keep_id is null and all are kept. Other columns are not read, so
    their names cannot clash. An empty table gives an empty result. text_sha256 is null for rows that never reached the
    full hash, unless digest_all asks for it.
    """
    norm = normalised(named(text_col))
    shape = {"n_len": F.length("norm"), "head": F.xxhash64(F.substring("norm", 1, PREFIX))}
    rows = docs.select(named(id_col).alias("id"), norm.alias("norm")).withColumns(shape)

    keys = cut(rows.select("n_len", "head"))
    by_len, by_head = F.xxhash64("n_len"), F.xxhash64("n_len", "head")
    same_len = bits.build(_repeated(keys, "n_len"), by_len)
    same_head = bits.build(_repeated(bits.mark(keys, same_len, by_len, "again").where("again"), "n_len", "head"), by_head)

    left = bits.mark(rows, cut(same_head), by_head, "alive")
    digest = F.sha2(F.encode("norm", "UTF-8"), 256)
    hashed = cut(left.select("id", "n_len", "alive", (digest if digest_all else F.when(F.col("alive"), digest)).alias("text_sha256")))

    groups = hashed.where("alive").groupBy("n_len", "text_sha256").agg(F.min("id").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = groups.select(F.concat_ws(":", "n_len", "text_sha256").alias("key"), "keep", "n")
    #: Rows that stand alone get a key of their own, so that they spread over the partitions.
    own = F.when(F.col("alive"), F.concat_ws(":", "n_len", "text_sha256")).otherwise(F.concat_ws("#", F.lit(""), "id", "n_len"))
    found = hashed.withColumn("key", own).join(groups, "key", "left")
    keep = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep"))
    return found.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest_all=True)


QUERIES = {"op3_exact_dedup": op3_exact_dedup}

ORACLE = {
    "op3_exact_dedup": r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256 FROM t"""
}
