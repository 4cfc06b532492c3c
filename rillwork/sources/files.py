"""CSV and Parquet sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """One scan of one or more CSV files with a header; fields that don't parse are null."""
    return spark.read.csv(paths, schema=schema, header=True, mode="PERMISSIVE")


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def write(df: DataFrame, path: str, by: str | None = None, replace: str = "all") -> int:
    """Writes Parquet and returns the number of rows, observed on the way.

    replace: "all" replaces the table, "parts" only the partitions that df has rows for.
    """
    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite")
    if by:
        writer = writer.partitionBy(by)
    if replace == "parts":
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)
    return seen.get["n"]
