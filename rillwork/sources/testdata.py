"""The clickstream model read from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.functions.columns import day_of, ms_of

_KINDS = {"view": "view", "click": "addtocart", "purchase": "transaction"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _item() -> F.Column:
    return F.get_json_object("props", "$.k").cast("long")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for kv in _KINDS.items() for x in kv])
    rows = table(spark, sf_dir, "events").where(F.col("event_type").isin(*_KINDS))
    out = rows.select(ms_of(F.col("ts")).alias("timestamp"), F.col("user_id").alias("visitorid"), kinds[F.col("event_type")].alias("event"), _item().alias("itemid"), F.when(F.col("event_type") == "purchase", F.col("event_id")).alias("transactionid"))
    return out.withColumn("event_date", day_of(F.col("timestamp")))


def item_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where(F.col("event_type").isin("signup", "error"))
    named = F.when(F.col("event_type") == "signup", F.lit("categoryid")).otherwise(F.lit("available"))
    value = F.when(F.col("event_type") == "signup", F.col("user_id") % 25).otherwise(F.col("user_id") % 2).cast("string")
    return rows.select(ms_of(F.col("ts")).alias("timestamp"), _item().alias("itemid"), named.alias("property"), value.alias("value"))


def category_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("categoryid"), (F.col("n_regionkey") + 100).cast("long").alias("parentid"))
    roots = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 100).cast("long").alias("categoryid"), F.lit(None).cast("long").alias("parentid"))
    return leaves.unionByName(roots)
