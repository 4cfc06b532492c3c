"""Parameterised reads of the gold tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def funnel_stats(funnel: DataFrame, category_id: int | None = None, first: date | None = None, last: date | None = None) -> DataFrame:
    """The funnel of a category and days, both ends included, in order of day and category."""
    for given, test in ((category_id, lambda v: F.col("categoryid") == v), (first, lambda v: F.col("event_date") >= F.lit(v)), (last, lambda v: F.col("event_date") <= F.lit(v))):
        if given is not None:
            funnel = funnel.where(test(given))
    return funnel.withColumnRenamed("categoryid", "category_id").orderBy("event_date", "category_id")


def funnel_by_category(funnel: DataFrame, n: int = 12) -> DataFrame:
    """Totals over the days of the n categories with most views."""
    totals = funnel.groupBy("categoryid").agg(*[F.sum(c).alias(c) for c in ("views", "carts", "purchases")])
    return totals.orderBy(F.desc("views"), "categoryid").limit(n)


def top_items(features: DataFrame, limit: int = 10, min_views: int = 20) -> DataFrame:
    if not 1 <= limit <= 100 or min_views < 1:
        raise ValueError("limit is 1 to 100, min_views at least 1")
    return features.where(F.col("views") >= min_views).orderBy(F.desc("item_purchase_rate"), F.desc("views"), "itemid").limit(limit)


def bought_with(pairs: DataFrame, item_id: int, n: int = 10) -> DataFrame:
    """What was bought in the same sessions as an item, most often first."""
    mine = pairs.where(((F.col("item_a") == item_id) | (F.col("item_b") == item_id)) & (F.col("pair_type") == "purchase"))
    other = F.when(F.col("item_a") == item_id, F.col("item_b")).otherwise(F.col("item_a"))
    found = mine.select(other.alias("rec_item_id"), F.col("weight").cast("double").alias("score"))
    order = Window.orderBy(F.desc("score"), "rec_item_id")  # over one item's pairs
    return found.withColumn("rank", F.row_number().over(order)).orderBy("rank").limit(n)


def recommend(stored: DataFrame, pairs: DataFrame, item_id: int, method: str = "als", n: int = 10) -> DataFrame:
    """Stored neighbours by rank; where there are none, what was bought with the item. `source` tells which."""
    if not 1 <= n <= 100:
        raise ValueError("n is 1 to 100")
    own = stored.where((F.col("item_id") == item_id) & (F.col("method") == method)).orderBy("rank").limit(n)
    own = own.select("rec_item_id", "score", "rank", "method", F.lit("model").alias("source"))
    other = bought_with(pairs, item_id, n).select("rec_item_id", "score", "rank", F.lit(None).cast("string").alias("method"), F.lit("cooccurrence").alias("source"))
    there = own.select(F.lit(True).alias("found")).limit(1)  # one row at most, known when the query runs
    return own.unionByName(other.join(F.broadcast(there), F.col("found"), "left_anti"))
