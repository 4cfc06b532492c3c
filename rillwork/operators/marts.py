"""The gold tables."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwork.functions.columns import ratio, seconds_between, times

LOOKBACK_DAYS = 3


def with_load_time(df: DataFrame) -> DataFrame:
    return df.withColumn("_loaded_at", F.current_timestamp())


def fct_sessions(sessions: DataFrame) -> DataFrame:
    return sessions.select("session_id", "visitorid", "start_time", "end_time", seconds_between(F.col("start_time"), F.col("end_time")).alias("duration_seconds"), "event_count", "has_purchase")


def fct_funnel(events: DataFrame) -> DataFrame:
    """Views, carts and purchases of each category and day with both rates; events without a category don't count."""
    counts = events.where("categoryid IS NOT NULL").groupBy("categoryid", "event_date").agg(times("view").alias("views"), times("addtocart").alias("carts"), times("transaction").alias("purchases"))
    return counts.withColumns({"cart_rate": ratio(F.col("carts"), F.col("views")), "purchase_rate": ratio(F.col("purchases"), F.col("carts"))})


def funnel_tail(events: DataFrame, funnel: DataFrame | None, days: int = LOOKBACK_DAYS) -> DataFrame:
    """The funnel of the days to write again: from `days` before the target's last one on; all, if it is empty.

    The last day is looked up first, so the scan of the events is pruned by it.
    """
    last = funnel.agg(F.max("event_date").alias("d")).first()["d"] if funnel is not None else None
    return fct_funnel(events if last is None else events.where(F.col("event_date") >= F.lit(last - timedelta(days))))


def dim_categories(tree: DataFrame) -> DataFrame:
    return tree.select("categoryid", "parentid", F.col("parentid").isNull().alias("is_root"))


def dim_items(latest: DataFrame, tree: DataFrame) -> DataFrame:
    return latest.join(tree.select("categoryid", "parentid"), "categoryid", "left").select("itemid", "categoryid", "parentid")


def feature_table(events: DataFrame, latest: DataFrame) -> DataFrame:
    """Item counts beside the conversion of the item's latest category, counted by the categories at event time."""
    counts = {"views": times("view"), "carts": times("addtocart"), "purchases": times("transaction")}
    items = events.groupBy("itemid").agg(*[c.alias(n) for n, c in counts.items()])
    category = events.where("categoryid IS NOT NULL").groupBy("categoryid").agg(times("view").alias("cat_views"), times("transaction").alias("cat_purchases"))
    joined = items.join(latest, "itemid", "left").join(category, "categoryid", "left")
    return joined.select("itemid", "categoryid", "views", "carts", "purchases", F.col("views").alias("popularity"), ratio(F.col("purchases"), F.col("views")).alias("item_purchase_rate"), ratio(F.col("cat_purchases"), F.col("cat_views")).alias("category_purchase_rate"))


def feature_sessions(tagged: DataFrame, sessions: DataFrame) -> DataFrame:
    """What a session held besides purchases, and whether it was abandoned: items in a cart and no purchase."""
    browsed = tagged.where("event <> 'transaction'").groupBy("session_id").agg(F.count(F.lit(1)).alias("event_count"), times("view").alias("n_views"), times("addtocart").alias("n_carts"), F.count_distinct("itemid").alias("n_items"), F.count_distinct("categoryid").alias("n_categories"))
    joined = sessions.select("session_id", "visitorid", "start_time", "has_purchase").join(browsed, "session_id")
    return joined.select("session_id", "visitorid", "start_time", F.hour("start_time").alias("start_hour"), "event_count", "n_views", "n_carts", "n_items", "n_categories", ratio(F.col("n_views"), F.col("n_items")).alias("views_per_item"), "has_purchase", ((F.col("n_carts") > 0) & ~F.col("has_purchase")).alias("abandoned"))
