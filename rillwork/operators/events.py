"""Events and the item properties valid at their time."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_MS = 86_400_000
NATURAL_KEY = ["timestamp", "visitorid", "event", "itemid", "transactionid"]


def dedupe_events(events: DataFrame) -> DataFrame:
    """One row for each natural key; nulls are equal."""
    return events.dropDuplicates(NATURAL_KEY)


def in_window(df: DataFrame, column: str, since: date | None = None, until: date | None = None) -> DataFrame:
    """Rows from `since` to before `until`; on a partition column this prunes the scan."""
    if since is not None:
        df = df.where(F.col(column) >= F.lit(since))
    if until is not None:
        df = df.where(F.col(column) < F.lit(until))
    return df


def between(ms: Column, since: date | None = None, until: date | None = None) -> Column:
    """Whether a time in milliseconds is of the days from `since` to before `until`."""
    inside = F.lit(True)
    for bound, of in ((since, ms.__ge__), (until, ms.__lt__)):
        if bound is not None:
            inside = inside & of(F.lit((bound - date(1970, 1, 1)).days * DAY_MS))
    return inside


def known_between(properties: DataFrame, since: date | None = None, until: date | None = None) -> DataFrame:
    """What `point_in_time_category` needs of the properties for the events of these days.

    These are the days' snapshots and, of those before, each item's newest category, so that a window's time lines don't grow with the history.
    """
    found = properties.where("property = 'categoryid'")
    inside = found.where(between(F.col("timestamp"), since, until))
    if since is None:
        return inside
    before = categories(found).where(~between(F.col("timestamp"), since) & F.col("itemid").isNotNull() & F.col("categoryid").isNotNull())
    last = before.groupBy("itemid").agg(F.max_by(F.struct("timestamp", "value"), F.struct("timestamp", "categoryid")).alias("_last"))
    carried = last.select("_last.timestamp", "itemid", F.lit("categoryid").alias("property"), "_last.value")
    return inside.unionByName(carried)


def categories(properties: DataFrame) -> DataFrame:
    """(itemid, timestamp, categoryid) of the snapshots of an item's category; a value that isn't a number is null."""
    return properties.where(F.col("property") == "categoryid").select("itemid", "timestamp", F.col("value").try_cast("long").alias("categoryid"), "value")


def _carried(value: Column, window: Window) -> Column:
    return F.last(value, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))


def point_in_time_category(events: DataFrame, properties: DataFrame, bucket_ms: int | None = None) -> DataFrame:
    """events with categoryid: the item's newest category not later than the event, or null.

    Events and snapshots are put on one time line for each item; at equal times snapshots come first, in order of their
    categories as numbers. A snapshot without an item or a time is of no event.
    Time lines are cut into buckets of bucket_ms (None: a day): each is a window of its own that starts with the category
    carried in from the buckets before, so one busy item is spread over many tasks.
    """
    line = categories(properties).where("itemid IS NOT NULL AND timestamp IS NOT NULL").select("itemid", "timestamp", F.col("categoryid").alias("_known"), F.lit(0).alias("_is_event"))
    both = events.withColumn("_is_event", F.lit(1)).unionByName(line, allowMissingColumns=True)
    order = [F.col("timestamp"), F.col("_is_event"), F.col("_known")]
    both = both.withColumn("_bucket", F.floor(F.col("timestamp") / (bucket_ms or DAY_MS)))
    ends = both.groupBy("itemid", "_bucket").agg(F.max_by("_known", F.when(F.col("_known").isNotNull(), F.struct("timestamp", "_known"))).alias("_last"))
    earlier = Window.partitionBy("itemid").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.withColumn("_start", F.last("_last", ignorenulls=True).over(earlier)).select(F.col("itemid").alias("_item"), F.col("_bucket").alias("_at"), "_start")
    inside = both.withColumn("_inside", _carried(F.col("_known"), Window.partitionBy("itemid", "_bucket").orderBy(*order))).where("_is_event = 1")
    joined = inside.join(starts, (F.col("itemid") == F.col("_item")) & (F.col("_bucket") == F.col("_at")), "left")
    return joined.withColumn("categoryid", F.coalesce("_inside", "_start")).drop("_known", "_is_event", "_bucket", "_inside", "_item", "_at", "_start")


def newest(snapshots: DataFrame) -> DataFrame:
    """Of (itemid, timestamp, value, categoryid) each item's newest row, of equal times the one of the largest category, as a number."""
    last = F.max_by(F.struct("timestamp", "value", "categoryid"), F.struct("timestamp", "categoryid", "value"))
    return snapshots.groupBy("itemid").agg(last.alias("_last")).select("itemid", "_last.timestamp", "_last.value", "_last.categoryid")


def newest_snapshots(properties: DataFrame) -> DataFrame:
    return newest(categories(properties))


def latest_item_snapshot(properties: DataFrame) -> DataFrame:
    """(itemid, categoryid): each item's newest snapshot."""
    return newest_snapshots(properties).select("itemid", "categoryid")
