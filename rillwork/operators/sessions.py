"""Sessions: a visitor's events without a pause longer than the timeout."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillwork.functions.columns import day_of, time_of

TIMEOUT_S = 1800
#: Time of a piece of a visitor's events.
PIECE_MS = 6 * 3_600_000


def tag_sessions(events: DataFrame, timeout_s: int = TIMEOUT_S, piece_ms: int = PIECE_MS, start: str | None = None) -> DataFrame:
    """events with session_id: the visitor and the session's first millisecond, whatever history was read.

    A pause of exactly the timeout stays in the session. A visitor's events are cut into pieces of time, so one busy
    visitor is spread over many tasks: pauses within a piece are seen there, and one row for each piece (its first and last event and the last
    start within) tells the pieces after it which session is still open. Null visitors are one visitor; an event without a time is in no session's span.
    `start` names a column for the session's first millisecond.
    """
    piece = events.withColumn("_who", F.coalesce(F.col("visitorid").cast("string"), F.lit(""))).withColumn("_piece", F.floor(F.col("timestamp") / piece_ms))
    by_time = Window.partitionBy("_who", "_piece").orderBy("timestamp")
    pause = F.col("timestamp") - F.lag("timestamp").over(by_time)
    inner = piece.withColumn("_starts", F.when(pause > timeout_s * 1000, F.col("timestamp")))

    edges = inner.groupBy("_who", "_piece").agg(F.min("timestamp").alias("_first"), F.max("timestamp").alias("_last"), F.max("_starts").alias("_latest"))
    pieces = Window.partitionBy("_who").orderBy("_piece")
    silent = F.col("_first") - F.lag("_last").over(pieces)
    opened = edges.where("_piece IS NOT NULL").withColumn("_opens", F.when(silent.isNull() | (silent > timeout_s * 1000), F.col("_first")))
    before = F.last(F.coalesce("_latest", "_opens"), ignorenulls=True).over(pieces.rowsBetween(Window.unboundedPreceding, -1))
    carried = opened.select(F.col("_who").alias("_of"), F.col("_piece").alias("_at"), F.coalesce("_opens", before).alias("_open"))

    so_far = F.max("_starts").over(by_time.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    tagged = inner.withColumn("_start", so_far).join(carried, (F.col("_who") == F.col("_of")) & (F.col("_piece") == F.col("_at")), "left")
    first = F.coalesce("_start", "_open")
    kept = [*events.columns, F.concat_ws("-", "visitorid", first).alias("session_id")]
    return tagged.select(*kept, *([first.alias(start)] if start else []))


def rollup(tagged: DataFrame) -> DataFrame:
    """One row for each session, summed before the shuffle."""
    first, last = F.min("timestamp"), F.max("timestamp")
    out = tagged.groupBy("session_id", "visitorid").agg(first.alias("_first"), last.alias("_last"), F.count(F.lit(1)).alias("event_count"), F.bool_or(F.coalesce(F.col("event") == "transaction", F.lit(False))).alias("has_purchase"))
    return out.select("session_id", "visitorid", time_of(F.col("_first")).alias("start_time"), time_of(F.col("_last")).alias("end_time"), "event_count", "has_purchase", day_of(F.col("_first")).alias("session_date"))


def build_sessions(events: DataFrame, timeout_s: int = TIMEOUT_S) -> DataFrame:
    return rollup(tag_sessions(events, timeout_s))


def build_sessions_native(events: DataFrame, timeout_s: int = TIMEOUT_S, keep_time: bool = False) -> DataFrame:
    """The same by session_window, which also works on streams. Its gap is one microsecond longer, to keep equal pauses.

    With keep_time the events bring their time in `at`, with a watermark.
    """
    timed = events if keep_time else events.withColumn("at", F.timestamp_millis("timestamp"))
    gap = F.session_window("at", F.lit(f"{timeout_s} seconds 1 microsecond"))
    out = timed.groupBy("visitorid", gap.alias("w")).agg(F.min("timestamp").alias("_first"), F.max("timestamp").alias("_last"), F.count(F.lit(1)).alias("event_count"), F.bool_or(F.coalesce(F.col("event") == "transaction", F.lit(False))).alias("has_purchase"))
    return out.select(F.concat_ws("-", "visitorid", "_first").alias("session_id"), "visitorid", time_of(F.col("_first")).alias("start_time"), time_of(F.col("_last")).alias("end_time"), "event_count", "has_purchase", day_of(F.col("_first")).alias("session_date"))
