"""Sessions of a stream of events, by the same rule as the batch job."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwork.functions.columns import day_of
from rillwork.functions.shared import cut
from rillwork.operators.events import dedupe_events
from rillwork.operators.sessions import TIMEOUT_S, build_sessions, build_sessions_native
from rillwork.sources import files, versions


def stream_sessions(events: DataFrame, late: str = "1 day", timeout_s: int = TIMEOUT_S) -> DataFrame:
    """Sessions that the watermark has closed; events later than `late` are left to `upsert` or the batch rebuild."""
    timed = events.withColumn("at", F.timestamp_millis("timestamp")).withWatermark("at", late)
    return build_sessions_native(timed, timeout_s, keep_time=True)


def start(sessions: DataFrame, path: str, checkpoint: str):
    """Appends finished sessions to a table by the day they began on, exactly once, until the input is used up."""
    return sessions.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("session_date").outputMode("append").trigger(availableNow=True).start()


def upsert(root: str, timeout_s: int = TIMEOUT_S, reach_days: int = 1) -> Callable[[DataFrame, int], None]:
    """What `foreachBatch` does with a batch of events, however late: sessions as if all events so far had come at once.

    The batch is kept under its number, so a replayed one replaces itself. Of the visitors and days that it touches, all events are read
    again and their sessions replace those before, of `reach_days` days round each touched one; other visitors' sessions of these
    days stay. The manifest of the sessions notes the batch in the same step that shows its sessions: a batch that it knows is
    done, one that failed before it is done again. Sessions are taken to be shorter than `reach_days`, as in the batch job.
    """
    kept, made = f"{root.rstrip('/')}/events", f"{root.rstrip('/')}/sessions"

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        state = versions.manifest(spark, made)
        if state is not None and state.notes.get("batch", -1) >= number:
            return
        day = F.coalesce(day_of(F.col("timestamp")).cast("string"), F.lit("none"))
        batch.withColumn("day", day).write.mode("overwrite").partitionBy("day").parquet(f"{kept}/batch={number}")
        if not files.exists(spark, f"{kept}/batch={number}/_SUCCESS") or batch.isEmpty():
            return
        own = spark.read.schema(f"{batch_schema(batch)}, day string").parquet(f"{kept}/batch={number}")
        touched = cut(own.where("timestamp IS NOT NULL").select("visitorid", "day").distinct())
        days = [r["day"] for r in touched.select(F.col("day").cast("date").alias("day")).distinct().collect()]  # days of one batch
        near = lambda n: sorted({d + timedelta(k) for d in days for k in range(-n, n + 1)})
        emit, look = near(reach_days), near(2 * reach_days)
        visitors = touched.select(F.col("visitorid").alias("who")).distinct()
        mine = lambda df: F.col("visitorid").eqNullSafe(F.col("who"))
        history = spark.read.schema(f"{batch_schema(batch)}, batch long, day string").parquet(kept).where(F.col("batch") <= number)
        history = history.where(F.col("day").isin([str(d) for d in look]))  # prunes
        again = history.join(visitors, mine(history), "left_semi").drop("batch", "day")
        fresh = build_sessions(dedupe_events(again), timeout_s).where(F.col("session_date").isin(emit))
        if state is not None:
            old = versions.read(spark, made, state, [str(d) for d in emit])
            fresh = fresh.unionByName(old.join(visitors, mine(old), "left_anti"))
        versions.replace(fresh, made, "session_date", emit, {"batch": number})

    return run


def batch_schema(batch: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema)


def start_upsert(events: DataFrame, root: str, checkpoint: str, timeout_s: int = TIMEOUT_S):
    """Keeps the sessions under root/sessions up to date with all events, late ones too, until the input is used up."""
    return events.writeStream.foreachBatch(upsert(root, timeout_s)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
