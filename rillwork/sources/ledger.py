"""The ledger of runs: one row for each job that ended, well or not."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillwork.sources.schemas import RUNS


def log_run(spark: SparkSession, path: str, task: str, rows: int | None, seconds: float, status: str, started: datetime, error: str | None = None) -> None:
    spark.createDataFrame([(uuid.uuid4().hex, task, rows, seconds, status, started, error)], RUNS).write.mode("append").parquet(path)


@contextmanager
def job(spark: SparkSession, task: str, ledger: str | None, on_failure: Callable[[str, str], None] | None = None) -> Iterator[dict]:
    """Times what runs inside and logs it; a failure is logged, passed to on_failure and raised again.

    The job puts its number of rows into the dict under "rows". Without a ledger path nothing is logged.
    """
    out, began, started = {"rows": None}, time.perf_counter(), datetime.now(timezone.utc)
    try:
        yield out
    except Exception as e:
        if ledger:
            log_run(spark, ledger, task, None, time.perf_counter() - began, "failed", started, str(e)[:2000])
        if on_failure:
            on_failure(task, str(e))
        raise
    if ledger:
        log_run(spark, ledger, task, out["rows"], time.perf_counter() - began, "success", started)


def latest_runs(runs: DataFrame, task: str = "task_name", at: str = "started_at", tie: str = "run_id") -> DataFrame:
    """The latest row of each task, in order of task."""
    order = Window.partitionBy(task).orderBy(F.desc(at), F.desc(tie))
    return runs.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place").orderBy(task)
