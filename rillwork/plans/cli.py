"""python -m rillwork.plans.cli JOB --lake DIR [--raw-dir DIR] [--since DAY] [--until DAY] [--config FILE] [--all] [--no-log]

daily runs the day --since, or yesterday; train fits the algorithm of --config (YAML over the defaults), with --all every one.
"""

from __future__ import annotations

import argparse
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame

from rillwork.functions.session import session
from rillwork.operators import abandon
from rillwork.plans import jobs
from rillwork.plans.window import Days
from rillwork.sources.ledger import job

JOBS = ("bronze", "silver", "sessions", "gold", "marts", "checks", "als", "item2vec", "train", "daily", "backfill", "weekly")


def main(args: list[str] | None = None) -> DataFrame | None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("job", choices=JOBS)
    p.add_argument("--lake", required=True)
    p.add_argument("--raw-dir", default="data/raw")
    p.add_argument("--since")
    p.add_argument("--until")
    p.add_argument("--config")
    p.add_argument("--all", action="store_true")
    p.add_argument("--no-log", action="store_true")
    a = p.parse_args(args)
    spark, lake, days = session(a.job), jobs.Lake(a.lake), Days.parse(a.since, a.until)
    ledger = None if a.no_log else lake.at("pipeline_runs")
    config = abandon.load_config(a.config) if a.config else None
    if a.job == "backfill":
        return jobs.backfill(spark, lake, a.raw_dir, days, ledger)
    found = None
    if a.job == "daily":
        found = jobs.daily(spark, lake, a.raw_dir, days.since or datetime.now(UTC).date() - timedelta(1), ledger)
    elif a.job == "weekly":
        found = jobs.weekly(spark, lake, ledger, config)
    elif a.job == "checks":
        found = jobs.check_all(spark, lake)
    if found is not None:
        found.show(100, truncate=False)
        return found

    def train() -> int:
        nonlocal found
        found = jobs.train(spark, lake, config, abandon.COMPARED if a.all else None)
        found.show(truncate=False)
        return found.count()

    run = {
        "bronze": lambda: jobs.bronze(spark, lake, a.raw_dir, days),
        "silver": lambda: jobs.silver(spark, lake, days),
        "sessions": lambda: jobs.build_sessions(spark, lake, days),
        "gold": lambda: jobs.gold(spark, lake, days),
        "marts": lambda: jobs.build_marts(spark, lake, full=days.open),
        "als": lambda: jobs.recommendations(spark, lake, "als"),
        "item2vec": lambda: jobs.recommendations(spark, lake, "item2vec"),
        "train": train,
    }[a.job]
    with job(spark, a.job, ledger) as out:
        out["rows"] = run()
    return found


if __name__ == "__main__":
    main()
