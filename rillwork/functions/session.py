"""The Spark session that the jobs run in."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "rillwork", **conf: str) -> SparkSession:
    """Adaptive execution on, times in UTC; the master and sizes are the cluster's to set."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
