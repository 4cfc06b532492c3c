"""Column expressions of the clickstream model. None depends on the session's time zone: days and times are UTC."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def named(name: str) -> Column:
    """The column of exactly that name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def day_of(ms: Column) -> Column:
    """The UTC day of milliseconds since 1970."""
    return F.date_add(F.lit(date(1970, 1, 1)), F.floor(ms / DAY_MS).cast("int"))


def time_of(ms: Column) -> Column:
    """Milliseconds since 1970 as a timestamp without a zone."""
    return F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'") + F.make_dt_interval(secs=(ms / 1000).cast("decimal(18,6)"))


def ms_of(ts: Column) -> Column:
    """A timestamp without a zone as milliseconds since 1970, rounded down."""
    days = F.datediff(F.to_date(ts), F.lit(date(1970, 1, 1))).cast("long")
    second = F.extract(F.lit("SECOND"), ts)
    return days * DAY_MS + F.hour(ts) * 3_600_000 + F.minute(ts) * 60_000 + F.floor(second * 1000).cast("long")


def seconds_between(start: Column, end: Column) -> Column:
    return (ms_of(end) - ms_of(start)) / 1000.0


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole isn't positive."""
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def times(event: str) -> Column:
    """How many rows of the group are of that event."""
    return F.count_if(F.col("event") == event)
