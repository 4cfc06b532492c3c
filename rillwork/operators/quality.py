"""Data-quality checks: each gives the rows that break it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwork.sources.schemas import EVENT_KINDS, PAIR_KINDS

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Check:
    """A check of one column. `broken` tells the rows that break it by themselves; without it values are counted across rows."""

    name: str
    table: str
    column: str
    broken: Callable[[], Column] | None = None
    parent: tuple[str, str] | None = None


def not_null(table: str, column: str) -> Check:
    return Check("not_null", table, column, lambda: F.col(column).isNull())


def unique(table: str, column: str) -> Check:
    """Values found more than once; nulls aren't values."""
    return Check("unique", table, column)


def accepted_values(table: str, column: str, values: tuple[str, ...]) -> Check:
    return Check("accepted_values", table, column, lambda: ~F.col(column).isin(*values))


def at_least(table: str, column: str, least: float) -> Check:
    return Check("accepted_range", table, column, lambda: F.col(column) < least)


def relationship(table: str, column: str, parent: str, key: str) -> Check:
    """Non-null values that aren't in the parent's key."""
    return Check("relationships", table, column, parent=(parent, key))


SOURCE_CHECKS = (
    *(not_null("raw_events", c) for c in ("visitorid", "itemid", "event", "_loaded_at")),
    *(not_null("raw_sessions", c) for c in ("session_id", "visitorid", "event_count", "has_purchase")),
    not_null("raw_category_tree", "categoryid"),
    not_null("item_latest", "itemid"),
    unique("raw_sessions", "session_id"),
    unique("raw_category_tree", "categoryid"),
    unique("item_latest", "itemid"),
    accepted_values("raw_events", "event", EVENT_KINDS),
    accepted_values("cooccur_pairs", "pair_type", PAIR_KINDS),
    at_least("raw_sessions", "event_count", 1),
    at_least("cooccur_pairs", "weight", 2),
)
MART_CHECKS = (
    *(not_null("fct_sessions", c) for c in ("session_id", "visitorid")),
    *(not_null("fct_funnel", c) for c in ("categoryid", "event_date")),
    not_null("dim_categories", "categoryid"),
    not_null("dim_items", "itemid"),
    not_null("feature_table", "itemid"),
    *(not_null("feature_sessions", c) for c in ("session_id", "visitorid")),
    *(not_null("feature_cooccur", c) for c in ("pair_id", "item_a", "item_b")),
    unique("fct_sessions", "session_id"),
    unique("dim_categories", "categoryid"),
    unique("dim_items", "itemid"),
    unique("feature_table", "itemid"),
    unique("feature_sessions", "session_id"),
    unique("feature_cooccur", "pair_id"),
    relationship("fct_funnel", "categoryid", "dim_categories", "categoryid"),
    relationship("dim_items", "categoryid", "dim_categories", "categoryid"),
)
CHECKS = SOURCE_CHECKS + MART_CHECKS


def _entries(table: str, df: DataFrame, checks: list[tuple[int, Check]]) -> DataFrame | None:
    """(number, key, parent): what a table's rows give to the checks, in one scan of it.

    A row gives the number of each check that it breaks by itself, and its value to each check that counts values, as a
    child or as a parent.
    """
    given = []
    entry = lambda k, key, parent, when: F.when(when, F.struct(F.lit(k).alias("number"), key.alias("key"), F.lit(parent).alias("parent")))
    for k, c in checks:
        if c.table == table and c.broken is not None:
            given.append(entry(k, F.lit(None).cast("string"), False, c.broken()))
        elif c.table == table:
            given.append(entry(k, F.col(c.column).cast("string"), False, F.col(c.column).isNotNull()))
        if c.parent and c.parent[0] == table:
            given.append(entry(k, F.col(c.parent[1]).cast("string"), True, F.col(c.parent[1]).isNotNull()))
    if not given:
        return None
    return df.select(F.explode(F.filter(F.array(*given), lambda e: e.isNotNull())).alias("e")).select("e.*")


def run_checks(tables: Tables, checks: tuple[Check, ...] = CHECKS) -> DataFrame:
    """(check_name, table_name, column_name, violations), a row for each check whose table is given, in one scan of each table."""
    spark = next(iter(tables.values())).sparkSession
    numbered = [(k, c) for k, c in enumerate(checks) if c.table in tables]
    found = [e for t, df in tables.items() if (e := _entries(t, df, numbered)) is not None]
    names = spark.createDataFrame([(k, c.name, c.table, c.column, 0 if c.broken else 2 if c.parent else 1) for k, c in numbered], "number int, check_name string, table_name string, column_name string, kind int")
    keys = reduce(DataFrame.unionByName, found).groupBy("number", "key").agg(F.count_if(~F.col("parent")).alias("n"), F.bool_or("parent").alias("known"))  # one shuffle, counted before it
    counts = keys.groupBy("number").agg(F.sum("n").alias("rows"), F.count_if(F.col("n") > 1).alias("again"), F.sum(F.when(~F.col("known"), F.col("n")).otherwise(0)).alias("orphans"))
    of_kind = F.when(F.col("kind") == 0, F.col("rows")).when(F.col("kind") == 1, F.col("again")).otherwise(F.col("orphans"))
    return names.join(counts, "number", "left").select("check_name", "table_name", "column_name", F.coalesce(of_kind, F.lit(0)).cast("long").alias("violations"))


def freshness(table: DataFrame, name: str | Column, now: datetime, column: str = "_loaded_at", warn_h: float = 26, error_h: float = 48) -> DataFrame:
    """(table_name, age_hours, status): pass, warn or error; an empty table is an error.

    A column as name gives a row for each of its values.
    """
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.max(F.col(column).cast("timestamp")))) / 3.6e9
    status = F.when(F.col("age_hours").isNull() | (F.col("age_hours") > error_h), "error").when(F.col("age_hours") > warn_h, "warn").otherwise("pass")
    parts = table.agg(F.lit(name).alias("table_name"), age.alias("age_hours")) if isinstance(name, str) else table.groupBy(name.alias("table_name")).agg(age.alias("age_hours"))
    return parts.select("table_name", "age_hours", status.alias("status"))
