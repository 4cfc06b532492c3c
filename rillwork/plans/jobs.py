"""The jobs from raw files to gold tables, each a full rebuild or an idempotent window of days with the same result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, timedelta
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.functions.columns import day_of
from rillwork.functions.shared import cut, freed
from rillwork.operators import abandon, events, marts, pairs, quality, recommend, sessions
from rillwork.plans.window import Days
from rillwork.sources import files, schemas, versions
from rillwork.sources.ledger import job

#: Days of sessions that a window writes again, for sessions that go on over midnight.
REPROCESS_DAYS = 1
#: Partitions of the state that has no day.
PARTS = 8


@dataclass(frozen=True)
class Lake:
    """Where the tables are."""

    root: str
    timeout_s: int = sessions.TIMEOUT_S
    min_support: int = pairs.MIN_SUPPORT
    reprocess_days: int = REPROCESS_DAYS

    def at(self, table: str) -> str:
        return f"{self.root.rstrip('/')}/{table}"

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        """The table's newest state; what is partitioned has a manifest."""
        state = versions.manifest(spark, self.at(table))
        return spark.read.parquet(self.at(table)) if state is None else versions.read(spark, self.at(table), state)

    def has(self, spark: SparkSession, table: str) -> bool:
        return files.exists(spark, self.at(table))


def _put(df: DataFrame, path: str, by: str, days: Days) -> int:
    """All of a table, the whole window, or, if a bound is missing, the days that df has; each in one step."""
    if days.open:
        return versions.replace(df, path, by)
    return versions.replace(df, path, by, versions.days_of(days.since, days.until) if days.since and days.until else ())


def bronze(spark: SparkSession, lake: Lake, raw_dir: str, days: Days = Days()) -> int:
    """Raw CSV to Parquet; a window lands the static tables only where they are missing."""
    raw = files.read_csv(spark, f"{raw_dir}/events.csv", schemas.EVENTS).withColumn("event_date", day_of(F.col("timestamp")))
    raw = raw.where(events.between(F.col("timestamp"), days.since, days.until))  # the same days; asked of the field itself, so other rows are only parsed that far
    n = _put(events.in_window(raw, "event_date", days.since, days.until), lake.at("bronze/events"), "event_date", days)
    parts = [f"{raw_dir}/item_properties_part{k}.csv" for k in (1, 2)]
    for table, paths, schema in (("item_properties", parts, schemas.ITEM_PROPERTIES), ("category_tree", f"{raw_dir}/category_tree.csv", schemas.CATEGORY_TREE)):
        if days.open or not lake.has(spark, f"bronze/{table}"):
            files.write(files.read_csv(spark, paths, schema), lake.at(f"bronze/{table}"))
    return n


def silver(spark: SparkSession, lake: Lake, days: Days = Days()) -> int:
    """Distinct events with the category valid at their time. The window is taken first, so it prunes the scan."""
    fresh = events.dedupe_events(events.in_window(lake.read(spark, "bronze/events"), "event_date", days.since, days.until))
    properties = events.known_between(lake.read(spark, "bronze/item_properties"), days.since, days.until)
    return _put(events.point_in_time_category(fresh, properties), lake.at("silver/events_enriched"), "event_date", days)


def _tagged(spark: SparkSession, lake: Lake, days: Days, start: str | None = None) -> DataFrame:
    """Events with sessions, read from a day before the first whose sessions are written, for sessions begun there."""
    early = days.earlier(lake.reprocess_days + 1)
    return sessions.tag_sessions(events.in_window(lake.read(spark, "silver/events_enriched"), "event_date", early.since, early.until), lake.timeout_s, start=start)


def build_sessions(spark: SparkSession, lake: Lake, days: Days = Days()) -> int:
    """Sessions by the day they began on."""
    if days.until and not days.since:
        raise ValueError("a window of sessions needs a first day")
    emit = days.earlier(lake.reprocess_days)
    found = sessions.rollup(_tagged(spark, lake, days))
    return _put(events.in_window(found, "session_date", emit.since), lake.at("silver/sessions"), "session_date", emit)


@freed()
def gold(spark: SparkSession, lake: Lake, days: Days = Days()) -> int:
    """The tables that marts read. A window needs both bounds; what can't be cut by day is then only made if missing.

    Sessions are tagged once, for the events and for the pairs.
    """
    if not days.open and not (days.since and days.until):
        raise ValueError("a window of gold tables needs both bounds")
    columns = ["visitorid", "event", "itemid", "categoryid", "event_date", "session_id"]
    tagged = cut(_tagged(spark, lake, days, "_began").select(*columns, "_began"))
    n = _put(marts.with_load_time(events.in_window(tagged, "event_date", days.since, days.until).select(*columns)), lake.at("gold/raw_events"), "event_date", days)
    emit = days.earlier(lake.reprocess_days)
    n += _put(marts.with_load_time(events.in_window(lake.read(spark, "silver/sessions"), "session_date", emit.since, emit.until)), lake.at("gold/raw_sessions"), "session_date", emit)
    if days.open or not lake.has(spark, "gold/raw_category_tree"):
        n += files.write(lake.read(spark, "bronze/category_tree"), lake.at("gold/raw_category_tree"))
    return n + keep_pairs(spark, lake, days, tagged) + keep_latest(spark, lake, days)


@freed()
def keep_pairs(spark: SparkSession, lake: Lake, days: Days = Days(), tagged: DataFrame | None = None) -> int:
    """The pairs of items, kept up day by day; `tagged` are the days' events with sessions, if they are made already.

    gold/pairs_by_day has every day's sessions' pairs, whatever their support, so a day that is written again replaces what
    its sessions said before. gold/pair_counts sums them: it takes in the days that have changed since the state that it
    notes, the new counts and the old ones with their sign turned. So a run that failed between the two tables is made up for by the next.
    """
    first = not lake.has(spark, "gold/pairs_by_day")
    emit = Days() if first else days.earlier(lake.reprocess_days)
    if first and (tagged is None or not days.open):
        known = events.in_window(lake.read(spark, "silver/events_enriched"), "event_date", None, days.until)
        tagged = sessions.tag_sessions(known, lake.timeout_s, start="_began")
    elif tagged is None:
        tagged = _tagged(spark, lake, days, "_began")
    dated = tagged.withColumn("session_date", day_of(F.col("_began")))
    by_day, totals = lake.at("gold/pairs_by_day"), lake.at("gold/pair_counts")
    _put(pairs.pairs_by_day(events.in_window(dated, "session_date", emit.since)), by_day, "session_date", emit)

    now, held = versions.manifest(spark, by_day), versions.manifest(spark, totals)
    before = versions.manifest(spark, by_day, held.notes["days"]) if held else None
    if before is None:
        counts = pairs.summed(versions.read(spark, by_day, now))
    else:
        changed = sorted(d for d in now.parts.keys() | before.parts.keys() if now.parts.get(d) != before.parts.get(d))
        new, old = (versions.read(spark, by_day, m, changed) for m in (now, before))
        counts = pairs.summed(versions.read(spark, totals, held), new, old.withColumn("weight", -F.col("weight")))
    versions.replace(counts.select("item_a", "item_b", "weight", "pair_type"), totals, "pair_type", notes={"days": now.number})
    found = lake.read(spark, "gold/pair_counts").where(F.col("weight") >= lake.min_support)
    return versions.replace(found, lake.at("gold/cooccur_pairs"), "pair_type")


@freed()
def keep_latest(spark: SparkSession, lake: Lake, days: Days = Days()) -> int:
    """The newest snapshot of each item: the state before with the snapshots of the window's days, or of all where there is none."""
    state, found = lake.at("gold/snapshots"), lake.read(spark, "bronze/item_properties")
    if not days.open and versions.manifest(spark, state):
        found = events.in_window(found.withColumn("_day", day_of(F.col("timestamp"))), "_day", days.since, days.until).drop("_day")
        newest = events.newest(events.newest_snapshots(found).unionByName(versions.read(spark, state).drop("part")))
    else:
        newest = events.newest_snapshots(found)
    made = cut(newest)
    versions.replace(made.withColumn("part", F.pmod(F.xxhash64("itemid"), F.lit(PARTS)).cast("int")), state, "part")
    return files.write(made.select("itemid", "categoryid"), lake.at("gold/item_latest"))


def staged(spark: SparkSession, lake: Lake) -> dict[str, DataFrame]:
    """The gold tables as marts see them."""
    raw = {t: lake.read(spark, f"gold/{t}") for t in ("raw_events", "raw_sessions", "raw_category_tree", "item_latest", "cooccur_pairs")}
    views = {"stg_events": raw["raw_events"].drop("_loaded_at"), "stg_sessions": raw["raw_sessions"].drop("_loaded_at", "session_date"), "stg_category_tree": raw["raw_category_tree"], "stg_item_latest": raw["item_latest"], "stg_cooccur": raw["cooccur_pairs"]}
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return raw | views


def build_marts(spark: SparkSession, lake: Lake, full: bool = False) -> int:
    """All marts; of the funnel only its last days, unless full."""
    t = staged(spark, lake)
    sessions_mart = marts.fct_sessions(t["stg_sessions"])
    made = {
        "fct_sessions": sessions_mart,
        "dim_categories": marts.dim_categories(t["stg_category_tree"]),
        "dim_items": marts.dim_items(t["stg_item_latest"], t["stg_category_tree"]),
        "feature_table": marts.feature_table(t["stg_events"], t["stg_item_latest"]),
        "feature_sessions": marts.feature_sessions(t["stg_events"], sessions_mart),
        "feature_cooccur": pairs.feature_cooccur(t["stg_cooccur"]),
    }
    n = sum(files.write(df, lake.at(f"marts/{name}")) for name, df in made.items())
    path = lake.at("marts/fct_funnel")
    old = lake.read(spark, "marts/fct_funnel") if not full and lake.has(spark, "marts/fct_funnel") else None
    last = old.agg(F.max("event_date").alias("d")).first()["d"] if old is not None else None
    if last is None:
        return n + versions.replace(marts.fct_funnel(t["stg_events"]), path, "event_date")
    newest = t["stg_events"].agg(F.max("event_date").alias("d")).first()["d"] or last
    first = last - timedelta(marts.LOOKBACK_DAYS)
    tail = marts.fct_funnel(events.in_window(t["stg_events"], "event_date", first))
    return n + versions.replace(tail, path, "event_date", versions.days_of(first, max(newest, last) + timedelta(1)))


def check_all(spark: SparkSession, lake: Lake) -> DataFrame:
    marts_of = {m: lake.read(spark, f"marts/{m}") for m in ("fct_sessions", "fct_funnel", "dim_categories", "dim_items", "feature_table", "feature_sessions", "feature_cooccur")}
    return quality.run_checks(staged(spark, lake) | marts_of)


def recommendations(spark: SparkSession, lake: Lake, method: str, **params: Any) -> int:
    """Trains "als" or "item2vec" and replaces that method's neighbours."""
    of = {"als": recommend.als_vectors, "item2vec": recommend.item2vec_vectors}[method]
    found = recommend.top_n_neighbors(of(lake.read(spark, "silver/events_enriched"), **params))
    recommend.save_recommendations(found, method, lake.at("gold/item_recommendations"))
    return lake.read(spark, "gold/item_recommendations").where(F.col("method") == method).count()


def daily(spark: SparkSession, lake: Lake, raw_dir: str, day: date, ledger: str | None = None, on_failure: Callable[[str, str], None] | None = None) -> DataFrame:
    """One day from raw files to checked marts; returns the checks. Every step may run again."""
    days = Days(day, day + timedelta(1))
    steps: list[tuple[str, Callable[[], int]]] = [
        ("bronze_ingest", lambda: bronze(spark, lake, raw_dir, days)),
        ("silver_transform", lambda: silver(spark, lake, days)),
        ("session_builder", lambda: build_sessions(spark, lake, days)),
        ("feature_gold", lambda: gold(spark, lake, days)),
        ("marts", lambda: build_marts(spark, lake)),
    ]
    for name, run in steps:
        with job(spark, name, ledger, on_failure) as out:
            out["rows"] = run()
    return check_all(spark, lake)


def backfill(spark: SparkSession, lake: Lake, raw_dir: str, days: Days, ledger: str | None = None) -> None:
    for one in days.each():
        daily(spark, lake, raw_dir, one.since, ledger)


def train(spark: SparkSession, lake: Lake, config: dict[str, Any] | None = None, algorithms: tuple[str, ...] | None = None) -> DataFrame:
    """Fits and saves the classifiers named, or the one that the settings choose; returns their metrics."""
    settings = abandon.merged(abandon.CONFIG, config)
    parts, found = abandon.parted(lake.read(spark, "marts/feature_sessions"), settings), []
    for algorithm in algorithms or (settings["algorithm"],):
        model, quality_of = abandon.train(None, settings, algorithm, parts)
        abandon.save_model(model, lake.at(f"models/{algorithm}"))
        found.append(quality_of)
    return reduce(DataFrame.unionByName, found)


def weekly(spark: SparkSession, lake: Lake, ledger: str | None = None, config: dict[str, Any] | None = None) -> DataFrame:
    """Everything that can't be kept up day by day: gold and marts in full, and all models. Returns the classifiers' metrics."""
    steps: list[tuple[str, Callable[[], int]]] = [
        ("feature_gold", lambda: gold(spark, lake)),
        ("marts", lambda: build_marts(spark, lake, full=True)),
        ("train_als", lambda: recommendations(spark, lake, "als")),
        ("train_item2vec", lambda: recommendations(spark, lake, "item2vec")),
    ]
    for name, run in steps:
        with job(spark, name, ledger) as out:
            out["rows"] = run()
    return train(spark, lake, config, abandon.COMPARED)
