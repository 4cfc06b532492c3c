"""The registered queries over the test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import UTC, date, datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.functions.columns import ms_of
from rillwork.functions.shared import cut, scratch
from rillwork.operators import abandon, events, marts, pairs, quality, recommend, serving, sessions
from rillwork.plans import jobs
from rillwork.plans.window import Days
from rillwork.sources import files, schemas, testdata
from rillwork.sources.ledger import latest_runs

Query = Callable[[SparkSession, str], DataFrame]
#: Test events are sparse: with half an hour's pause few sessions hold two items.
DAY_S = 86_400
HOUR_MS = 3_600_000
#: Days of a run in the incremental query.
STEP = 6
#: Days that they write again, and the pause of the tables that are kept up: with it no session is longer than these days.
REPROCESS, KEPT_UP_S = 3, 6 * 3600


class Model:
    """The clickstream tables of one directory."""

    def __init__(self, spark: SparkSession, sf_dir: str, timeout_s: int = sessions.TIMEOUT_S):
        self.spark, self.dir, self.timeout_s = spark, sf_dir, timeout_s
        self.events = testdata.events(spark, sf_dir)
        self.properties = testdata.item_properties(spark, sf_dir)
        self.tree = testdata.category_tree(spark, sf_dir)

    @property
    def enriched(self) -> DataFrame:
        return events.point_in_time_category(events.dedupe_events(self.events), self.properties)

    @property
    def tagged(self) -> DataFrame:
        return sessions.tag_sessions(self.enriched, self.timeout_s)

    @property
    def sessions(self) -> DataFrame:
        return sessions.build_sessions(events.dedupe_events(self.events), self.timeout_s)

    @property
    def latest(self) -> DataFrame:
        return events.latest_item_snapshot(self.properties)

    @property
    def pairs(self) -> DataFrame:
        return pairs.cooccurrence_pairs(sessions.tag_sessions(events.dedupe_events(self.events), self.timeout_s))

    @property
    def funnel(self) -> DataFrame:
        return marts.fct_funnel(self.enriched)

    @property
    def features(self) -> DataFrame:
        return marts.feature_table(self.enriched, self.latest)

    @property
    def feature_sessions(self) -> DataFrame:
        return marts.feature_sessions(self.tagged, marts.fct_sessions(self.sessions))

    def gold(self) -> dict[str, DataFrame]:
        tagged = cut(self.tagged)
        made = sessions.rollup(tagged)
        found = pairs.cooccurrence_pairs(tagged)
        return {
            "raw_events": marts.with_load_time(tagged), "raw_sessions": marts.with_load_time(made), "raw_category_tree": self.tree, "item_latest": self.latest, "cooccur_pairs": found,
            "fct_sessions": marts.fct_sessions(made), "fct_funnel": marts.fct_funnel(tagged), "dim_categories": marts.dim_categories(self.tree), "dim_items": marts.dim_items(self.latest, self.tree),
            "feature_table": marts.feature_table(tagged, self.latest), "feature_sessions": marts.feature_sessions(tagged, marts.fct_sessions(made)), "feature_cooccur": pairs.feature_cooccur(found),
        }


def _on(make: Callable[[Model], DataFrame], timeout_s: int = sessions.TIMEOUT_S) -> Query:
    return lambda spark, sf_dir: make(Model(spark, sf_dir, timeout_s))


def _twice(m: Model) -> DataFrame:
    return events.dedupe_events(m.events.unionByName(m.events.where("itemid < 20")))


def _tail(m: Model) -> DataFrame:
    seen = cut(m.enriched)
    return marts.funnel_tail(seen, marts.fct_funnel(seen))


def _baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = testdata.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_partkey").alias("itemid"))
    return pairs.pair_support(lines, ["session_id"], "itemid").select("item_a", "item_b", "weight")


def _basket_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = testdata.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("visitorid"))
    lines = testdata.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("itemid"))
    return recommend.implicit_ratings(orders.join(lines, "o_orderkey").withColumn("event", F.lit("transaction")))


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testdata.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))


def _health(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = testdata.table(spark, sf_dir, "events").select(F.col("event_type").alias("task_name"), F.col("ts").alias("started_at"), F.col("event_id").alias("run_id"), "value")
    return latest_runs(runs)


def _metrics(m: Model) -> DataFrame:
    rows = abandon.at_risk(m.feature_sessions)
    return abandon.metrics(rows.select(F.least(F.round(F.col("n_views") / 4.0, 6), F.lit(1.0)).alias("score"), F.col("abandoned").cast("int").alias("label")))


def _trained(m: Model) -> DataFrame:
    """All four algorithms with all of their settings, the number of trees included."""
    parts = abandon.parted(m.feature_sessions)
    return reduce(DataFrame.unionByName, [abandon.train(None, None, a, parts)[1] for a in abandon.CONFIG["params"]])


def _dq(*checks: quality.Check) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        m = Model(spark, sf_dir)
        of = {"enriched": lambda: m.enriched, "latest": lambda: m.latest, "tree": lambda: m.tree, "pairs": lambda: Model(spark, sf_dir, DAY_S).pairs}
        named = {c.table for c in checks} | {"tree"}
        return quality.run_checks({t: of[t]() if t in of else testdata.table(spark, sf_dir, t) for t in named}, checks)

    return run


def _freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.freshness(testdata.table(spark, sf_dir, "events").withColumn("at", F.timestamp_millis(ms_of(F.col("ts")))), F.col("event_type"), datetime(2024, 2, 1, tzinfo=UTC), "at")
    return found.withColumn("age_hours", F.round("age_hours", 6))


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours of the item that is asked for, among all items; the other items' aren't made only to be dropped."""
    stored = cut(recommend.top_n_neighbors(_embeddings(spark, sf_dir), digits=6, of=[10]).withColumn("method", F.lit("als")))
    return serving.recommend(stored, Model(spark, sf_dir, DAY_S).pairs, 10, "als", 15)


def _landed(m: Model) -> tuple[jobs.Lake, str, Days]:
    """A lake of its own, its raw files, and the days of the table."""
    root = f"{scratch(m.spark)}/lake-{uuid.uuid4().hex}"
    bounds = m.events.agg(F.min("event_date").alias("first"), F.max("event_date").alias("last")).first()
    raw = f"{root}/raw"
    for name, df in {"events.csv": m.events.drop("event_date"), "item_properties_part1.csv": m.properties.where("itemid < 50"), "item_properties_part2.csv": m.properties.where("itemid >= 50"), "category_tree.csv": m.tree}.items():
        df.write.csv(f"{raw}/{name}", header=True)
    return jobs.Lake(root, m.timeout_s, reprocess_days=REPROCESS), raw, Days(bounds["first"], bounds["last"] + timedelta(1))


def _incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All days of the table run through all jobs, STEP days at a time; the sessions they leave."""
    lake, raw, whole = _landed(Model(spark, sf_dir))
    for days in whole.each(STEP):
        jobs.bronze(spark, lake, raw, days)
        jobs.silver(spark, lake, days)
        jobs.build_sessions(spark, lake, days)
        jobs.gold(spark, lake, days)
    return lake.read(spark, "gold/raw_sessions").drop("_loaded_at")


def _kept_up(table: str) -> Query:
    """A table that is kept up by its changes, after all days of the events, STEP at a time; the last window is run twice."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lake, raw, whole = _landed(Model(spark, sf_dir, KEPT_UP_S))
        jobs.bronze(spark, lake, raw)
        jobs.silver(spark, lake)
        keep = {"cooccur_pairs": jobs.keep_pairs, "item_latest": jobs.keep_latest}[table]
        windows = whole.each(STEP)
        for days in [*windows, windows[-1]]:
            keep(spark, lake, days)
        return lake.read(spark, f"gold/{table}")

    return run


def _neighbours(vectors: Callable[[DataFrame], DataFrame]) -> Query:
    return _on(lambda m: recommend.top_n_neighbors(vectors(events.dedupe_events(m.events))))


def queries() -> dict[str, Query]:
    return {
        "bronze_events": _on(lambda m: m.events),
        "bronze_item_properties": _on(lambda m: m.properties),
        "bronze_category_tree": _on(lambda m: m.tree),
        "events_window": _on(lambda m: events.in_window(m.events, "event_date", date(2024, 1, 10), date(2024, 1, 15))),
        "dedupe_events": _on(_twice),
        "point_in_time_category": _on(lambda m: m.enriched),
        "point_in_time_bucketed": _on(lambda m: events.point_in_time_category(events.dedupe_events(m.events), m.properties, 6 * HOUR_MS)),
        "latest_item_snapshot": _on(lambda m: m.latest),
        "tag_sessions": _on(lambda m: sessions.tag_sessions(m.events)),
        "build_sessions": _on(lambda m: m.sessions),
        "build_sessions_day": _on(lambda m: m.sessions, DAY_S),
        "fct_sessions": _on(lambda m: marts.fct_sessions(m.sessions)),
        "sessions_native": _on(lambda m: sessions.build_sessions_native(events.dedupe_events(m.events))),
        "cooccur_pairs": _on(lambda m: m.pairs, DAY_S),
        "feature_cooccur": _on(lambda m: pairs.feature_cooccur(m.pairs), DAY_S),
        "basket_pairs": _baskets,
        "fct_funnel": _on(lambda m: m.funnel),
        "funnel_tail": _on(_tail),
        "dim_categories": _on(lambda m: marts.dim_categories(m.tree)),
        "dim_items": _on(lambda m: marts.dim_items(m.latest, m.tree)),
        "feature_table": _on(lambda m: m.features),
        "feature_sessions": _on(lambda m: m.feature_sessions),
        "feature_sessions_day": _on(lambda m: m.feature_sessions, DAY_S),
        "funnel_stats": _on(lambda m: serving.funnel_stats(m.funnel, 5, date(2024, 1, 5), date(2024, 1, 20))),
        "funnel_by_category": _on(lambda m: serving.funnel_by_category(m.funnel)),
        "top_items": _on(lambda m: serving.top_items(m.features, 20, 5)),
        "recommend_fallback": _on(lambda m: serving.bought_with(m.pairs, 10, 20), DAY_S),
        "recommend_stored": _stored,
        "pipeline_health": _health,
        "implicit_ratings": _on(lambda m: recommend.implicit_ratings(m.events)),
        "basket_ratings": _basket_ratings,
        "popular_items": _on(lambda m: recommend.popular_items(recommend.implicit_ratings(m.events), 30)),
        "item_sequences": _on(lambda m: recommend.item_sequences(m.events, DAY_S).select("session_id", F.array_join("items", ",").alias("items"))),
        "top_n_neighbors": lambda spark, sf_dir: recommend.top_n_neighbors(_embeddings(spark, sf_dir), digits=6),
        "als_recommend": _neighbours(lambda e: recommend.als_vectors(e)),
        "item2vec_recommend": _neighbours(lambda e: recommend.item2vec_vectors(e, timeout_s=DAY_S)),
        "time_split": _on(lambda m: abandon.time_split(abandon.at_risk(m.feature_sessions)).select("session_id", "start_time", "is_train")),
        "classifier_metrics": _on(_metrics, DAY_S),
        "train_abandon": _on(_trained),
        "dq_not_null": _dq(quality.not_null("enriched", "categoryid"), quality.not_null("enriched", "transactionid"), quality.not_null("tree", "parentid")),
        "dq_unique": _dq(quality.unique("lineitem", "l_orderkey"), quality.unique("latest", "itemid"), quality.unique("enriched", "timestamp")),
        "dq_accepted_values": _dq(quality.accepted_values("events", "event_type", schemas.EVENT_KINDS), quality.accepted_values("pairs", "pair_type", schemas.PAIR_KINDS)),
        "dq_accepted_range": _dq(quality.at_least("customer", "c_acctbal", 0), quality.at_least("pairs", "weight", 2)),
        "dq_relationships": _dq(quality.relationship("latest", "categoryid", "tree", "categoryid"), quality.relationship("enriched", "visitorid", "tree", "categoryid")),
        "dq_freshness": _freshness,
        "dq_all": lambda spark, sf_dir: quality.run_checks(Model(spark, sf_dir, DAY_S).gold()),
        "incremental_equals_full": _incremental,
        "incremental_pairs": _kept_up("cooccur_pairs"),
        "incremental_latest": _kept_up("item_latest"),
    }
