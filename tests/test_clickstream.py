"""The transforms on small hand-made tables."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from rillwork.operators import abandon, events, marts, pairs, quality, recommend, serving, sessions
from rillwork.sources import schemas

EVENTS = schemas.EVENTS


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: tuple((x is None, x) for x in r))


def test_dedupe_treats_nulls_as_equal(spark):
    df = spark.createDataFrame([(1, 1, "view", 5, None), (1, 1, "view", 5, None), (2, 1, "view", 5, 7)], EVENTS)
    assert events.dedupe_events(df).count() == 2


@pytest.mark.parametrize("bucket", [None, 1000, 3])
def test_category_at_event_time(spark, bucket):
    seen = spark.createDataFrame([(t, 4, "addtocart", 31, None) for t in (7, 40, 41, 777, 9001)] + [(8, 4, "view", None, None), (9002, 4, "view", 32, None)], EVENTS)
    props = spark.createDataFrame([(40, 31, "categoryid", "3"), (40, 31, "size", "77"), (777, 31, "categoryid", "9"), (777, 31, "categoryid", "5"), (800, 31, "categoryid", "blue"), (9000, 33, "categoryid", "1")], schemas.ITEM_PROPERTIES)
    got = dict(rows(events.point_in_time_category(seen, props, bucket), "timestamp", "categoryid"))
    assert got == {7: None, 8: None, 40: 3, 41: 3, 777: 9, 9001: 9, 9002: None}


@pytest.mark.parametrize("bucket", [None, 1000, 3])
def test_categories_of_equal_times_are_compared_as_numbers(spark, bucket):
    seen = spark.createDataFrame([(t, 4, "view", i, None) for t, i in ((50, 31), (51, 31), (9001, 31), (60, None), (None, 31))], EVENTS)
    props = spark.createDataFrame([(50, 31, "categoryid", v) for v in ("9", "10", "2")] + [(40, None, "categoryid", "7"), (None, 31, "categoryid", "8")], schemas.ITEM_PROPERTIES)
    got = rows(events.point_in_time_category(seen, props, bucket), "timestamp", "itemid", "categoryid")
    assert got == [(50, 31, 10), (51, 31, 10), (60, None, None), (9001, 31, 10), (None, 31, None)]
    assert rows(events.latest_item_snapshot(props.where("timestamp = 50")), "itemid", "categoryid") == [(31, 10)]


def test_latest_snapshot(spark):
    props = spark.createDataFrame([(1, 1, "categoryid", "10"), (9, 1, "categoryid", "20"), (9, 1, "available", "1")], schemas.ITEM_PROPERTIES)
    assert rows(events.latest_item_snapshot(props), "itemid", "categoryid") == [(1, 20)]


@pytest.mark.parametrize("build", [sessions.build_sessions, sessions.build_sessions_native])
def test_sessions_break_only_after_the_timeout(spark, build):
    t = 1_650_000_000_000
    at = [(t, 1), (t + 1_800_000, 1), (t + 3_600_001, 1), (t, 2)]
    df = spark.createDataFrame([(x, v, "transaction" if k == 2 else "view", 1, None) for k, (x, v) in enumerate(at)], EVENTS)
    assert rows(build(df), "session_id", "event_count", "has_purchase") == [(f"1-{t}", 2, False), (f"1-{t + 3_600_001}", 1, True), (f"2-{t}", 1, False)]


def test_pairs_and_cold_start(spark):
    kinds = [("view", 7), ("view", 7), ("view", 5), ("addtocart", 5), ("transaction", 5), ("transaction", 9), ("transaction", 7)]
    tagged = sessions.tag_sessions(spark.createDataFrame([(k * 1000, 3, e, i, None) for k, (e, i) in enumerate(kinds)], EVENTS))
    found = pairs.cooccurrence_pairs(tagged, 1)
    assert rows(found, "item_a", "item_b", "pair_type", "weight") == [(5, 7, "purchase", 1), (5, 7, "view", 1), (5, 9, "purchase", 1), (7, 9, "purchase", 1)]
    assert pairs.cooccurrence_pairs(tagged, 2).count() == 0
    none = spark.createDataFrame([], "item_id long, rec_item_id long, score double, rank int, method string")
    assert rows(serving.recommend(none, found, 9), "rec_item_id", "source") == [(5, "cooccurrence"), (7, "cooccurrence")]


def test_marts(spark):
    """Three sessions on two days: looked at three items of which one was carted twice; bought at once; only bought."""
    d1, d2 = date(2022, 11, 30), date(2022, 12, 1)
    seen = [(5, "view", 61, 8, d1, "five"), (5, "view", 62, 8, d1, "five"), (5, "view", 63, 9, d1, "five"), (5, "addtocart", 62, 8, d1, "five"), (5, "addtocart", 62, 8, d2, "five")]
    seen += [(6, "view", 62, 8, d2, "six"), (6, "addtocart", 62, 8, d2, "six"), (6, "transaction", 62, 8, d2, "six"), (7, "transaction", 64, None, d2, "seven")]
    ev = spark.createDataFrame(seen, "visitorid long, event string, itemid long, categoryid long, event_date date, session_id string")
    times = [("five", 5, datetime(2022, 11, 30, 23, 40), datetime(2022, 12, 1, 0, 5, 30), 5, False), ("six", 6, datetime(2022, 12, 1, 7), datetime(2022, 12, 1, 7, 0, 2), 3, True), ("seven", 7, datetime(2022, 12, 1, 9), datetime(2022, 12, 1, 9), 1, True)]
    se = spark.createDataFrame(times, "session_id string, visitorid long, start_time timestamp_ntz, end_time timestamp_ntz, event_count long, has_purchase boolean")
    latest = spark.createDataFrame([(61, 8), (62, 9), (63, 9), (64, None)], "itemid long, categoryid long")
    tree = spark.createDataFrame([(2, None), (8, 2)], schemas.CATEGORY_TREE)
    funnel = marts.fct_funnel(ev)
    assert rows(funnel, "categoryid", "event_date", "views", "carts", "purchases", "cart_rate", "purchase_rate") == [(8, d1, 2, 1, 0, 0.5, 0.0), (8, d2, 1, 2, 1, 2.0, 0.5), (9, d1, 1, 0, 0, 0.0, 0.0)]
    fct = marts.fct_sessions(se)
    assert rows(fct, "session_id", "duration_seconds") == [("five", 1530.0), ("seven", 0.0), ("six", 2.0)]
    assert rows(marts.dim_categories(tree), "categoryid", "is_root") == [(2, True), (8, False)]
    assert rows(marts.dim_items(latest, tree), "itemid", "parentid") == [(61, 2), (62, None), (63, None), (64, None)]
    assert rows(marts.feature_table(ev, latest), "itemid", "popularity", "item_purchase_rate", "category_purchase_rate") == [(61, 1, 0.0, 1 / 3), (62, 2, 0.5, 0.0), (63, 1, 0.0, 0.0), (64, 0, 0.0, 0.0)]
    assert rows(marts.feature_sessions(ev, fct), "session_id", "start_hour", "event_count", "n_carts", "n_categories", "views_per_item", "abandoned") == [("five", 23, 5, 2, 2, 1.0, True), ("six", 7, 2, 1, 1, 1.0, False)]
    assert marts.funnel_tail(ev, funnel.limit(0)).count() == 3
    assert marts.funnel_tail(ev, funnel, 0).count() == 1
    assert rows(serving.funnel_by_category(funnel, 1), "categoryid", "views") == [(8, 3)]
    with pytest.raises(ValueError):
        serving.top_items(marts.feature_table(ev, latest), 101)


def test_ratings_and_neighbours(spark):
    ev = spark.createDataFrame([(1, 1, "view", 100, None), (2, 1, "transaction", 100, None), (3, 1, "view", 300, None), (4, 1, "other", 300, None)], EVENTS)
    assert rows(recommend.implicit_ratings(ev), "visitorid", "itemid", "rating") == [(1, 100, 6.0), (1, 300, 1.0)]
    wide = spark.createDataFrame([(1, 3_000_000_000, "view", 5_000_000_000, None), (2, 3_000_000_000, "addtocart", 5_000_000_000, None), (3, 7, "view", 5_000_000_000, None)], EVENTS)
    assert rows(recommend.implicit_ratings(wide), "visitorid", "itemid", "rating") == [(7, 5_000_000_000, 1.0), (3_000_000_000, 5_000_000_000, 4.0)]
    assert rows(recommend.als_vectors(wide, rank=2, iterations=1), "id") == [(5_000_000_000,)]
    vec = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "id long, vec array<double>")
    assert rows(recommend.top_n_neighbors(vec, 1), "item_id", "rec_item_id", "rank") == [(1, 2, 1), (2, 1, 1), (3, 2, 1)]


def test_ids_are_numbered_without_gaps(spark):
    ids = spark.range(3000).select((F.col("id") * 1_000_003 % 2000).alias("k")).unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS k"))
    got = [tuple(r) for r in recommend.numbered(ids, "k").collect()]
    assert sorted(i for _, i in got) == list(range(len({k for k, _ in got}))) and len(got) == ids.where("k IS NOT NULL").distinct().count()


def test_stored_recommendations_come_first(spark):
    stored = spark.createDataFrame([(1, 2, 0.5, 2, "als"), (1, 3, 0.9, 1, "als"), (1, 4, 0.7, 1, "item2vec"), (2, 9, 0.1, 1, "als")], "item_id long, rec_item_id long, score double, rank int, method string")
    pairs_of = spark.createDataFrame([(1, 7, 5, "purchase")], "item_a long, item_b long, weight long, pair_type string")
    assert [(r["rec_item_id"], r["source"]) for r in serving.recommend(stored, pairs_of, 1).collect()] == [(3, "model"), (2, "model")]
    assert [r["rec_item_id"] for r in serving.recommend(stored, pairs_of, 1, "item2vec").collect()] == [4]
    assert [r["rec_item_id"] for r in serving.recommend(stored, pairs_of, 7).collect()] == [1]


def test_recommendations_of_one_method_are_replaced(spark, tmp_path):
    one = spark.createDataFrame([(1, 2, 0.5, 1)], "item_id long, rec_item_id long, score double, rank int")
    for method in ("als", "item2vec", "als"):
        recommend.save_recommendations(one, method, str(tmp_path / "r"))
    assert rows(spark.read.parquet(str(tmp_path / "r")), "method") == [("als",), ("item2vec",)]


def test_split_and_metrics(spark):
    df = spark.range(10).select(F.col("id").cast("string").alias("session_id"), F.expr("TIMESTAMP_NTZ '2020-01-01 00:00:00' + make_dt_interval(0, 0, 0, id DIV 3)").alias("start_time"))
    assert [r[0] for r in abandon.time_split(df).orderBy("start_time", "session_id").select("is_train").collect()] == [True] * 8 + [False] * 2
    scored = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.3, 1), (0.1, 0)], "score double, label int")
    assert tuple(abandon.metrics(scored).first()) == (0.5, 0.5, 0.75)
    many = spark.range(4000).select(((F.col("id") * 7919 % 4001) / 4001.0).alias("score"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    got, data = abandon.metrics(many).first()["auc"], [tuple(r) for r in many.collect()]
    pos, neg = ([s for s, y in data if y == k] for k in (1, 0))
    assert abs(got - sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)) < 1e-4
    with pytest.raises(ValueError):
        abandon.build_model("svm", {})


def test_settings_are_merged_level_by_level():
    got = abandon.merged(abandon.CONFIG, {"test_fraction": 0.5, "params": {"logistic": {"C": 2.0}}})
    assert got["params"]["logistic"] == {"C": 2.0, "max_iter": 1000} and got["params"]["xgboost"] == abandon.CONFIG["params"]["xgboost"] and got["test_fraction"] == 0.5
    assert abandon.merged(abandon.CONFIG, None) == abandon.CONFIG


def test_model_is_saved_and_asked(spark, tmp_path):
    n = 60
    made = spark.range(n).select(F.col("id").cast("string").alias("session_id"), F.expr("TIMESTAMP_NTZ '2020-01-01 00:00:00' + make_dt_interval(0, 0, 0, id)").alias("start_time"), *[(F.col("id") % k).cast("int").alias(c) for k, c in enumerate(abandon.CONFIG["features"], 2)], (F.col("id") % 2 == 0).alias("abandoned")).withColumn("n_carts", F.lit(1))
    small = {"params": {"logistic": {"C": 1.0, "max_iter": 20}, "lightgbm": {"n_estimators": 3}}}
    boosted, quality_of = abandon.train(made, small, "lightgbm")
    abandon.save_model(boosted, str(tmp_path / "b"))
    assert 0 <= abandon.predict(spark, str(tmp_path / "b"), dict.fromkeys(abandon.CONFIG["features"], 1.0)) <= 1
    model, quality_of = abandon.train(made, small, "logistic")
    assert quality_of.first()["auc"] > 0.9
    path = str(tmp_path / "m")
    with pytest.raises(FileNotFoundError):
        abandon.predict(spark, path, {})
    abandon.save_model(model, path)
    assert 0 <= abandon.predict(spark, path, dict.fromkeys(abandon.CONFIG["features"], 1.0)) <= 1


def test_checks_find_what_is_broken(spark):
    bad = spark.createDataFrame([("a", 0, "x", 1), ("a", 1, "view", 7), (None, 2, None, None)], "k string, n int, e string, parent long")
    tree = spark.createDataFrame([(1, None)], schemas.CATEGORY_TREE)
    tests = (quality.not_null("t", "k"), quality.unique("t", "k"), quality.accepted_values("t", "e", schemas.EVENT_KINDS), quality.at_least("t", "n", 1), quality.relationship("t", "parent", "tree", "categoryid"))
    assert [r["violations"] for r in quality.run_checks({"t": bad, "tree": tree}, tests).collect()] == [1, 1, 1, 1, 1]
    assert (len(quality.SOURCE_CHECKS), len(quality.MART_CHECKS)) == (17, 20)


def test_freshness(spark):
    df = spark.createDataFrame([(datetime(2020, 1, 1),)], "_loaded_at timestamp")
    ages = [(datetime(2020, 1, 2), "pass"), (datetime(2020, 1, 2, 3), "warn"), (datetime(2020, 1, 4), "error")]
    assert [quality.freshness(df, "t", now).first()["status"] for now, _ in ages] == [s for _, s in ages]
