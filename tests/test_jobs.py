"""Jobs over files: windows, reruns and days one by one give what a full rebuild gives."""

import random
from datetime import date, timedelta

import pytest

from rillwork.operators import abandon, events
from rillwork.plans import cli, jobs
from rillwork.plans.window import Days
from rillwork.sources import files, schemas
from rillwork.sources.jdbc import Database
from rillwork.sources.ledger import job, latest_runs
from rillwork.streaming import sessions as streaming

#: 2019-08-07 23:45 UTC, a quarter of an hour before the day ends.
NIGHT = 1_565_221_500_000
DAWN, NOON = NIGHT - 60_000_000, NIGHT + 43_200_000
D1, D2, D3 = (date(2019, 8, 7) + timedelta(k) for k in range(3))
TABLES = {"events": "timestamp,visitorid,event,itemid,transactionid", "item_properties_part1": "timestamp,itemid,property,value", "item_properties_part2": "timestamp,itemid,property,value", "category_tree": "categoryid,parentid"}
#: Visitor 41 stays over midnight, 42 comes in the morning of the first day, 43 buys on the second (a row that is there twice).
ROWS = {
    "events": [f"{NIGHT},41,view,501,", f"{NIGHT + 1_200_000},41,view,502,", f"{DAWN},42,view,502,", f"{NOON},43,transaction,502,77", f"{NOON},43,transaction,502,77"],
    "item_properties_part1": ["5,501,categoryid,31", "6,502,categoryid,32", "7,501,colour,blue"],
    "item_properties_part2": ["9,502,categoryid,33"],
    "category_tree": ["30,", "31,30", "32,30", "33,30"],
}


@pytest.fixture
def raw(tmp_path):
    for name, header in TABLES.items():
        (tmp_path / f"{name}.csv").write_text("\n".join([header, *ROWS[name]]) + "\n")
    return str(tmp_path)


def content(spark, lake, table):
    return sorted(str(r.asDict()) for r in lake.read(spark, table).drop("_loaded_at").collect())


def one_day(spark, lake, raw, day):
    days = Days(day, day + timedelta(1))
    jobs.bronze(spark, lake, raw, days)
    jobs.silver(spark, lake, days)
    jobs.build_sessions(spark, lake, days)
    jobs.gold(spark, lake, days)


def test_windows_land_half_open_and_again(spark, raw, tmp_path):
    lake = jobs.Lake(str(tmp_path / "lake"))
    assert jobs.bronze(spark, lake, raw) == 5
    assert jobs.bronze(spark, lake, raw, Days(D2)) == 3
    for _ in range(2):
        assert jobs.bronze(spark, lake, raw, Days(D1, D2)) == 2
        assert lake.read(spark, "bronze/events").count() == 5


def test_days_one_by_one_equal_a_full_rebuild(spark, raw, tmp_path):
    full, step = jobs.Lake(str(tmp_path / "full")), jobs.Lake(str(tmp_path / "step"))
    jobs.bronze(spark, full, raw)
    jobs.silver(spark, full)
    jobs.build_sessions(spark, full)
    jobs.gold(spark, full)
    one_day(spark, step, raw, D1)
    assert lake_sessions(spark, step) == {(f"41-{NIGHT}", 1), (f"42-{DAWN}", 1)}
    assert step.read(spark, "bronze/category_tree").count() == 4
    one_day(spark, step, raw, D2)
    one_day(spark, step, raw, D2)
    assert (f"41-{NIGHT}", 2) in lake_sessions(spark, step) and len(lake_sessions(spark, step)) == 3
    for table in ("bronze/events", "silver/events_enriched", "silver/sessions", "gold/raw_events", "gold/raw_sessions", "gold/cooccur_pairs", "gold/item_latest", "gold/pair_counts"):
        assert content(spark, step, table) == content(spark, full, table), table


def lake_sessions(spark, lake):
    return {(r["session_id"], r["event_count"]) for r in lake.read(spark, "gold/raw_sessions").collect()}


def test_a_window_tags_its_sessions_once_for_gold(spark, raw, tmp_path, monkeypatch):
    lake = jobs.Lake(str(tmp_path / "lake"))
    one_day(spark, lake, raw, D1)
    jobs.bronze(spark, lake, raw, Days(D2, D3))
    jobs.silver(spark, lake, Days(D2, D3))
    jobs.build_sessions(spark, lake, Days(D2, D3))
    made, tag = [], jobs.sessions.tag_sessions
    monkeypatch.setattr(jobs.sessions, "tag_sessions", lambda *a, **b: made.append(a) or tag(*a, **b))
    jobs.gold(spark, lake, Days(D2, D3))
    assert len(made) == 1


def test_a_window_takes_of_earlier_snapshots_the_newest_only(spark):
    rng, day, items = random.Random(4), 86_400_000, 7
    odd = ["x", None, "07", "7", "31", "4"]
    props = [(rng.choice([None, rng.randrange(9 * day), day * rng.randrange(9)]), rng.choice([None, *range(items)]), rng.choice(["categoryid"] * 3 + ["available"]), rng.choice(odd)) for _ in range(3000)]
    seen = [(rng.choice([rng.randrange(6 * day, 8 * day), 6 * day, 7 * day]), k, "view", rng.choice([None, *range(items + 1)]), None) for k in range(400)]
    properties, window = spark.createDataFrame(props, schemas.ITEM_PROPERTIES), (date(1970, 1, 7), date(1970, 1, 9))
    fresh = spark.createDataFrame(seen, schemas.EVENTS)
    few = events.known_between(properties, *window)
    assert sorted(map(str, events.point_in_time_category(fresh, few).collect())) == sorted(map(str, events.point_in_time_category(fresh, properties).collect()))
    inside = sum(r[0] is not None and 6 * day <= r[0] < 8 * day and r[2] == "categoryid" for r in props)
    assert few.count() == inside + items < len(props) / 3


def test_days_out_of_order_leave_nothing_stale(spark, raw, tmp_path):
    lake = jobs.Lake(str(tmp_path / "lake"))
    for day in (D2, D1, D2):
        one_day(spark, lake, raw, day)
    assert lake_sessions(spark, lake) == {(f"41-{NIGHT}", 2), (f"42-{DAWN}", 1), (f"43-{NOON}", 1)}


def test_daily_run_with_marts_checks_and_ledger(spark, raw, tmp_path):
    lake, ledger = jobs.Lake(str(tmp_path / "lake")), str(tmp_path / "runs")
    for day in (D1, D2):
        checks = jobs.daily(spark, lake, raw, day, ledger)
    assert sum(r["violations"] for r in checks.collect()) == 0 and checks.count() == 37
    want = sorted([(31, D1, 1), (33, D1, 1), (33, D2, 1)])
    assert sorted((r["categoryid"], r["event_date"], r["views"]) for r in lake.read(spark, "marts/fct_funnel").collect()) == want
    jobs.build_marts(spark, lake, full=True)
    assert sorted((r["categoryid"], r["event_date"], r["views"]) for r in lake.read(spark, "marts/fct_funnel").collect()) == want
    assert [r["status"] for r in latest_runs(spark.read.parquet(ledger)).collect()] == ["success"] * 5


def test_windows_of_several_days():
    assert Days(D1, D3).each(5) == [Days(D1, D3)]
    assert Days(D1, D3 + timedelta(1)).each(2) == [Days(D1, D3), Days(D3, D3 + timedelta(1))]


def test_windows_are_validated(spark, tmp_path):
    lake = jobs.Lake(str(tmp_path))
    with pytest.raises(ValueError):
        Days(D2, D1)
    with pytest.raises(ValueError):
        jobs.build_sessions(spark, lake, Days(until=D2))
    with pytest.raises(ValueError):
        jobs.gold(spark, lake, Days(since=D1))


def test_a_failed_job_is_logged_and_raised(spark, tmp_path):
    told = []
    with pytest.raises(KeyError):
        with job(spark, "t", str(tmp_path / "runs"), lambda *a: told.append(a)):
            raise KeyError("x")
    assert spark.read.parquet(str(tmp_path / "runs")).first()["status"] == "failed" and told[0][0] == "t"


def test_a_database_keeps_its_table(spark):
    db = Database("jdbc:derby:memory:gold;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    one = spark.createDataFrame([(1, "a")], "id long, name string")
    db.replace(one, "t")
    db.append(one, "t")
    assert db.read(spark, "t").count() == 2
    db.replace(one, "t")
    assert db.read(spark, "t").count() == 1


def test_streamed_sessions_are_those_of_the_batch(spark, raw, tmp_path):
    at = str(tmp_path / "in")
    t = [(NIGHT, 1), (NIGHT + 600_000, 1), (NIGHT + 90_000_000, 2), (NIGHT + 400_000_000, 3)]
    spark.createDataFrame([(x, v, "view", 1, None) for x, v in t], "timestamp long, visitorid long, event string, itemid long, transactionid long").write.parquet(at)
    stream = spark.readStream.schema(spark.read.parquet(at).schema).parquet(at)
    streaming.start(streaming.stream_sessions(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = {(r["session_id"], r["event_count"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(f"1-{NIGHT}", 2), (f"2-{NIGHT + 90_000_000}", 1)}


def test_path_probe(spark, tmp_path):
    assert files.exists(spark, str(tmp_path)) and not files.exists(spark, str(tmp_path / "none"))


def test_backfill_and_weekly(spark, raw, tmp_path):
    lake, ledger = jobs.Lake(str(tmp_path / "lake")), str(tmp_path / "runs")
    jobs.backfill(spark, lake, raw, Days(D1, D3), ledger)
    assert lake_sessions(spark, lake) == {(f"41-{NIGHT}", 2), (f"42-{DAWN}", 1), (f"43-{NOON}", 1)}
    assert spark.read.parquet(ledger).count() == 10
    visits = [f"{DAWN + k * 7_200_000},{50 + k},{e},{501 + i},{k if e == 'transaction' else ''}" for k in range(40) for i in range(2) for e in ("view", "addtocart", *(["transaction"] if k % 3 else []))]
    (tmp_path / "events.csv").write_text("\n".join([TABLES["events"], *visits]) + "\n")
    jobs.bronze(spark, lake, raw)
    jobs.silver(spark, lake)
    jobs.build_sessions(spark, lake)
    small = {"params": {"xgboost": {"n_estimators": 2, "max_depth": 2, "learning_rate": 0.1}, "random_forest": {"n_estimators": 2, "max_depth": 2}, "logistic": {"C": 1.0, "max_iter": 5}}}
    assert [r["algorithm"] for r in jobs.weekly(spark, lake, ledger, small).collect()] == ["xgboost", "random_forest", "logistic"]
    found = lake.read(spark, "gold/item_recommendations")
    assert {r["method"] for r in found.select("method").distinct().collect()} == {"als", "item2vec"} and found.count() == 4
    assert {r["task_name"] for r in spark.read.parquet(ledger).collect()} >= {"train_als", "train_item2vec", "feature_gold", "marts"}
    assert jobs.recommendations(spark, lake, "als", rank=2, iterations=1) == 2

    config = tmp_path / "config.yaml"
    config.write_text("algorithm: logistic\ntest_fraction: 0.5\nparams:\n  logistic:\n    max_iter: 4\n")
    assert [r["algorithm"] for r in cli.main(["train", "--lake", lake.root, "--config", str(config)]).collect()] == ["logistic"]
    assert files.exists(spark, lake.at("models/logistic")) and abandon.load_config(str(config))["params"]["logistic"] == {"C": 1.0, "max_iter": 4}
    last = spark.read.parquet(lake.at("pipeline_runs")).where("task_name = 'train'").first()
    assert (last["status"], last["rows_processed"]) == ("success", 1)


def test_the_command_line_runs_the_jobs(spark, raw, tmp_path):
    root = str(tmp_path / "lake")
    own = ["--lake", root, "--raw-dir", raw, "--no-log"]
    assert cli.main(["daily", *own, "--since", str(D1)]).count() == 37
    cli.main(["backfill", *own, "--since", str(D2), "--until", str(D3)])
    assert len(lake_sessions(spark, jobs.Lake(root))) == 3
    for one in ("bronze", "silver", "sessions", "gold", "marts"):
        cli.main([one, *own])
    assert sum(r["violations"] for r in cli.main(["checks", *own]).collect()) == 0
    assert not files.exists(spark, f"{root}/pipeline_runs")
    with pytest.raises(SystemExit):
        cli.main(["unknown", "--lake", root])


def test_a_database_from_the_environment(monkeypatch):
    for name, value in {"DB_URL": "jdbc:x:y", "DB_USER": "u", "DB_DRIVER": "d"}.items():
        monkeypatch.setenv(name, value)
    monkeypatch.delenv("DB_PASSWORD", raising=False)
    assert Database.from_env() == Database("jdbc:x:y", {"user": "u", "driver": "d"})
    monkeypatch.delenv("DB_URL")
    with pytest.raises(KeyError):
        Database.from_env()
