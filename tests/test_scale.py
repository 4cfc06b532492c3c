"""What must hold however a key, a basket, a score or a write is: no task takes it all, and results are whole."""

import itertools
import math
import random
from collections import Counter
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillwork.functions import shared
from rillwork.operators import abandon, pairs, quality, recommend, sessions
from rillwork.sources import schemas, versions
from rillwork.streaming import sessions as streaming

EVENTS = schemas.EVENTS
T = 1_600_000_000_000


def brute_sessions(rows, timeout_ms):
    out = {}
    for who in {r[1] for r in rows}:
        start = last = None
        for k, t in sorted(((k, r[0]) for k, r in enumerate(rows) if r[1] == who), key=lambda x: x[1]):
            start = t if last is None or t - last > timeout_ms else start
            out[k], last = f"{who}-{start}" if who is not None else str(start), t
    return sorted(out.values())


@pytest.mark.parametrize("piece", [1000, 90_000, 10**9])
def test_sessions_go_on_over_pieces(spark, piece):
    rng = random.Random(3)
    rows = [(T + rng.randint(0, 3_000_000), rng.choice([1, 2, None]), "view", 1, None) for _ in range(400)] + [(T + 60_000 * k, 7, "view", 1, None) for k in range(60)]
    got = sessions.tag_sessions(spark.createDataFrame(rows, EVENTS).repartition(3), 60, piece)
    assert sorted(r["session_id"] for r in got.collect()) == brute_sessions(rows, 60_000)


def test_a_busy_visitor_is_spread_over_tasks(spark):
    day = 86_400_000
    rows = spark.range(30_000).select((F.lit(T) + F.col("id") * (90 * day // 30_000)).alias("timestamp"), F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") + 2).cast("long").alias("visitorid"), F.lit("view").alias("event"), F.lit(1).cast("long").alias("itemid"), F.lit(None).cast("long").alias("transactionid"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tagged = sessions.tag_sessions(rows).where("visitorid = 1")
        shares = [r["n"] for r in tagged.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(shares) == 10_000 and max(shares) < 5_000


def brute_pairs(rows, support):
    of = {}
    for g, i in rows:
        if i is not None:
            of.setdefault(g, set()).add(i)
    met = Counter(p for items in of.values() for p in itertools.combinations(sorted(items), 2))
    return {(a, b, n) for (a, b), n in met.items() if n >= support}


@pytest.mark.parametrize("block", [1, 7, 256])
def test_pairs_by_blocks(spark, block):
    rng = random.Random(5)
    rows = [(rng.choice("abcde"), rng.choice([None, *range(40)])) for _ in range(300)] + [("big", k) for k in range(60)]
    df = spark.createDataFrame(rows, "g string, i long")
    for support in (1, 2, 3):
        got = pairs.pair_support(df, ["g"], "i", support, block)
        assert {tuple(r) for r in got.select("item_a", "item_b", "weight").collect()} == brute_pairs(rows, support)


def test_a_session_of_twenty_thousand_items(spark):
    big = spark.range(20_000).select(F.lit("big").alias("g"), F.col("id").alias("i"))
    other = spark.createDataFrame([("x", k) for k in range(0, 20_000, 40)], "g string, i long")
    df = big.unionByName(other)
    assert pairs.pair_support(df, ["g"], "i").count() == math.comb(500, 2)
    blocks = -(-20_000 // pairs.BLOCK)
    sizes = big.groupBy(F.pmod(F.xxhash64("i"), F.lit(blocks))).count().agg(F.max("count")).first()[0]
    assert sizes < 2 * pairs.BLOCK  # so no key holds more than some BLOCK squared pairs


def test_partitions_of_pairs_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(pairs, "ROWS", 1000)
    seen = []
    monkeypatch.setattr(pairs, "cut", lambda df, **how: seen.append(how.get("parts")) or shared.cut(df, **how))
    lines = spark.range(40_000).select(F.floor(F.col("id") / 4).alias("g"), (F.col("id") % 400).alias("i"))
    found = pairs.pair_support(lines, ["g"], "i")
    assert seen == [None, 40, 40]
    assert {tuple(r) for r in found.collect()} == {(4 * k + a, 4 * k + b, 100) for k in range(100) for a in range(4) for b in range(a + 1, 4)}
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4" and spark.conf.get("spark.sql.files.maxPartitionBytes") == "134217728b"


def clustered(n, centres, dim=24, spread=0.05, seed=1):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((centres, dim))
    return [(k, (c[k % centres] + spread * rng.standard_normal(dim)).tolist()) for k in range(n)]


def brute_neighbours(rows, n, digits):
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    score = np.round(x @ x.T, digits)
    ids = np.array([i for i, _ in rows])
    out = set()
    for k, row in enumerate(score):
        near = [j for j in np.lexsort((ids, -row)) if j != k][:n]
        out |= {(int(ids[k]), int(ids[j]), r) for r, j in enumerate(near, 1)}
    return out


@pytest.mark.parametrize(("rows", "pivots"), [(clustered(600, 12), 12), (clustered(300, 300), 8), (clustered(90, 3) + [(1000 + k, [1.0] * 24) for k in range(60)], 5)])
def test_neighbours_with_skipped_parts_are_exact(spark, rows, pivots, monkeypatch):
    monkeypatch.setattr(recommend, "BLOCK", 40)
    report = {}
    got = recommend.top_n_neighbors(spark.createDataFrame([*rows, (99_999, [0.0] * 24)], "id long, vec array<double>"), 5, 6, pivots, report)
    assert {(r["item_id"], r["rec_item_id"], r["rank"]) for r in got.collect()} == brute_neighbours(rows, 5, 6)
    assert report["skipped"] > 0.8 or len(rows) != 600


@pytest.mark.parametrize("pivots", [1, 8])
def test_neighbours_of_asked_items_only(spark, pivots, monkeypatch):
    monkeypatch.setattr(recommend, "BLOCK", 40)
    data = clustered(300, 30)
    got = recommend.top_n_neighbors(spark.createDataFrame(data, "id long, vec array<double>"), 5, 6, pivots, of=[7, 11, 999])
    assert {(r["item_id"], r["rec_item_id"], r["rank"]) for r in got.collect()} == {r for r in brute_neighbours(data, 5, 6) if r[0] in (7, 11)}


def test_copies_of_vectors_are_compared_once(spark, monkeypatch):
    monkeypatch.setattr(recommend, "BLOCK", 40)
    few = clustered(150, 150)
    data = [(i * 7 + c * 10_000 - 5, v) for i, v in few for c in range(1 + 9 * (i % 3))]
    for pivots in (1, 4):
        report = {}
        got = recommend.top_n_neighbors(spark.createDataFrame(data, "id long, vec array<double>"), 5, 6, pivots, report)
        assert {(r["item_id"], r["rec_item_id"], r["rank"]) for r in got.collect()} == brute_neighbours(data, 5, 6)
        assert report["compared"] == 150 and len(data) == 1500


def test_neighbours_where_ids_repeat(spark):
    data = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.9, 0.1]), (2, [0.0, 1.0]), (3, [1.0, 0.0])]
    got = recommend.top_n_neighbors(spark.createDataFrame(data, "id long, vec array<double>"), 2, 6)
    assert sorted((r["item_id"], r["rank"], r["rec_item_id"]) for r in got.collect()) == [(1, 1, 3), (1, 2, 3), (2, 1, 1), (2, 2, 1), (3, 1, 1), (3, 2, 1)]


def test_equal_sessions_are_scored_once(spark, monkeypatch):
    rng, seen = random.Random(3), []
    features = abandon.CONFIG["features"]
    data = [(f"s{k}", k, *(float(rng.randint(0, 1)) for _ in features[:3]), 1.0, 1.0, 1.0, 1.0, rng.random() < 0.3) for k in range(1200)]
    rows = spark.createDataFrame(data, ["session_id", "start_time", *features, "abandoned"])
    monkeypatch.setattr(abandon, "score", lambda model, r, real=abandon.score: seen.append(r.count()) or real(model, r))
    model, got = abandon.train(rows, None, "logistic")
    assert seen[0] <= 16  # two labels of eight vectors, not 240 sessions
    later = abandon.parted(rows).where("NOT is_train")
    assert got.drop("algorithm").first() == abandon.metrics(abandon.score(model, later)).first()


def test_the_forest_is_spread_over_tasks(spark, tmp_path):
    spark.range(9000).coalesce(1).write.parquet(str(tmp_path / "r"))
    rows = spark.read.parquet(str(tmp_path / "r"))
    assert rows.rdd.getNumPartitions() == 1
    assert abandon._dealt(rows, 9000).rdd.glom().map(len).collect() == [1800] * 5
    assert abandon._dealt(rows, 10**9).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism


def test_crowded_values_are_ordered_in_parts(spark):
    rng = random.Random(2)
    data = [(0.5 + rng.randint(0, 900) / 1e6, int(rng.random() < 0.3)) for _ in range(3000)]
    got = abandon.metrics(spark.createDataFrame(data, "score double, label int")).first()["auc"]
    pos, neg = (np.array([s for s, y in data if y == k]) for k in (1, 0))
    assert abs(got - ((pos[:, None] > neg).mean() + (pos[:, None] == neg).mean() / 2)) < 1e-4
    one_time = spark.range(1000).select(F.format_string("%04d", F.col("id") % 400).alias("session_id"), F.expr("TIMESTAMP_NTZ '2020-01-01 00:00:00'").alias("start_time"))
    split = [(r["session_id"], r["is_train"]) for r in abandon.time_split(one_time, 0.3).collect()]
    assert sum(t for _, t in split) == 700 and max(s for s, t in split if t) <= min(s for s, t in split if not t)


def test_long_sessions_have_rows_of_bounded_length(spark):
    n = 5000
    ev = spark.range(n).select((F.lit(T) + F.col("id") * 60_000).alias("timestamp"), F.lit(1).cast("long").alias("visitorid"), F.lit("view").alias("event"), F.col("id").alias("itemid"), F.lit(None).cast("long").alias("transactionid"))
    got = recommend.item_chunks(ev, longest=300).orderBy("chunk").collect()
    assert [len(r["items"]) for r in got] == [300] * 16 + [200] and [int(i) for r in got for i in r["items"]] == list(range(n))


def test_checks_scan_each_table_once(spark, tmp_path):
    for name in ("a", "b"):
        spark.createDataFrame([(1, "x"), (1, None), (3, "y")], "k long, v string").write.parquet(f"{tmp_path}/{name}")
    t = {name: spark.read.parquet(f"{tmp_path}/{name}") for name in ("a", "b")}
    tests = (quality.not_null("a", "v"), quality.unique("a", "k"), quality.at_least("a", "k", 2), quality.accepted_values("a", "v", ("x",)), quality.relationship("a", "k", "b", "k"), quality.relationship("a", "v", "b", "k"), quality.unique("b", "k"), quality.not_null("b", "k"))
    df = quality.run_checks(t, tests)
    got = {(r["check_name"], r["table_name"], r["column_name"]): r["violations"] for r in df.collect()}
    assert [got[c.name, c.table, c.column] for c in tests] == [1, 1, 2, 1, 0, 2, 1, 0]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2


def days(spark, rows):
    return spark.createDataFrame(rows, "d date, v long")


def values(spark, path):
    return sorted((str(r["d"]), r["v"]) for r in versions.read(spark, path).collect())


def test_a_window_is_switched_in_one_step(spark, tmp_path):
    path, d1, d2, d3 = str(tmp_path / "t"), *(date(2021, 3, k) for k in (1, 2, 3))
    assert versions.replace(days(spark, [(d1, 1), (d2, 2), (None, 9)]), path, "d") == 3
    old = values(spark, path)
    staged = versions.stage(days(spark, [(d2, 20), (d3, 30)]), path, "d")
    assert values(spark, path) == old  # the writer may fail here: nothing has changed
    versions.commit(spark, staged, [d1, d2], {"why": "test"})
    assert values(spark, path) == [("2021-03-02", 20), ("2021-03-03", 30), ("None", 9)]
    assert versions.read(spark, path).where(F.col("d") == d3).count() == 1
    assert versions.manifest(spark, path).notes == {"why": "test"}
    assert versions.read(spark, path, versions.manifest(spark, path, 1)).count() == 3
    stale = versions.manifest(spark, path, 1)
    with pytest.raises(FileExistsError):
        versions._put(spark, path, versions.Manifest(2, "d", stale.schema, {}))
    assert versions.replace(days(spark, []), path, "d", [d2]) == 0 and len(values(spark, path)) == 2
    assert versions.vacuum(spark, path, 1) == 1 and len(values(spark, path)) == 2
    assert versions.replace(days(spark, []), path, "d") == 0 and values(spark, path) == []


def session_rows(spark, root):
    return sorted((r["session_id"], r["event_count"]) for r in versions.read(spark, f"{root}/sessions").collect())


def test_late_events_and_replayed_batches(spark, tmp_path):
    root, minute = str(tmp_path / "s"), 60_000
    at = lambda *rows: spark.createDataFrame([(T + m * minute, v, "view", 1, None) for m, v in rows], EVENTS)
    run = streaming.upsert(root)
    run(at((0, 1), (50, 1), (10, 2), (2000, 3)), 0)
    assert session_rows(spark, root) == sorted([(f"1-{T}", 1), (f"1-{T + 50 * minute}", 1), (f"2-{T + 10 * minute}", 1), (f"3-{T + 2000 * minute}", 1)])
    run(at((25, 1)), 1)  # late: joins both of visitor 1
    healed = sorted([(f"1-{T}", 3), (f"2-{T + 10 * minute}", 1), (f"3-{T + 2000 * minute}", 1)])
    assert session_rows(spark, root) == healed
    number = versions.manifest(spark, f"{root}/sessions").number
    run(at((25, 1)), 1)  # replayed after its commit
    assert session_rows(spark, root) == healed and versions.manifest(spark, f"{root}/sessions").number == number
    run(at((25, 1), (0, 1)), 2)  # the same events again
    assert session_rows(spark, root) == healed


def test_a_batch_that_failed_before_its_commit_is_done_again(spark, tmp_path, monkeypatch):
    root, rows = str(tmp_path / "s"), spark.createDataFrame([(T, 1, "view", 1, None)], EVENTS)
    real = versions.replace
    monkeypatch.setattr(versions, "replace", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        streaming.upsert(root)(rows, 0)
    monkeypatch.setattr(versions, "replace", real)
    streaming.upsert(root)(rows, 0)
    assert session_rows(spark, root) == [(f"1-{T}", 1)]


def test_a_stream_is_upserted(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "s")
    for k, t in enumerate((0, 3_000_000, 1_500_000)):
        spark.createDataFrame([(T + t, 1, "view", 1, None), (T + t, 2 + k, "transaction", 1, k)], EVENTS).write.mode("append").parquet(source)
        stream = spark.readStream.schema(EVENTS).parquet(source)
        streaming.start_upsert(stream, root, str(tmp_path / "cp")).awaitTermination(120)
    assert (f"1-{T}", 3) in session_rows(spark, root) and len(session_rows(spark, root)) == 4


def test_pairs_are_retracted_and_added(spark, tmp_path):
    from rillwork.plans import jobs
    from rillwork.plans.window import Days

    lake, day, first = jobs.Lake(str(tmp_path), min_support=1), 86_400_000, date(2020, 9, 13)
    seen = lambda rows: spark.createDataFrame([(T + d * day + m * 60_000, v, "view", i, None, first + timedelta(d), None) for d, m, v, i in rows], f"{EVENTS}, event_date date, categoryid long")
    one = [(0, 0, 1, 10), (0, 5, 1, 20), (1, 0, 2, 10), (1, 1, 2, 20), (1, 2, 2, 30)]
    for rows in (one, [*one[:3], (1, 1, 2, 40)], [*one, (2, 0, 3, 10), (2, 0, 3, 30)]):
        versions.replace(seen(rows), lake.at("silver/events_enriched"), "event_date")
        for d in (1, 2):
            jobs.keep_pairs(spark, lake, Days(first + timedelta(d), first + timedelta(d + 1)))
        got = {(r["item_a"], r["item_b"], r["weight"]) for r in lake.read(spark, "gold/cooccur_pairs").collect()}
        assert got == brute_pairs([((v, d), i) for d, _, v, i in rows], 1)


def test_keys_of_checks_are_shuffled_once(spark, tmp_path):
    spark.range(500).select((F.col("id") % 400).alias("k")).write.parquet(f"{tmp_path}/t")
    df = quality.run_checks({"t": spark.read.parquet(f"{tmp_path}/t")}, (quality.unique("t", "k"),))
    assert df.first()["violations"] == 100
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 2  # by key, and by check
