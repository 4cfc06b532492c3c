import numpy as np
import pytest
from pyspark.sql import functions as F

from rillwork.llm import nearest

KIND = "vec_id long, embedding array<float>, label int"


def table(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 0) for i, v in zip(ids, x, strict=True)], KIND).repartition(3)


def brute(x, ids, q, k):
    x = np.asarray(x, np.float32).astype(np.float64)
    d = np.sqrt(((x - x[ids.index(q)]) ** 2).sum(1))
    order = sorted((d[j], ids[j]) for j in range(len(ids)) if ids[j] != q)[:k]
    return [(i, s) for s, i in order]


def test_small_tables_are_exact_with_ties(spark):
    x = [[0, 1], [0, 1], [0, 1], [1, 0], [2, 0], [0.5, 0.5]]
    ids = [100, 7, 3, 200, 9, 300]
    rows = nearest.nearest(table(spark, x, ids), k=3).collect()
    for q in (100, 200, 300):
        got = [(r["vec_id"], r["score"]) for r in sorted(rows, key=lambda r: r["rank"]) if r["query_id"] == q]
        assert got == brute(x, ids, q, 3)


def test_what_takes_no_part(spark):
    x = [[1, 1], None, [0, 0], [1, None], [float("nan"), 1], [float("inf"), 1], [1, 2, 3], [2, 2], [3, 3]]
    rows = nearest.nearest(table(spark, x, [0, 1, 200, 3, 400, 5, 6, 7, None])).collect()
    assert [(r["query_id"], r["vec_id"], r["rank"]) for r in rows] == [(0, 7, 1)]
    assert nearest.nearest(table(spark, [])).count() == 0


def test_recall_with_a_large_group_of_copies(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((4000, 16))
    x[::3] = x[0]
    x[5::40] = x[5] + 0.01 * rng.standard_normal(x[5::40].shape)
    ids = list(range(len(x)))
    rows = nearest.nearest(table(spark, x, ids).withColumn("id", F.lit(1)).withColumn("part", F.lit(2)))
    got = {}
    for r in rows.collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    hit = total = 0
    for q in range(0, 4000, 100):
        want = brute(x, ids, q, 10)
        assert sorted(got[q]) == list(range(1, 11))
        hit += len({i for i, _ in want} & {i for i, _ in got[q].values()})
        total += 10
    assert hit / total >= 0.9
    of_copies = brute(x, ids, 300, 10)
    assert [got[300][k + 1] for k in range(10)] == of_copies


def test_probes_are_set_by_rows_outside_the_fit(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, 8))
    index = nearest.Index(nearest.Router(np.zeros(8), [np.zeros((8, 2)), np.zeros(2), np.zeros((2, 8)), np.zeros(8)]), 8)  # knows nothing
    rows = [(i, v, int(p)) for i, (v, p) in enumerate(zip(x.tolist(), rng.integers(0, 8, 3000), strict=True))]
    filed = spark.createDataFrame(rows, "id long, vec array<double>, part int").repartition(3)
    ids = np.arange(0, 3000, 30)
    assert nearest.probes_for(index, filed, ids, x[ids], 8) == 8
    true = nearest._nearest(x, ids, 10)
    ranks = np.sort(np.array([p for _, _, p in rows])[true].ravel())
    assert nearest.probes_for(index, filed, ids, x[ids], 8, 0.5) == ranks[int(np.ceil(0.5 * ranks.size)) - 1] + 1
    fitted = []
    monkeypatch.setattr(nearest, "fit", lambda sample, *a: fitted.append(sample) or nearest.Index(index.router, 8))
    monkeypatch.setattr(nearest, "probes_for", lambda index, filed, ids, x, dim: fitted.append(x) or 8)
    nearest.nearest(table(spark, x.astype(np.float32))).count()
    sample, held = ({v.tobytes() for v in y} for y in fitted)
    assert len(held) == nearest.HELD_OUT and len(sample) == 3000 - nearest.HELD_OUT and not sample & held


@pytest.mark.parametrize(("n", "clusters"), [(80, 0), (500, 0), (2000, 0), (2000, 40), (20_000, 200)])
def test_tables_of_any_size_are_partitioned(spark, monkeypatch, n, clusters):
    rng = np.random.default_rng(n)
    x = rng.standard_normal((n, 24)) if not clusters else rng.standard_normal((clusters, 24))[rng.integers(0, clusters, n)] + 0.2 * rng.standard_normal((n, 24))
    x, probed, real = x.astype(np.float32), [], nearest.probes_for
    monkeypatch.setattr(nearest, "probes_for", lambda index, *a: probed.append((index.parts, real(index, *a))) or probed[-1][1])
    got = {}
    for r in nearest.nearest(table(spark, x.tolist())).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = sum(len({i for i, _ in brute(x, list(range(n)), q, 10)} & got[q]) for q in range(0, n, 100))
    assert hit >= 0.9 * 10 * len(range(0, n, 100)) and sorted(got) == list(range(0, n, 100))
    parts, probes = probed[0]
    assert parts == nearest.parts_for(n) >= 2 and (not clusters or probes < parts / 2)


def test_partitions_are_balanced():
    x = np.random.default_rng(2).standard_normal((1024, 8))
    label = nearest.partition(nearest._nearest(x, np.arange(1024), 10), 8, np.random.default_rng(3))
    assert np.bincount(label).tolist() == [128] * 8
