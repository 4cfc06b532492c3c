"""Boosted trees against brute force on small data."""

import math
import random

import numpy as np
import pytest

from rillwork.operators import abandon, boosting
from rillwork.plans import queries

SCHEMA = "a double, b double, label int"


def data(n, seed=0):
    rng = random.Random(seed)
    rows = [(float(rng.randint(0, 9)), rng.choice([None, *map(float, range(5))])) for _ in range(n)]
    return [(a, b, int(rng.random() < (0.9 if (a > 4) != ((b or 0) > 2) else 0.1))) for a, b in rows]


def brute_tree(rows, margin, how):
    """Every split of every leaf tried, the best leaf first; returns the weight that each row gets."""
    x = np.array([[a, -math.inf if b is None else b] for a, b, _ in rows])
    y = np.array([r[2] for r in rows])
    p = 1 / (1 + np.exp(-margin))
    g, h = p - y, p * (1 - p)
    value = lambda m: g[m].sum() ** 2 / (h[m].sum() + how.l2)

    def best(m):
        found = (1e-9, None)
        for f in range(2):
            for t in sorted(set(x[m, f]))[:-1]:
                left, right = m & (x[:, f] <= t), m & (x[:, f] > t)
                gain = (value(left) + value(right) - value(m)) / 2
                if min(h[left].sum(), h[right].sum()) >= how.least_hessian and min(left.sum(), right.sum()) >= how.least_rows and gain > found[0] + 1e-12:
                    found = (gain, (left, right))
        return found

    leaves = [(np.ones(len(rows), bool), 0)]
    while not how.leaves or len(leaves) < how.leaves:
        open_ = [(best(m), k) for k, (m, d) in enumerate(leaves) if not how.max_depth or d < how.max_depth]
        open_ = [(gain, k, parts) for (gain, parts), k in open_ if parts]
        if not open_:
            break
        _, k, parts = max(open_, key=lambda o: o[0])
        _, depth = leaves.pop(k)
        leaves += [(m, depth + 1) for m in parts]
    out = np.zeros(len(rows))
    for m, _ in leaves:
        out[m] = -g[m].sum() / (h[m].sum() + how.l2) * how.rate
    return out


@pytest.mark.parametrize("how", [boosting.Settings(3, 0.3, 3), boosting.Settings(3, 0.3, 0, leaves=6, l2=0.1, least_hessian=1e-3, least_rows=5, from_mean=True), boosting.Settings(12, 0.2, 2, l2=2.0)])
def test_equal_to_brute_force(spark, how):
    rows = data(300)
    model = boosting.fit(spark.createDataFrame(rows, SCHEMA).repartition(3), ["a", "b"], how)
    share = np.mean([r[2] for r in rows])
    margin = np.full(len(rows), math.log(share / (1 - share)) if how.from_mean else 0.0)
    for _ in range(how.trees):
        margin = margin + brute_tree(rows, margin, how)
    want = {(a, b): 1 / (1 + math.exp(-m)) for (a, b, _), m in zip(rows, margin, strict=True)}
    for r in model.score(spark.createDataFrame(rows, SCHEMA)).collect():
        assert abs(r["score"] - want[r["a"], r["b"]]) < 1e-6
    assert all(len([n for n in t if n[0] < 0]) <= (how.leaves or 2**how.max_depth) for t in model.trees)


def test_both_boosters_differ_and_are_saved(spark, tmp_path):
    rows = spark.createDataFrame(data(800, 3), SCHEMA)
    params = {"n_estimators": 2, "max_depth": 2, "learning_rate": 0.2}
    one = boosting.fit(rows, ["a", "b"], abandon.booster("xgboost", params))
    other = boosting.fit(rows, ["a", "b"], abandon.booster("lightgbm", params | {"max_depth": -1}))
    assert max(len(t) for t in other.trees) > max(len(t) for t in one.trees)
    other.save(spark, str(tmp_path / "m"))
    again = boosting.Boosted.load(spark, str(tmp_path / "m"))
    assert [r["score"] for r in again.score(rows).collect()] == [r["score"] for r in other.score(rows).collect()]


def test_one_class_and_no_rows(spark):
    model = boosting.fit(spark.createDataFrame([(1.0, 1.0, 1)] * 5, SCHEMA), ["a", "b"], boosting.Settings(2))
    assert all(len(t) == 1 for t in model.trees)
    assert model.score(spark.createDataFrame([(None, None, 1)], SCHEMA)).first()["score"] > 0.5
    with pytest.raises(ValueError):
        boosting.fit(spark.createDataFrame([], SCHEMA), ["a", "b"], boosting.Settings(2))


@pytest.mark.parametrize("most", [0, 20])
@pytest.mark.parametrize("how", [boosting.Settings(2, 0.3, 4, l2=0.5), boosting.Settings(2, 0.3, 0, leaves=9, l2=0.1, least_hessian=1e-3, least_rows=5, from_mean=True)])
def test_histograms_and_cells_give_one_tree(spark, monkeypatch, how, most):
    rows = spark.createDataFrame(data(500, 5), SCHEMA).repartition(3)
    want = boosting.fit(rows, ["a", "b"], how).trees  # so few cells are all sent as they are
    monkeypatch.setattr(boosting, "_few", lambda count, _: count <= most)
    monkeypatch.setattr(boosting, "TASK", 20)
    monkeypatch.setattr(boosting, "KEEP", 1)
    got = boosting.fit(rows, ["a", "b"], how).trees
    assert max(len(t) for t in want) > 9 and [len(t) for t in got] == [len(t) for t in want]
    for one, other in zip(got, want, strict=True):
        np.testing.assert_allclose(np.array(one), np.array(other), rtol=1e-9)


def test_a_tree_over_few_cells_is_one_pass(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(boosting, "_looked_up", lambda *a, real=boosting._looked_up: calls.append(1) or real(*a))
    model = boosting.fit(spark.createDataFrame(data(300), SCHEMA), ["a", "b"], boosting.Settings(12, 0.1, 5))
    assert len(model.trees) == len(calls) == 12 and max(len(t) for t in model.trees) > 20


def test_nan_is_missing(spark):
    rows = [(k % 10 / 1.0, 1.0, int(k % 10 > 4)) for k in range(100)]
    of = lambda gap: boosting.fit(spark.createDataFrame([*rows, *[(gap, 1.0, 0)] * 30], SCHEMA), ["a", "b"], boosting.Settings(3, 0.3, 3))
    assert of(math.nan).trees == of(None).trees


def test_the_query_trains_with_all_settings(spark, monkeypatch):
    seen = {}

    def trained(sessions, config=None, algorithm=None, parts=None):
        seen[algorithm] = abandon.merged(abandon.CONFIG, config)
        return None, spark.createDataFrame([(algorithm,)], "algorithm string")

    monkeypatch.setattr(abandon, "train", trained)
    monkeypatch.setattr(abandon, "parted", lambda *_: None)
    queries._trained(type("M", (), {"feature_sessions": None}))
    assert set(seen) == {"xgboost", "lightgbm", "random_forest", "logistic"} and all(c == abandon.CONFIG for c in seen.values())
