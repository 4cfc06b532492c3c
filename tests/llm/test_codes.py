import hashlib
import random

import numpy as np
import pytest

from rillwork.llm import vector_codes as c

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, entries=c.ENTRIES, rounds=c.ROUNDS):
    """Python's integers, every entry compared."""
    kept = [(i, [int(n * 1024 // d) for n, d in map(float.as_integer_ratio, v)], y) for i, v, y in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: r[0])
    width = len(kept[0][1]) // 4
    parts = [[v[p * width : (p + 1) * width] for _, v, _ in kept] for p in range(4)]
    books = [[list(x) for x in of[:entries]] for of in parts]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            of = {}
            for x in parts[p]:
                of.setdefault(near(x, book)[1], []).append(x)
            books[p] = [[sum(col) // len(of[k]) for col in zip(*of[k], strict=True)] if k in of else e for k, e in enumerate(book)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [[near(parts[p][r], books[p]) for p in range(4)] for r in range(len(kept))]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for (_, _, y), e in zip(kept, errors, strict=True):
        by_label[y] = by_label.get(y, 0) + e
    most = (1 << 63) - 1
    return sorted((i, "".join(f"{k:02x}" for _, k in f), min(e, most), min(by_label[y], most), digest) for (i, _, y), f, e in zip(kept, found, errors, strict=True))


def made(n, dim=16, seed=0, near=8):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(near)]
    return [(k, [x + rng.gauss(0, 0.2) for x in centres[k % near]], None if k % 7 == 0 else k % 3) for k in range(n)]


def got(spark, rows, **kw):
    return sorted(tuple(r) for r in c.encode(spark.createDataFrame(rows, SCHEMA).repartition(3), **kw)[0].collect())


@pytest.mark.parametrize(("n", "entries"), [(600, 256), (300, 16), (40, 256), (1, 256)])
def test_equal_to_brute_force(spark, n, entries):
    rows = made(n)
    assert got(spark, rows, entries=entries) == brute(rows, entries)


def test_odd_vectors(spark):
    rows = made(120) + [(500, None, 1), (501, [None] * 16, 1), (502, [float("nan")] * 16, 1), (503, [float("-inf")] + [0.0] * 15, 1), (504, [0.0] * 16, None), (505, [-0.0001] * 16, 2)]
    rows += [(600 + k, made(1)[0][1], 1) for k in range(50)]  # copies
    assert got(spark, rows, entries=32) == brute(rows, 32)


def test_large_components_are_exact(spark):
    rows = [(k, [x * 10 ** (k % 12) for x in v], y) for k, v, y in made(60)] + [(99, [1e300] * 16, 1), (100, [-1e300] * 16, 1)]
    rows = [(k, v, y) for k, v, y in rows if max(map(abs, v)) < 1e15]
    assert got(spark, rows, entries=8, rounds=2) == brute(rows, 8, 2)


def test_bounds_hold_and_spare_comparisons():
    rng = np.random.default_rng(1)
    entries = rng.integers(-500, 500, (256, 16))
    cells, x = c.Cells(entries), entries[rng.integers(0, 256, 2000)] + rng.integers(-60, 60, (2000, 16))
    best, error = cells.nearest(x)
    true = ((x[:, None] - entries) ** 2).sum(2)
    assert (best == true.argmin(1)).all() and (error == true.min(1)).all()
    below, above = cells.low - x[:, :, None], x[:, :, None] - cells.high
    lower = (np.maximum(np.maximum(below, above), 0).reshape(2000, -1).astype(float) ** 2) @ cells.chosen
    upper = (np.maximum(abs(below), abs(above)).reshape(2000, -1).astype(float) ** 2) @ cells.chosen
    assert (lower <= true).all() and (upper >= true).all()
    assert (lower <= upper.min(1)[:, None]).mean() < 0.2


def test_empty_other_dimensions_and_clashing_columns(spark):
    assert got(spark, []) == [] == got(spark, [(1, None, 1)])
    rows = made(30)
    assert got(spark, rows + [(77, [1.0, 2.0, 3.0, 4.0], 1)]) == brute(rows)
    with pytest.raises(ValueError):
        got(spark, [(1, [1.0, 2.0], 1)])
    df = spark.createDataFrame([(i, v, y, "a", 1) for i, v, y in rows], SCHEMA + ", code string, id int").withColumnRenamed("label", "of`x")
    assert sorted(tuple(r) for r in c.encode(df, label_col="of`x")[0].collect()) == brute(rows)
    same = [(5, v, y) for _, v, y in rows] + [(None, rows[0][1], 1)]
    assert len(got(spark, [r for r in same if r[0]])) == 30
    assert c.encode(spark.createDataFrame(same, SCHEMA))[0].count() == 31
