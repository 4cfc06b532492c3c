"""Approximate nearest neighbours by learned partitions.

1. From a bounded sample a neighbour graph is built and cut into balanced partitions by recursive bisection: each half is
   the side of the median along the graph's slowest mode, improved by swapping nodes that have more neighbours across.
2. A small classifier (one hidden layer) learns the partition of a vector. Every row is filed under its most probable one.
3. A query goes to its most probable partitions. Their number is the least that finds TARGET of the true neighbours of
   HELD_OUT rows that the fit hasn't seen; these neighbours are found among all rows, in one scan.
4. In each partition queries and candidates meet in blocks of bounded size, compared with exact distances, and each
   query's best are merged.

Partitions with many rows (such as a third of all, if they are one vector) are dealt over several blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillwork.functions.columns import named
from rillwork.functions.shared import cut, ship

#: Rows to fit the index on, at least; for each partition; rows below which there is nothing to learn from; the recall to reach
#: on the rows held out. There are 1,024 partitions at most, so the fit is on 98,304 rows at most.
SAMPLE, EACH, LEAST, TARGET = 6144, 96, 64, 0.95
NEIGHBOURS, HIDDEN, EPOCHS = 10, 96, 25
#: Rows outside the fit that set how many partitions a query goes to, a fifth of a small table.
HELD_OUT = 512
#: Rows of candidates and of queries that meet in one task.
BLOCK, QUERY_BLOCK = 16384, 2048


def _nearest(x: np.ndarray, of: np.ndarray, k: int) -> np.ndarray:
    """The k nearest rows of x, without itself, for each row number in `of`."""
    out = np.empty((len(of), k), np.int64)
    norms = (x * x).sum(1)
    for s in range(0, len(of), 128):
        rows = of[s : s + 128]
        d = norms - 2 * x[rows] @ x.T
        d[np.arange(len(rows)), rows] = np.inf
        out[s : s + 128] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def _halve(a: np.ndarray, b: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """A balanced cut of a graph of n nodes with the edges a-b: for each node, whether it is in the second half."""
    degree = np.bincount(a, minlength=n) + np.bincount(b, minlength=n) + 1e-9
    mode = rng.standard_normal(n)
    for _ in range(60):  # smoothing leaves the slowest mode but the constant one
        mode = mode - (mode * degree).sum() / degree.sum()
        mode = 0.5 * mode + 0.5 * (np.bincount(a, mode[b], n) + np.bincount(b, mode[a], n)) / degree
        mode /= np.linalg.norm(mode) + 1e-12
    side = np.zeros(n, bool)
    side[np.argsort(mode, kind="stable")[n // 2 :]] = True
    for _ in range(20):
        across = side[a] != side[b]
        gain = np.bincount(a, 2 * across - 1, n) + np.bincount(b, 2 * across - 1, n) + 0.01 * rng.standard_normal(n)
        left, right = (s[np.argsort(-gain[s])] for s in (np.flatnonzero(~side), np.flatnonzero(side)))
        m = min(len(left), len(right))
        swap = int((gain[left[:m]] + gain[right[:m]] > 1).sum() * 0.3)
        if not swap:
            break
        side[left[:swap]], side[right[:swap]] = True, False
    return side


def partition(graph: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """Balanced partitions (a power of two) of a neighbour graph given as each node's neighbours."""
    label = np.zeros(len(graph), np.int64)
    a, b = np.repeat(np.arange(len(graph)), graph.shape[1]), graph.ravel()
    while label.max() + 1 < parts:
        grown = label * 2
        for p in range(label.max() + 1):
            own = np.flatnonzero(label == p)
            place = np.full(len(graph), -1)
            place[own] = np.arange(len(own))
            inside = (place[a] >= 0) & (place[b] >= 0)
            grown[own] += _halve(place[a[inside]], place[b[inside]], len(own), rng)
        label = grown
    return label


@dataclass
class Router:
    """The classifier: probabilities of partitions for vectors."""

    centre: np.ndarray
    w: list[np.ndarray]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum((x - self.centre) @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3]
        e = np.exp(h - h.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def learn(x: np.ndarray, label: np.ndarray, parts: int, rng: np.random.Generator) -> Router:
    """Fits the classifier by Adam on cross entropy."""
    centre, spread = x.mean(0), x.std() + 1e-9
    w = [rng.standard_normal((x.shape[1], HIDDEN)) * np.sqrt(2 / x.shape[1]) / spread, np.zeros(HIDDEN), rng.standard_normal((HIDDEN, parts)) * np.sqrt(1 / HIDDEN), np.zeros(parts)]
    z, m, v, t = x - centre, [np.zeros_like(k) for k in w], [np.zeros_like(k) for k in w], 0
    step = [0.01 / spread if k == 0 else 0.01 for k in range(4)]
    for epoch in range(EPOCHS):
        order = rng.permutation(len(z))
        for s in range(0, len(z), 128):
            i = order[s : s + 128]
            raw = z[i] @ w[0] + w[1]
            h = np.maximum(raw, 0)
            p = h @ w[2] + w[3]
            p = np.exp(p - p.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(i)), label[i]] -= 1
            p /= len(i)
            back = (p @ w[2].T) * (raw > 0)
            t += 1
            for k, g in enumerate((z[i].T @ back, back.sum(0), h.T @ p, p.sum(0))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] = w[k] - step[k] * (1 - epoch / EPOCHS) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8 / spread)
    return Router(centre, w)


@dataclass
class Index:
    router: Router | None  # None: one partition
    parts: int


def parts_for(rows: int) -> int:
    """How many partitions a table of so many rows has: as its square root, to 1,024; at least 16, but of 128 rows on average, and at least 2."""
    few = min(4, np.round(np.log2(max(rows, 1) / 128)))
    return 2 ** int(np.clip(max(few, np.round(np.log2(max(rows, 1)) / 2 - 4)), 1, 10))


def fit(sample: np.ndarray, rows: int, parts: int | None = None) -> Index:
    """An index from distinct sample vectors; `rows` is the size of the whole table."""
    if rows < LEAST or len(sample) < LEAST // 2:
        return Index(None, 1)
    parts = parts or parts_for(rows)
    rng = np.random.default_rng(7)
    known = _nearest(sample, np.arange(len(sample)), NEIGHBOURS)
    return Index(learn(sample, partition(known, parts, rng), parts, rng), parts)


def unseen(sample: np.ndarray, ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows held out, those whose vectors are not in the sample, each vector once; all rows if there are none."""
    of_sample = {v.tobytes() for v in sample}
    new = {v.tobytes(): k for k, v in enumerate(x) if v.tobytes() not in of_sample}
    keep = list(new.values()) or list(range(len(x)))
    return ids[keep], x[keep]


def probes_for(index: Index, filed: DataFrame, ids: np.ndarray, x: np.ndarray, dim: int, target: float = TARGET) -> int:
    """The least number of partitions in which `target` of the true neighbours of the rows (ids, x) are, among all rows.

    Each task of one scan keeps the nearest rows of its own; the result has NEIGHBOURS rows for each of HELD_OUT.
    """
    if index.router is None or not len(ids):
        return 1
    held = filed.sparkSession.sparkContext.broadcast((ids, x))  # HELD_OUT vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q = held.value
        best_d = np.full((len(q), NEIGHBOURS), np.inf)
        best_id, best_part = np.zeros(best_d.shape, np.int64), np.zeros(best_d.shape, np.int32)
        square = (q * q).sum(1)[:, None]
        for b in batches:
            c_ids, c, part = b.column(0).to_numpy(), _matrix(b.column(1), dim), b.column(2).to_numpy()
            for s in range(0, b.num_rows, 2048):
                y, i = c[s : s + 2048], c_ids[s : s + 2048]
                d = square + (y * y).sum(1) - 2 * q @ y.T
                d[own[:, None] == i] = np.inf
                d = np.c_[best_d, d]
                near = np.argpartition(d, NEIGHBOURS - 1, axis=1)[:, :NEIGHBOURS]
                best_d = np.take_along_axis(d, near, 1)
                best_id = np.take_along_axis(np.c_[best_id, np.broadcast_to(i, (len(q), len(i)))], near, 1)
                best_part = np.take_along_axis(np.c_[best_part, np.broadcast_to(part[s : s + 2048], (len(q), len(i)))], near, 1)
        which, place = np.nonzero(np.isfinite(best_d))
        columns = [pa.array(which.astype(np.int32)), pa.array(best_d[which, place]), pa.array(best_id[which, place]), pa.array(best_part[which, place])]
        yield pa.RecordBatch.from_arrays(columns, names=["q", "d", "id", "part"])

    order = Window.partitionBy("q").orderBy("d", "id")
    met = filed.select("id", "vec", "part").mapInArrow(run, "q int, d double, id bigint, part int")
    true = met.withColumn("place", F.row_number().over(order)).where(F.col("place") <= NEIGHBOURS).select("q", "part").toArrow()
    rank_of = np.argsort(np.argsort(-index.router(x), axis=1, kind="stable"), axis=1)
    needed = np.sort(rank_of[true["q"].to_numpy(), true["part"].to_numpy()])
    return int(needed[int(np.ceil(target * len(needed))) - 1]) + 1 if len(needed) else 1


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def usable(vec: Column, dim: int) -> Column:
    """Vectors of the table's dimension that are not zero and hold finite numbers only."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec.isNotNull() & (F.size(vec) == dim) & ~F.coalesce(bad, F.lit(True)) & F.exists(vec, lambda x: x != 0)


def best(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query id, candidate id, distance) of each query's k nearest candidates, its own id left out, ties to smaller ids.

    A matrix product picks what may be among the k nearest with room for its rounding; distances are then taken from the
    vectors themselves.
    """
    norms = (c * c).sum(1)
    for s in range(0, len(q), 64):
        x = q[s : s + 64]
        square = (x * x).sum(1)[:, None]
        d = square + norms - 2 * x @ c.T
        d[q_ids[s : s + 64, None] == c_ids] = np.inf
        kth = np.partition(d, min(k, len(c)) - 1, axis=1)[:, min(k, len(c)) - 1]
        for i, row in enumerate(d):
            near = np.flatnonzero((row <= kth[i] + 1e-9 * (1 + square[i, 0] + norms.max())) & (row < np.inf))
            exact = np.sqrt(((c[near] - x[i]) ** 2).sum(1))
            order = np.lexsort((c_ids[near], exact))[:k]
            yield np.full(len(order), q_ids[s + i]), c_ids[near[order]], exact[order]


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", sample_rows: int = SAMPLE, parts: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id is divisible by `every`.

    The score is the Euclidean distance in double precision. Defined cases: vectors that are null, zero, hold null or
    non-finite components, or have another dimension than most rows take no part, nor do null ids; a repeated id is one
    query, by the first of its vectors in hash order, and never finds itself; equal vectors are all candidates, ties go
    to smaller ids; a query gets all candidates if there are at most k; other columns aren't read; an empty table gives
    no rows.
    """
    spark = ship(vectors.sparkSession)
    rows = vectors.where(named(id_col).isNotNull()).select(named(id_col).cast("long").alias("id"), named(vec_col).alias("vec"))
    common = rows.where("vec IS NOT NULL").groupBy(F.size("vec").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    dim = common["dim"] if common else 0
    rows = rows.where(usable(F.col("vec"), dim))
    total = rows.count()
    index, held = Index(None, 1), (np.zeros(0, np.int64), np.zeros((0, dim)))
    if total >= LEAST:
        apart = min(HELD_OUT, total // 5)
        most = min(max(sample_rows, EACH * (parts or parts_for(total))), total - apart)
        shown = rows.orderBy(F.xxhash64("id"), "id").limit(most + apart).toArrow()
        x = _matrix(shown["vec"], dim)
        sample = np.unique(x[:most], axis=0)
        index, held = fit(sample, total, parts), unseen(sample, shown["id"].to_numpy()[most:], x[most:])
    router = spark.sparkContext.broadcast(index.router)  # a few thousand weights

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = router.value(_matrix(b.column(1), dim)).argmax(1) if router.value and b.num_rows else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(part.astype(np.int32))], names=["id", "vec", "part"])

    kind = vectors.schema[vec_col].dataType.simpleString()
    filed = cut(rows.mapInArrow(file, f"id bigint, vec {kind}, part int"))
    sizes = np.zeros(index.parts, np.int64)
    for r in filed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect():  # a row per partition
        sizes[r["part"]] = r["n"]
    probes, parts = probes_for(index, filed, *held, dim), index.parts

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            chance = router.value(_matrix(b.column(1), dim)) if router.value and b.num_rows else np.ones((b.num_rows, 1))
            order = np.argsort(-chance, axis=1, kind="stable")
            # as many more as it takes to meet k candidates besides rows with the query's own id
            seen = np.cumsum(sizes[order], axis=1)
            asks = (np.arange(parts) < probes) | (np.c_[np.zeros(b.num_rows), seen[:, :-1]] < k + 1)
            which, place = np.nonzero(asks)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(which)), b.column(1).take(pa.array(which)), pa.array(order[which, place].astype(np.int32))], names=["id", "vec", "part"])

    asked = filed.where(F.col("id") % every == 0).groupBy("id").agg(F.min_by("vec", F.xxhash64("vec")).alias("vec"))
    routed = cut(asked.mapInArrow(route, f"id bigint, vec {kind}, part int"))
    loads = np.zeros(index.parts, np.int64)
    for r in routed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect():
        loads[r["part"]] = r["n"]

    def blocks(n: np.ndarray, most: int) -> Column:
        """How many blocks a partition's rows are dealt over."""
        return F.element_at(F.array(*[F.lit(int(max(1, -(-x // most)))) for x in n]), F.col("part") + 1)

    every_block = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    of_rows, of_queries = blocks(sizes, BLOCK), blocks(loads, QUERY_BLOCK)
    left = routed.withColumn("qb", own(of_queries)).withColumn("cb", every_block(of_rows))
    right = filed.withColumn("cb", own(of_rows)).withColumn("qb", every_block(of_queries))

    def meet(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        found = []
        if queries.num_rows and candidates.num_rows:
            found = list(best(queries["id"].to_numpy(), _matrix(queries["vec"], dim), candidates["id"].to_numpy(), _matrix(candidates["vec"], dim), k))
        q, c, s = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query_id": q, "vec_id": c, "score": s})

    by = ("part", "cb", "qb")
    met = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(meet, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op8_nearest": op8_nearest}
#: Approximate by design: the query is tested for its recall against brute force.
ORACLE: dict[str, str] = {}
