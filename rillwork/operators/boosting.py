"""Gradient-boosted trees from second-order gains, grown best leaf first.

The rows are grouped by their features once, and these by the bins of the features: a cell is one row with its counts of both labels. Cells are
kept in blocks of arrays. For each tree Spark sums the gradients and hessians of the log loss by leaf, feature and bin, in every task and then over
tasks; the driver gets these histograms, whose size doesn't grow with the rows, and picks splits. A pass gives the histograms of all leaves that are
open, and is one short job over blocks that are kept. A split's histogram also has the weights of both its children, so leaves that can't be split
need no pass, and a leaf whose cells take no more bytes than its histograms is sent as these cells, which are then split without a further
pass. Gradients are worked out once a tree, from margins that are kept every KEEP trees.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from functools import partial
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.functions.shared import cut, ship

#: Bins of a feature, and trees after which margins are kept.
BINS, KEEP = 64, 10
#: Cells of a block at most, and of a task where the cluster has tasks enough.
BLOCK, TASK = 65_536, 8_192


@dataclass(frozen=True)
class Settings:
    """How trees grow. max_depth and leaves: 0 sets no bound; l2 is added to a leaf's hessian; least_hessian and least_rows are a leaf's."""

    trees: int
    rate: float = 0.1
    max_depth: int = 6
    leaves: int = 0
    l2: float = 1.0
    least_hessian: float = 1.0
    least_rows: int = 0
    from_mean: bool = False


#: A node: (feature, threshold, left, right) or, for a leaf, (-1, weight, 0, 0). Values up to the threshold go left, missing ones too.
Tree = list[tuple[int, float, int, int]]


def leaf_of(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The place of each row's leaf in the tree."""
    feature, threshold, left, right = (np.array(c) for c in zip(*tree, strict=True))
    at = np.zeros(len(x), np.int64)
    while (open_ := feature[at] >= 0).any():
        rows = np.flatnonzero(open_)
        node = at[rows]
        goes_right = x[rows, feature[node].astype(int)] > threshold[node]
        at[rows] = np.where(goes_right, right[node], left[node]).astype(int)
    return at


def _margin(trees: list[Tree], x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    for t in trees:
        out += np.array([n[1] for n in t])[leaf_of(t, x)]
    return out


@dataclass
class Boosted:
    features: list[str]
    start: float
    trees: list[Tree]

    def score(self, rows: DataFrame) -> DataFrame:
        """rows with score: the probability of the label 1."""
        ship(rows.sparkSession)
        start, trees = self.start, self.trees

        @F.pandas_udf("double")
        def chance(x: pd.Series) -> pd.Series:
            return pd.Series(1 / (1 + np.exp(-(start + _margin(trees, _matrix(x)))))) if len(x) else pd.Series([], dtype=float)

        return rows.withColumn("score", chance(_vector(self.features)))

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(asdict(self)),)], "boosted string").write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Boosted:
        return cls(**json.loads(spark.read.text(path, wholetext=True).first()[0]))


def _vector(features: list[str]) -> F.Column:
    return F.array(*[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(-math.inf)), F.lit(-math.inf)) for c in features])


def _matrix(x: pd.Series | pa.Array) -> np.ndarray:
    if isinstance(x, pa.Array):
        return x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(x), -1)
    return np.stack(x.to_list()).astype(np.float64)


#: Codes of cells, a row a cell, and their gradients, hessians, rows and ones, a column a cell.
Cells = tuple[np.ndarray, np.ndarray]


@dataclass
class _Node:
    """A node that may be split. count: its number of cells, and held the cells themselves, where they are few; known says whether its split has been looked for."""

    depth: int
    count: float
    weight: float = 0.0
    known: bool = False
    gain: float = 0.0
    split: tuple[int, int] | None = None
    children: tuple[int, int] | None = None
    held: Cells | None = None


def _weight(g: float, h: float, how: Settings) -> float:
    return float(-g / (h + how.l2 + 1e-12) * how.rate)


def _searched(node: _Node, sums: np.ndarray, bins: np.ndarray, how: Settings) -> list[_Node]:
    """Finds the node's best split (feature, bin) by its histograms (4, feature, bin) of gradients, hessians, rows and cells; returns the children.

    Of splits that gain the same but for rounding the first is taken. Children that are too deep or too small to be split are known at once.
    """
    total, left = sums[:, 0].sum(axis=1), np.cumsum(sums, axis=2)[:, :, :-1]
    right = total[:, None, None] - left
    value = lambda c: c[0] * c[0] / (c[1] + how.l2 + 1e-12)
    gain = (value(left) + value(right) - value(total)) / 2
    fits = (np.minimum(left[1], right[1]) >= how.least_hessian) & (np.minimum(left[2], right[2]) >= max(1, how.least_rows))
    gain = np.where(fits & (np.arange(gain.shape[1]) < bins[:, None]), gain, -np.inf)
    f, b = np.unravel_index(int((gain >= gain.max() - 1e-9 * max(1.0, gain.max())).argmax()), gain.shape)
    node.known, node.weight = True, _weight(*total[:2], how)
    if gain[f, b] <= 1e-9:
        return []
    node.gain, node.split = float(gain[f, b]), (int(f), int(b))
    ends = lambda c: (how.max_depth and node.depth + 1 >= how.max_depth) or c[1] < 2 * how.least_hessian or c[2] < 2 * max(1, how.least_rows)
    children = [_Node(node.depth + 1, float(c[3]), _weight(*c[:2], how), bool(ends(c))) for c in (left[:, f, b], right[:, f, b])]
    if node.held:
        codes, own = node.held
        for child, mine in zip(children, (codes[:, f] <= b, codes[:, f] > b), strict=True):
            child.held = (codes[mine], own[:, mine])
    return children


def _binned(codes: np.ndarray, sums: np.ndarray, leaf: np.ndarray, leaves: int) -> np.ndarray:
    """(leaf, sum, feature, bin): the cells' sums by the leaf and the bin that each cell is in."""
    out = np.stack([[np.bincount(leaf * BINS + codes[:, f], s, leaves * BINS) for f in range(codes.shape[1])] for s in sums])
    return out.reshape(len(sums), codes.shape[1], leaves, BINS).transpose(2, 0, 1, 3)


def _summed(blocks: Iterator[Cells], tree: Tree, whole: dict[int, int], small: list[int]) -> Iterator[tuple[np.ndarray, dict[int, list[Cells]]]]:
    place, histograms, found = np.full(len(tree), -1), 0.0, {k: [] for k in small}
    place[list(whole)] = list(whole.values())
    for codes, sums in blocks:
        at = leaf_of(tree, codes)
        leaf = place[at]
        if whole:
            histograms = histograms + _binned(codes[leaf >= 0], sums[:, leaf >= 0], leaf[leaf >= 0], len(whole))
        for k in small:
            found[k].append((codes[at == k], sums[:, at == k]))
    yield histograms, found


def _both(one: tuple[np.ndarray, dict[int, list[Cells]]], other: tuple[np.ndarray, dict[int, list[Cells]]]) -> tuple[np.ndarray, dict[int, list[Cells]]]:
    return one[0] + other[0], {k: one[1][k] + other[1][k] for k in one[1]}


def _few(count: float, features: int) -> bool:
    """Whether so many cells (a byte a feature, four doubles) take no more bytes than their histograms."""
    return count * (features + 32) <= 4 * features * BINS * 8


def _looked_up(blocks: RDD, tree: Tree, counts: dict[int, float], features: int) -> dict[int, np.ndarray | Cells]:
    """For each place in counts, a leaf, its histograms, or its cells where they are few."""
    small = [k for k, n in counts.items() if _few(n, features)]
    whole = {k: i for i, k in enumerate(k for k in counts if k not in small)}
    histograms, found = blocks.mapPartitions(partial(_summed, tree=tree, whole=whole, small=small)).treeReduce(_both)
    cells = {k: (np.concatenate([c for c, _ in v]), np.concatenate([s for _, s in v], axis=1)) for k, v in found.items()}
    return {k: histograms[i] for k, i in whole.items()} | cells


def _chosen(nodes: list[_Node], how: Settings) -> tuple[set[int], set[int]]:
    """The nodes that are split, the best gain first, and the children that must be known before that is sure."""
    chosen, unknown, leaves = set(), set(), 1
    heap = [(-nodes[0].gain, 0)]
    while heap and (not how.leaves or leaves < how.leaves):
        _, k = heapq.heappop(heap)
        if not nodes[k].split:
            continue
        chosen.add(k)
        leaves += 1
        for c in nodes[k].children:
            if nodes[c].known:
                heapq.heappush(heap, (-nodes[c].gain, c))
            elif not how.leaves or leaves < how.leaves:
                unknown.add(c)
    return chosen, unknown


def _as_tree(nodes: list[_Node], split: set[int]) -> tuple[Tree, list[int]]:
    """The tree of the nodes in `split`, and for each of its places the node."""
    tree, of = [], []

    def add(k: int) -> int:
        at = len(tree)
        tree.append((-1, nodes[k].weight, 0, 0))
        of.append(k)
        if k in split:
            left, right = (add(c) for c in nodes[k].children)
            tree[at] = (*nodes[k].split, left, right)
        return at

    add(0)
    return tree, of


def grow(blocks: RDD, count: int, bins: np.ndarray, how: Settings) -> Tree:
    """One tree over blocks of so many cells; its thresholds are bins."""
    nodes, chosen, unknown = [_Node(0, count)], set(), {0}
    while unknown:
        tree, of = _as_tree(nodes, {k for k, n in enumerate(nodes) if n.split})
        far = {i: nodes[k].count for i, k in enumerate(of) if k in unknown and not nodes[k].held}
        found = {of[i]: v for i, v in _looked_up(blocks, tree, far, len(bins)).items()} if far else {}
        for k in sorted(unknown):
            if isinstance(found.get(k), tuple):
                nodes[k].held = found[k]
            sums = found[k] if not nodes[k].held else _binned(*nodes[k].held, np.zeros(len(nodes[k].held[0]), int), 1)[0]
            children = _searched(nodes[k], sums, bins, how)
            if children:
                nodes[k].children = (len(nodes), len(nodes) + 1)
                nodes += children
        chosen, unknown = _chosen(nodes, how)
    return _as_tree(nodes, chosen)[0]


def _coded(rows: DataFrame, edges: list[np.ndarray]) -> DataFrame:
    """rows (x, n, pos) by the bins of x: a bin is the number of edges below, one byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0))
                codes = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array([c.tobytes() for c in codes], pa.binary()), *b.columns[1:]], names=["codes", "n", "pos"])

    return rows.select("x", "n", "pos").mapInArrow(run, "codes binary, n bigint, pos double").groupBy("codes").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))


def _blocks(rows: Iterator[tuple[bytes, int, float]], start: float) -> Iterator[tuple[np.ndarray, ...]]:
    """Blocks (codes, rows, rows of label 1, margin)."""
    while some := list(islice(rows, BLOCK)):
        codes, n, pos = zip(*some, strict=True)
        yield np.frombuffer(b"".join(codes), np.uint8).reshape(len(n), -1), np.array(n, float), np.array(pos, float), np.full(len(n), start)


def _moved(block: tuple[np.ndarray, ...], trees: list[Tree]) -> tuple[np.ndarray, ...]:
    codes, n, pos, margin = block
    return codes, n, pos, margin + _margin(trees, codes)


def _gradients(block: tuple[np.ndarray, ...], trees: list[Tree]) -> Cells:
    codes, n, pos, margin = _moved(block, trees)
    p = 1 / (1 + np.exp(-margin))
    return codes, np.stack([n * p - pos, n * p * (1 - p), n, np.ones(len(n))])


def fit(rows: DataFrame, features: list[str], how: Settings, label: str = "label") -> Boosted:
    """Boosted trees for a label of 0 and 1. Null features and NaN are missing and go left; rows without a label don't count; ValueError without rows."""
    spark = ship(rows.sparkSession)
    known = rows.where(F.col(label).isNotNull()).select(_vector(features).alias("x"), F.col(label).cast("double").alias("y"))
    grouped = cut(known.groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos")))
    total = grouped.agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).first()
    if not total["n"]:
        raise ValueError("no rows to fit")
    share = min(max(total["pos"] / total["n"], 1e-6), 1 - 1e-6)
    start = math.log(share / (1 - share)) if how.from_mean else 0.0
    cuts = [(k + 1) / BINS for k in range(BINS - 1)]
    quantiles = grouped.agg(*[F.percentile_approx(F.col("x")[f], cuts, 10_000).alias(str(f)) for f in range(len(features))]).first()
    edges = [np.unique(np.array(q, float))[: BINS - 1] for q in quantiles]
    cells = cut(_coded(grouped, edges))
    count = cells.count()
    parts = min(math.ceil(count / TASK), 4 * spark.sparkContext.defaultParallelism)
    kept = [cells.repartition(parts).rdd.mapPartitions(partial(_blocks, start=start)).persist(StorageLevel.MEMORY_AND_DISK)]
    grown: list[Tree] = []
    for k in range(how.trees):
        if k and k % KEEP == 0:
            kept.append(kept[0].map(partial(_moved, trees=list(grown))).persist(StorageLevel.MEMORY_AND_DISK))
            for old in kept[1:-1]:
                old.unpersist()
        now = kept[-1].map(partial(_gradients, trees=grown[k - k % KEEP :]))
        if not _few(count, len(features)):  # else the tree takes one pass
            now.persist(StorageLevel.MEMORY_AND_DISK)
        grown.append(grow(now, count, np.array([len(e) for e in edges]), how))
        if now.is_cached:
            now.unpersist()
    for old in kept:
        old.unpersist()
    return Boosted(list(features), start, [[(f, float(edges[f][int(at)]) if f >= 0 else at, left, right) for f, at, left, right in t] for t in grown])
