"""Item recommendations: ratings, sequences, neighbours by cosine, and the models that give vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillwork.functions.shared import cut, ship
from rillwork.operators.sessions import PIECE_MS, TIMEOUT_S, tag_sessions

# What an event says of the visitor's interest.
WEIGHTS = {"view": 1.0, "addtocart": 3.0, "transaction": 5.0}
TOP_N, CANDIDATE_CAP = 20, 3000
#: Items of a sequence's row.
LONGEST = 1000
#: Vectors of a block, at least; a task compares two blocks. Pivots that vectors are filed under, at most.
BLOCK, PIVOTS = 512, 128
#: Numbers of a block's vectors, at most, and scores whose largest stands for them when a bound is sought.
NUMBERS, STRIP = 1 << 20, 64
#: From this share of pairs of an item and a vector on, parts save less than they cost.
OPEN = 0.5
#: Groups of ids that are numbered apart.
GROUPS = 4096


def implicit_ratings(events: DataFrame) -> DataFrame:
    """(visitorid, itemid, rating): how often a visitor did what with an item, times what that weighs; ids stay as they are.

    Unknown events don't count; the filter on the others reaches the scan.
    """
    kind = F.col("event")
    total = reduce(add, [F.count_if(kind == e) * F.lit(w) for e, w in WEIGHTS.items()])
    return events.where(kind.isin(*WEIGHTS)).groupBy("visitorid", "itemid").agg(total.alias("rating"))


def numbered(ids: DataFrame, column: str) -> DataFrame:
    """(column, index): a gapless int from 0 for each id that isn't null.

    Ids are numbered in GROUPS by hash, after the sizes of the groups before, so no task sees all of them.
    """
    grouped = ids.where(F.col(column).isNotNull()).select(column).distinct().withColumn("_group", F.pmod(F.xxhash64(column), F.lit(GROUPS)))
    sizes = grouped.groupBy("_group").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_group", (F.sum("_n").over(Window.orderBy("_group")) - F.col("_n")).alias("_before"))  # GROUPS rows
    place = F.row_number().over(Window.partitionBy("_group").orderBy(column))
    return grouped.withColumn("_place", place).join(F.broadcast(before), "_group").select(column, (F.col("_before") + F.col("_place") - 1).cast("int").alias("index"))


def popular_items(ratings: DataFrame, cap: int = CANDIDATE_CAP) -> DataFrame:
    return ratings.groupBy("itemid").agg(F.sum("rating").alias("popularity")).orderBy(F.desc("popularity"), "itemid").limit(cap)


def item_chunks(events: DataFrame, timeout_s: int = TIMEOUT_S, longest: int = LONGEST) -> DataFrame:
    """(session_id, chunk, items): each session's items in order of time, then item, as strings, in rows of at most `longest`.

    An item's place is counted on two levels: within its session's piece of time, and after the pieces before; so no task
    orders a whole session, and no row grows with it.
    """
    tagged = tag_sessions(events, timeout_s).select("session_id", "timestamp", "itemid", F.floor(F.col("timestamp") / PIECE_MS).alias("piece"))
    sizes = tagged.groupBy("session_id", "piece").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("session_id").orderBy("piece")) - F.col("n")
    starts = sizes.select("session_id", F.col("piece").alias("of"), before.alias("before"), F.sum("n").over(Window.partitionBy("session_id")).alias("all")).where(F.col("all") >= 2)
    inside = F.row_number().over(Window.partitionBy("session_id", "piece").orderBy("timestamp", "itemid")) - 1
    placed = tagged.withColumn("inside", inside).join(starts.withColumnRenamed("session_id", "of_session"), (F.col("session_id") == F.col("of_session")) & F.col("piece").eqNullSafe(F.col("of")))
    at = F.col("before") + F.col("inside")
    chunk = placed.groupBy("session_id", F.floor(at / longest).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct(at.alias("at"), F.col("itemid").cast("string").alias("item")))).alias("items"))
    return chunk.select("session_id", "chunk", F.filter(F.transform("items", lambda x: x["item"]), lambda x: x.isNotNull()).alias("items"))


def item_sequences(events: DataFrame, timeout_s: int = TIMEOUT_S) -> DataFrame:
    """(session_id, items): the chunks of sessions of two items or more; a session of LONGEST items or fewer is one row."""
    return item_chunks(events, timeout_s).select("session_id", "items")


@dataclass
class _Compare:
    """The best of pairs of blocks of unit vectors by their scalar product, and what triangles tell of the others."""

    top_n: int
    digits: int | None
    with_own: bool = False

    def best(self, ids: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Item ids, candidate ids and scores of each item's best, ties to smaller ids, itself left out unless with_own.

        The largest scores of strips of candidates bound the last of the best from below; only what reaches the bound is
        rounded and ordered.
        """
        found = []
        strips, slack = -(-len(others) // STRIP), 0.0 if self.digits is None else 1.01 * 10.0**-self.digits
        for s in range(0, len(ids), 256):
            score = np.full((len(ids[s : s + 256]), strips * STRIP), -np.inf)
            np.matmul(x[s : s + 256], y.T, out=score[:, : len(others)])
            if not self.with_own:
                score[:, : len(others)][ids[s : s + 256, None] == others] = -np.inf
            tops = score.reshape(len(score), strips, STRIP).max(2) if strips >= self.top_n else score
            k = min(self.top_n, tops.shape[1])
            bound = np.partition(tops, tops.shape[1] - k, axis=1)[:, tops.shape[1] - k]
            item, other = np.nonzero((score >= bound[:, None] - slack) & (score > -np.inf))
            near = score[item, other]
            if self.digits is not None:
                near = np.round(near, self.digits) + 0.0
            order = np.lexsort((others[other], -near, item))
            item, other, near = item[order], other[order], near[order]
            first = np.arange(len(item)) - np.searchsorted(item, item) < self.top_n
            found.append((ids[s + item[first]], others[other[first]], near[first]))
        return [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]

    def reach(self, score: np.ndarray) -> np.ndarray:
        """The distance beyond which a unit vector can't take part, for the score of the last one so far."""
        slack = 1e-9 + (0 if self.digits is None else 10.0**-self.digits)
        return np.sqrt(np.maximum(2 - 2 * (score - slack), 0)) + 1e-9


def _vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    numbers = whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(set(whole.value_lengths().unique().to_pylist())) > 1:
        raise ValueError("vectors of several lengths")
    return numbers.reshape(len(whole), -1) if len(whole) else np.zeros((0, 0))


def _to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * x @ pivots.T, 0))


def _placed(vectors: DataFrame, pivots: Broadcast) -> DataFrame:
    """(id, vec, part): unit vectors and their nearest pivot; vectors without a length go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _vectors(b.column(1)) if b.num_rows else np.zeros((0, pivots.value.shape[1]))
            length = np.sqrt((x * x).sum(1))
            ok = length > 0
            unit = x[ok] / length[ok, None]
            part = _to_pivots(unit, pivots.value).argmin(1) if len(unit) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), pa.array(list(unit), pa.list_(pa.float64())), pa.array(part.astype(np.int32))], names=["id", "vec", "part"])

    return vectors.mapInArrow(run, "id bigint, vec array<double>, part int")


def _intervals(placed: DataFrame, pivots: Broadcast) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest distance of each part's vectors to each pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(pivots.value)
        low, high = np.full((n, n), np.inf), np.full((n, n), -np.inf)
        for b in batches:
            if b.num_rows:
                d, part = _to_pivots(_vectors(b.column(0)), pivots.value), b.column(1).to_numpy()
                np.minimum.at(low, part, d)
                np.maximum.at(high, part, d)
        part, pivot = np.nonzero(np.isfinite(low))
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(pivot, pa.int32()), pa.array(low[part, pivot]), pa.array(high[part, pivot])], names=["part", "pivot", "low", "high"])

    n = len(pivots.value)
    low, high = np.full((n, n), np.inf), np.full((n, n), -np.inf)
    found = placed.select("vec", "part").mapInArrow(run, "part int, pivot int, low double, high double").groupBy("part", "pivot").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    for r in found.collect():  # PIVOTS squared
        low[r["part"], r["pivot"]], high[r["part"], r["pivot"]] = r["low"], r["high"]
    return low, high


def _meet(asks: DataFrame, placed: DataFrame, sizes: np.ndarray, compare: _Compare, length: int) -> DataFrame:
    """(item_id, rec_item_id, score): each item of asks (id, vec, part) with the best of that part, block by block.

    A vector is sent once for each block that it meets, so large parts have large blocks.
    """
    block = max(BLOCK, min(NUMBERS // max(1, length), int(sizes.max(initial=0)) // 16))
    loads = np.zeros(len(sizes), np.int64)
    for r in asks.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect():  # a row a part
        loads[r["part"]] = r["n"]

    def blocks(n: np.ndarray) -> F.Column:
        return F.element_at(F.array(*[F.lit(int(max(1, -(-x // block)))) for x in n]), F.col("part") + 1)

    def run(items: pa.Table, candidates: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if items.num_rows and candidates.num_rows:
            out = compare.best(items["id"].to_numpy(), _vectors(items["vec"]), candidates["id"].to_numpy(), _vectors(candidates["vec"]))
        return pa.table(dict(zip(("item_id", "rec_item_id", "score"), out, strict=True)))

    own = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = asks.withColumn("a", own(blocks(loads))).withColumn("b", every(blocks(sizes)))
    right = placed.withColumn("b", own(blocks(sizes))).withColumn("a", every(blocks(loads)))
    by = ("part", "a", "b")
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, "item_id bigint, rec_item_id bigint, score double")


def _ranked(met: DataFrame, top_n: int) -> DataFrame:
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "rec_item_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n)


def _open_parts(placed: DataFrame, nearest: DataFrame, pivots: Broadcast, low: np.ndarray, high: np.ndarray, compare: _Compare) -> DataFrame:
    """(id, parts): the other parts in which an item of placed may have something nearer than the last of `nearest`.

    By the triangle inequality a part whose distances to a pivot are from low to high is at least d - high and low - d away
    from an item whose distance to the pivot is d, for any pivot.
    """
    last = nearest.groupBy(F.col("item_id").alias("id")).agg(F.when(F.count(F.lit(1)) >= compare.top_n, F.min("score")).alias("last"))
    held = pivots.value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            d, own = _to_pivots(_vectors(b.column(1)), held), b.column(2).to_numpy()
            reach = compare.reach(np.nan_to_num(b.column(3).to_numpy(zero_copy_only=False).astype(np.float64), nan=-1.0))
            away = np.stack([np.maximum(d - high[p], low[p] - d).max(1) for p in range(len(held))], 1)  # endless for an empty part
            away[np.arange(len(own)), own] = np.inf
            parts = [np.flatnonzero(near).astype(np.int32) for near in away <= reach[:, None]]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(parts, pa.list_(pa.int32()))], names=["id", "parts"])

    return placed.join(last, "id", "left").select("id", "vec", "part", "last").mapInArrow(run, "id bigint, parts array<int>")


def top_n_neighbors(vectors: DataFrame, top_n: int = TOP_N, digits: int | None = None, pivots: int | None = None, report: dict[str, float] | None = None, of: list[int] | None = None) -> DataFrame:
    """(item_id, rec_item_id, score, rank) of (id, vec array<double>): each item's nearest by cosine, ties to smaller ids.

    Exact. Items of equal vectors are one in all comparisons: of their ids the top_n + 1 smallest can be anyone's nearest, and
    their own nearest are the same but for themselves. So the work grows with the square of the different vectors, and with
    the items only in proportion. Where ids repeat, every row is compared by itself. Vectors without a length have no neighbours. digits rounds the
    scores before they are ranked. report gets `skipped`, the share of pairs of a vector and a part that weren't
    compared, and `compared`, the number of vectors. of names the items whose neighbours are wanted (None: all); the candidates are all items even so.
    """
    rows = cut(vectors.where("id IS NOT NULL AND vec IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec")))
    if rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        return _ranked(_nearest(rows, _Compare(top_n, digits), pivots, report, of), top_n)
    one = rows.groupBy("vec").agg(F.min("id").alias("of"))
    items = cut(rows.join(one, "vec").select("id", "of"))
    kept = F.row_number().over(Window.partitionBy("of").orderBy("id"))
    members = items.withColumn("_n", kept).where(F.col("_n") <= top_n + 1).select(F.col("of").alias("rec_of"), F.col("id").alias("rec"))
    wanted = items if of is None else items.where(F.col("id").isin(of))
    asked = None if of is None else [r["of"] for r in wanted.select("of").distinct().collect()]  # as many as `of` at most
    near = _nearest(cut(rows.join(items.where("id = of").select("id"), "id", "left_semi")), _Compare(top_n + 1, digits, True), pivots, report, asked)
    near = _ranked(near, top_n + 1).select(F.col("item_id").alias("of"), F.col("rec_item_id").alias("rec_of"), "score")
    best = Window.partitionBy("of").orderBy(F.desc("score"), "rec")
    spread = near.join(members, "rec_of").withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= top_n + 1)
    lists = spread.groupBy("of").agg(F.sort_array(F.collect_list(F.struct("_n", "rec", "score"))).alias("best"))  # top_n + 1 each
    others = F.slice(F.filter("best", lambda b: b["rec"] != F.col("id")), 1, top_n)
    found = wanted.join(lists, "of").select(F.col("id").alias("item_id"), F.posexplode(others).alias("pos", "b"))
    return found.select("item_id", F.col("b.rec").alias("rec_item_id"), F.col("b.score").alias("score"), (F.col("pos") + 1).alias("rank"))


def _nearest(rows: DataFrame, compare: _Compare, pivots: int | None, report: dict[str, float] | None, of: list[int] | None) -> DataFrame:
    """(item_id, rec_item_id, score): among others, each item's best of (id, vec).

    Without all pairs where vectors cluster: items are filed under the nearest of some pivots and compared within their
    part first. The last of the best so far bounds how far away a better one can be, and by the triangle inequality an item skips
    the parts that are farther. What is left is compared in blocks, and no pair leaves its task but the best. Where
    few parts are skipped, all are compared in larger blocks instead.
    """
    spark, total = ship(rows.sparkSession), rows.count()
    several = pivots or max(1, min(PIVOTS, total // BLOCK))
    first = _vectors(rows.where(F.exists("vec", lambda v: v != 0)).orderBy(F.xxhash64("id"), "id").limit(several).toArrow()["vec"])  # PIVOTS at most
    if not len(first):
        return spark.createDataFrame([], "item_id bigint, rec_item_id bigint, score double")
    held = spark.sparkContext.broadcast(first / np.sqrt((first * first).sum(1))[:, None])
    placed, length = cut(_placed(rows, held)), first.shape[1]
    sizes = np.zeros(len(first), np.int64)
    for r in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect():  # a row a part
        sizes[r["part"]] = r["n"]
    asking = placed if of is None else placed.where(F.col("id").isin(of))
    if report is not None:
        report["compared"] = int(sizes.sum())
    if len(first) == 1:
        return _meet(asking, placed, sizes, compare, length)
    low, high = _intervals(placed, held)
    near = cut(_ranked(_meet(asking, placed, sizes, compare, length), compare.top_n).drop("rank"))
    asks = cut(_open_parts(asking, near, held, low, high, compare))
    many = F.coalesce(F.sum(F.size("parts")), F.lit(0))
    load = F.coalesce(F.sum(F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + F.element_at(F.array(*[F.lit(int(x)) for x in sizes]), p + 1))), F.lit(0))
    opened = asks.agg(F.count(F.lit(1)).alias("n"), many.alias("many"), load.alias("load")).first()
    if report is not None:
        report["skipped"] = 1 - opened["many"] / max(1, opened["n"] * (len(first) - 1))
    if opened["load"] > OPEN * max(1, opened["n"]) * int(sizes.sum()):
        whole = [d.withColumn("part", F.lit(0)) for d in (asking, placed)]
        return _meet(*whole, sizes.sum(keepdims=True), compare, length)
    asks = asks.select("id", F.explode("parts").alias("part")).join(asking.drop("part"), "id").select("id", "vec", "part").toDF("id", "vec", "part")
    return near.unionByName(_meet(asks, placed, sizes, compare, length))


def als_vectors(events: DataFrame, cap: int = CANDIDATE_CAP, rank: int = 32, iterations: int = 10, seed: int = 42) -> DataFrame:
    """Item vectors of implicit-feedback ALS, of the most popular items. ALS knows ints only: ids are numbered for it."""
    ratings = cut(implicit_ratings(events))
    items, visitors = cut(numbered(ratings, "itemid")), numbered(ratings, "visitorid")
    known = ratings.join(items.withColumnRenamed("index", "item"), "itemid").join(visitors.withColumnRenamed("index", "visitor"), "visitorid")
    model = ALS(userCol="visitor", itemCol="item", ratingCol="rating", rank=rank, maxIter=iterations, regParam=0.1, implicitPrefs=True, nonnegative=True, coldStartStrategy="drop", seed=seed).fit(known)
    keep = items.join(F.broadcast(popular_items(ratings, cap)), "itemid").select("index", F.col("itemid").alias("id"))  # at most `cap` ids
    factors = model.itemFactors.select(F.col("id").alias("index"), F.col("features").cast("array<double>").alias("vec"))
    return factors.join(keep, "index").select("id", "vec")


def item2vec_vectors(events: DataFrame, size: int = 32, min_count: int = 5, iterations: int = 5, timeout_s: int = TIMEOUT_S, seed: int = 42) -> DataFrame:
    """Item vectors of Word2Vec over session sequences, of all items found min_count times or more."""
    model = Word2Vec(inputCol="items", outputCol="vec", vectorSize=size, minCount=min_count, windowSize=5, maxIter=iterations, seed=seed).fit(item_sequences(events, timeout_s))
    return model.getVectors().select(F.col("word").cast("long").alias("id"), vector_to_array("vector").alias("vec"))


def save_recommendations(found: DataFrame, method: str, path: str) -> None:
    """Replaces one method's rows and leaves the other methods'."""
    found.withColumn("method", F.lit(method)).write.mode("overwrite").partitionBy("method").option("partitionOverwriteMode", "dynamic").parquet(path)
