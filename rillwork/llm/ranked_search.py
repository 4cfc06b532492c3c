"""Ranked lexical search: TPUT over term-partitioned postings.

One scan cuts the documents into blocks of at most BLOCK rows and writes, for each block and each term that the queries
may ask for, one posting list. When the terms' weights are known, each list is ordered by impact (what the term adds to
a document's score), and lists are partitioned by term, the blocks of a frequent term over many tasks. Then, as in TPUT:

1. the heads of the lists give sums that are lower bounds of scores; a query's k-th best of them is its first bound;
2. every list of a query of m terms is cut at the same impact, the bound over m: a document that is in none of these
   prefixes can't reach the bound. What is above goes to the block's task, which sums it for all queries and keeps what can
   still be among the best, by the largest impact that each list has left;
3. of those, the scores that lack something are looked up in the rest of the lists, and the best k are exact.

A posting is sent once for all queries, and no task holds more than a block. The corpus is asked for terms by a table of
SLOTS checksums, so it is read once for any number of queries; the terms themselves decide after. Queries take part in
blocks of at most PAIRS pairs of query and term (or one query), so what is broadcast is bounded.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillwork.functions.columns import named
from rillwork.functions.shared import cut, ship

#: Rows of a block, and postings at which a block ends before.
BLOCK, POSTINGS = 4096, 1 << 20
#: Entries of the table of asked checksums, a power of two, and pairs of query and term that are handled together.
SLOTS, PAIRS = 1 << 20, 1 << 20
#: Stands for a null id in ties: such documents come last.
_NO_ID = (1 << 63) - 1
#: ASCII letters in lower case, digits and all bytes of other characters stay, everything else parts terms.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: str | bytes | None) -> list[bytes]:
    """The terms of a text in order, with repeats, in UTF-8."""
    raw = text if isinstance(text, bytes) else (text or "").encode()
    return raw.translate(_BYTES).split()


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, term): each term once for each id; rows that share an id are one query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted(set(terms(t.as_py()))) for t in b.column(1)]
            which = pa.array(np.repeat(np.arange(b.num_rows), [len(x) for x in found]))
            flat = pa.array([t for x in found for t in x], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0).take(which), flat], names=["item", "term"])

    rows = queries.select(named(id_col).cast("long").alias("item"), named(text_col).alias("text"))
    return rows.mapInArrow(run, "item bigint, term string").distinct()


def postings(docs: DataFrame, asked: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (block, term, at, tf, n): a list of places in the block, occurrences and lengths of the documents.

    Each block also has a row without a term that holds the ids and lengths of all its documents.
    """
    spark = docs.sparkSession
    seen = bytearray(SLOTS)
    for r in asked.select((F.crc32(F.encode("term", "UTF-8")) % SLOTS).alias("at")).distinct().toArrow()["at"].to_pylist():  # SLOTS at most
        seen[r] = 1
    sent = spark.sparkContext.broadcast(bytes(seen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, block = sent.value, TaskContext.get().partitionId() << 32
        ids: list = []
        lengths: list[int] = []
        lists: dict[bytes, tuple[list[int], list[int]]] = {}
        held = 0

        def out() -> pa.RecordBatch:
            n = np.array(lengths, np.int64)
            columns = {
                "block": pa.array([block] * (len(lists) + 1), pa.int64()),
                "term": pa.array([None, *lists], pa.binary()).cast(pa.string()),
                "at": pa.array([None, *(at for at, _ in lists.values())], pa.list_(pa.int32())),
                "tf": pa.array([None, *(tf for _, tf in lists.values())], pa.list_(pa.int64())),
                "n": pa.array([n, *(n[at] for at, _ in lists.values())], pa.list_(pa.int64())),
                "ids": pa.array([ids, *[None] * len(lists)], pa.list_(pa.int64())),
            }
            return pa.RecordBatch.from_pydict(columns)

        for b in batches:
            for one, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                words = terms(text.as_py())
                for w, tf in Counter(words).items():
                    if wanted[crc32(w) % SLOTS]:
                        at, tfs = lists.setdefault(w, ([], []))
                        at.append(len(ids))
                        tfs.append(tf)
                        held += 1
                ids.append(one)
                lengths.append(len(words))
                if len(ids) == BLOCK or held >= POSTINGS:
                    yield out()
                    ids, lengths, lists, held, block = [], [], {}, 0, block + 1
        if ids:
            yield out()

    rows = docs.select(named(id_col).cast("long").alias("id"), named(text_col).alias("text"))
    return rows.mapInArrow(run, "block bigint, term string, at array<int>, tf array<bigint>, n array<bigint>, ids array<bigint>")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of an array of lists, and the bounds of each list."""
    lengths = np.array([len(x) if x.is_valid else 0 for x in column], np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(lengths)]


def _lists(of: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(of, pa.int32()), pa.array(values, kind))


def by_impact(posts: DataFrame, known: DataFrame, count: int, length: int) -> DataFrame:
    """(term, block, at, impact, top) from postings: lists of the terms in `known` (word, term, w), the largest impact first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, of = _flat(b.column(3))
            tf, n = _flat(b.column(4))[0], _flat(b.column(5))[0]
            row = np.repeat(np.arange(b.num_rows), np.diff(of))
            m = 50 + np.array([50 * int(x) * count // length for x in np.unique(n)], np.int64)[np.unique(n, return_inverse=True)[1]] if len(n) else n
            impact = b.column(1).to_numpy()[row] * ((10**9 * tf) // (1000 * tf + 20 * m))
            order = np.lexsort((at, -impact, row))
            top = np.zeros(b.num_rows, np.int64)
            np.maximum.at(top, row, impact)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), _lists(of, at[order], pa.int32()), _lists(of, impact[order], pa.int64()), pa.array(top)], names=["term", "block", "at", "impact", "top"])

    rows = posts.join(F.broadcast(known), posts["term"] == known["word"]).select(known["term"], "w", "block", "at", "tf", "n")
    lists = rows.mapInArrow(run, "term int, block bigint, at array<int>, impact array<bigint>, top bigint")
    return lists.repartitionByRange("term", "block").sortWithinPartitions("term", "block")


def first_bounds(lists: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query, bound): the k-th largest sum of impacts in the heads of a query's lists; only of queries with k such sums."""
    heads = lists.select("term", "block", F.explode(F.slice(F.arrays_zip("at", "impact"), 1, k)).alias("e")).select("term", "block", "e.at", "e.impact")
    best = heads.withColumn("place", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("impact"), "block", "at"))).where(F.col("place") <= k)
    sums = best.join(F.broadcast(asked), "term").groupBy("query", "block", "at").agg(F.sum("impact").alias("part"))
    top = sums.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("part")))).where(F.col("place") <= k)
    return top.groupBy("query").agg(F.min("part").alias("bound"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k).select("query", "bound")


def _candidates(lists: DataFrame, ids: DataFrame, pairs: tuple[np.ndarray, np.ndarray], bounds: np.ndarray, k: int) -> tuple[DataFrame, DataFrame]:
    """(query, block, at, id, part, left, lacks): what can be among a query's best k, from the prefixes of its lists.

    `part` sums what the prefixes hold, `left` bounds what the rest can add, `lacks` are the terms whose rest may hold some. Also (term, least): where each list was cut.
    """
    query, term = pairs
    n_queries = len(bounds)
    each = np.bincount(query, minlength=n_queries)
    cut_at = np.maximum(1, -(-bounds // np.maximum(each, 1)))
    least = np.full(int(term.max(initial=-1)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, term, cut_at[query])
    order = np.argsort(query, kind="stable")
    sent = lists.sparkSession.sparkContext.broadcast((least, np.split(term[order], np.cumsum(each)[:-1]), bounds))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = sent.value[0]
        for b in batches:
            own = b.column(1).to_numpy()
            (at, of), impact = _flat(b.column(2)), _flat(b.column(3))[0]
            row = np.repeat(np.arange(b.num_rows), np.diff(of))
            keep = impact >= least[own][row]
            tail = np.zeros(b.num_rows, np.int64)
            np.maximum.at(tail, row[~keep], impact[~keep])
            ends = np.r_[0, np.cumsum(np.bincount(row[keep], minlength=b.num_rows))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _lists(ends, at[keep], pa.int32()), _lists(ends, impact[keep], pa.int64()), pa.array(tail)], names=["block", "term", "at", "impact", "tail"])

    def of_block(group: pa.Table) -> pa.Table:
        _, own_terms, bounds = sent.value
        group = group.combine_chunks()
        own = group["term"].to_numpy()
        names = group["impact"].chunk(0)
        at_ids = int(np.flatnonzero(own < 0)[0])
        ids = names[at_ids].values.fill_null(_NO_ID).to_numpy(zero_copy_only=False)
        at, impact = [x.values.to_numpy(zero_copy_only=False) if x.is_valid else None for x in group["at"].chunk(0)], [x.values.to_numpy(zero_copy_only=False) for x in names]
        tail, row_of = group["tail"].to_numpy(), np.full(int(max((t.max(initial=-1) for t in own_terms), default=-1)) + 1, -1)
        row_of[own[own >= 0]] = np.flatnonzero(own >= 0)
        out: list[tuple] = []
        for q, its in enumerate(own_terms):
            rows = row_of[its]
            rows = rows[rows >= 0]
            if not rows.size:
                continue
            part = np.bincount(np.concatenate([at[r] for r in rows]), np.concatenate([impact[r] for r in rows]), len(ids)).astype(np.int64)  # sums are under 2^53, so exact
            left = int(tail[rows].sum())
            bound = max(int(bounds[q]), int(np.partition(part, len(part) - k)[len(part) - k]) if len(part) >= k else 0, 1)
            met = np.flatnonzero(part + left >= bound)
            lacks = its[row_of[its] >= 0][tail[rows] > 0].tolist()
            if not left:
                met = met[np.lexsort((ids[met], -part[met]))[:k]]
            out += [(q, int(a), int(ids[a]), int(part[a]), left, lacks) for a in met]
        block = group["block"][0].as_py()
        columns = list(zip(*out, strict=True)) or [()] * 6
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
        q, a, i, p, rest, lacks = (pa.array(c, t) for c, t in zip(columns, kinds, strict=True))
        return pa.table({"query": q, "block": pa.array([block] * len(out), pa.int64()), "at": a, "id": i, "part": p, "left": rest, "lacks": lacks})

    fetched = lists.select("block", "term", "at", "impact").mapInArrow(prefixes, "block bigint, term int, at array<int>, impact array<bigint>, tail bigint")
    whole = fetched.unionByName(ids.select("block", F.lit(-1).alias("term"), F.lit(None).cast("array<int>").alias("at"), F.col("ids").alias("impact"), F.lit(0).cast("long").alias("tail")))
    met = whole.groupBy("block").applyInArrow(of_block, "query int, block bigint, at int, id bigint, part bigint, left bigint, lacks array<int>")
    thresholds = lists.sparkSession.createDataFrame(pa.table({"term": pa.array(np.arange(len(least)), pa.int32()), "least": pa.array(least)}))
    return met, thresholds


def _best(rows: DataFrame, score: str, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc(score), "id", "block", "at")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, queries: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """`query_id`, rank, `id_col`, score: each query's k documents of highest score above 0, equal scores by ascending id.

    Defined cases: a null text has no terms and, as an empty one, doesn't count as a document; repeated ids are documents
    of their own, each ranked; null ids come last in ties; of equal score and id the order is that of the rows; queries that share an id
    are one, a null query id is an id; a query without terms, or none of whose terms is found, has no rows; other columns
    aren't read; empty tables give no rows. Ids are whole numbers.
    """
    spark = ship(docs.sparkSession)
    asked = cut(query_terms(queries, query_id, query_text))
    posts = cut(postings(docs, asked, id_col, text_col))
    ids = posts.where("term IS NULL")
    total = ids.agg(F.sum(F.size(F.filter("n", lambda x: x > 0))).alias("n"), F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)).alias("l")).first()
    count, length = total["n"] or 0, total["l"] or 0
    lists = posts.where("term IS NOT NULL")
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * count + 2.0) / (2 * F.col("df") + 1))).cast("long")
    df = lists.groupBy("term").agg(F.sum(F.size("at")).cast("long").alias("df"))
    known = cut(asked.join(df, "term").select("item", "term", weight.alias("w")))
    size = known.groupBy("item").agg(F.count(F.lit(1)).alias("m"))
    running = F.sum("m").over(Window.orderBy("item")) - F.col("m")  # over the queries alone
    part_of = cut(size.select(F.col("item").alias("of"), F.floor(running / PAIRS).cast("int").alias("part")))
    parts = (part_of.agg(F.max("part")).first()[0] if count else None)

    found: list[DataFrame] = []
    for p in range(-1 if parts is None else parts + 1):
        own = known.join(part_of.where(F.col("part") == p), F.col("item").eqNullSafe(F.col("of"))).select("item", "term", "w").toArrow()  # PAIRS and one query at most
        words, term = np.unique(own["term"].to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
        items = own["item"].combine_chunks().dictionary_encode(null_encoding="encode")
        items = items.combine_chunks() if isinstance(items, pa.ChunkedArray) else items
        query, w = items.indices.to_numpy(), np.zeros(len(words), np.int64)
        w[term] = own["w"].to_numpy()
        of_word = spark.createDataFrame(pa.table({"word": pa.array(words.tolist(), pa.string()), "term": pa.array(np.arange(len(words)), pa.int32()), "w": pa.array(w)}))
        of_query = spark.createDataFrame(pa.table({"query": pa.array(query, pa.int32()), "term": pa.array(term, pa.int32())}))
        names = spark.createDataFrame(pa.table({"query": pa.array(np.arange(len(items.dictionary)), pa.int32()), query_id: items.dictionary}))

        index = cut(by_impact(lists, of_word, count, length))
        bounds = np.zeros(len(items.dictionary), np.int64)
        for r in first_bounds(index, of_query, k).collect():  # a row a query
            bounds[r["query"]] = r["bound"]
        met, least = _candidates(index, ids, (query, term), bounds, k)
        met = cut(met)
        second = _best(met, "part", k).groupBy("query").agg(F.min("part").alias("bound"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k)
        open_ = met.where("left > 0").join(F.broadcast(second.select("query", "bound")), "query", "left").where("part + left >= coalesce(bound, 0)")
        asks = open_.select("query", "block", "at", F.explode("lacks").alias("term")).alias("a").join(F.broadcast(least), "term")
        place = F.array_position(F.col("i.at"), F.col("a.at"))
        looked = asks.join(index.select("term", "block", "at", "impact").alias("i"), ["term", "block"]).withColumn("add", F.when(place > 0, F.get(F.col("i.impact"), (place - 1).cast("int"))))
        added = looked.where(F.col("add") < F.col("least")).groupBy("query", "block", F.col("a.at").alias("at")).agg(F.sum("add").alias("add"))
        exact = open_.join(added, ["query", "block", "at"], "left").select("query", "block", "at", "id", (F.col("part") + F.coalesce("add", F.lit(0))).alias("score"))
        done = met.where("left = 0").select("query", "block", "at", "id", F.col("part").alias("score")).unionByName(exact)
        ranked = _best(done.where("score > 0"), "score", k)
        found.append(ranked.join(F.broadcast(names), "query").select(query_id, "rank", F.when(F.col("id") != _NO_ID, F.col("id")).alias(id_col), "score"))
    if not found:
        return spark.createDataFrame([], f"`{query_id}` long, rank int, `{id_col}` long, score long")
    return reduce(DataFrame.unionByName, found)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op11_ranked_search": op11_ranked_search}
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
ORACLE = {
    "op11_ranked_search": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, {_UPPER}), '{_TERM}') AS ts FROM documents),
s AS (SELECT count(*) AS cn, CAST(sum(len(ts)) AS BIGINT) AS cl FROM d WHERE len(ts) > 0),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, {_UPPER}), '{_TERM}')) AS term FROM benchmark),
t AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS term FROM d) SEMI JOIN q USING (term) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * cn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM t, s GROUP BY term, cn),
x AS (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * cn) // cl)))) AS BIGINT) AS score FROM q JOIN t USING (term) JOIN w USING (term), s GROUP BY ALL),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM x WHERE score > 0)
SELECT * FROM k WHERE rank <= 50"""
}
