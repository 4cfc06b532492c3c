"""Vector codes by integer k-means whose nearest entries are found as in a VA-file.

Vectors become integers and are cut into equal parts; each part position has a codebook. The nearest entry of a part is
found in two steps, exactly:

1. a codebook's entries are kept as a VA-file: each coordinate is quantised to BITS bits, that is, to one of the cells
   between some bounds. For a batch of parts, tables hold the least and the largest squared distance of each of their coordinates to
   each cell; added up over an entry's cells they are bounds of its distance;
2. only entries whose lower bound is not above the least upper bound are compared by integer distances.

Each round is one scan: a task sums the parts of every entry, so it passes on as many rows as there are entries, and the driver gets the
sums of all tasks, PARTS times ENTRIES rows, and makes the next codebooks of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.functions.columns import named
from rillwork.functions.shared import cut, ship

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Bits of a coordinate's cell, and parts that are bounded at a time.
BITS, BATCH = 4, 1024
#: Components up to this have distances and sums of them that fit long integers; rows beyond are worked on with Python's integers.
SAFE = 1 << 24
_MOST = (1 << 63) - 1


def usable(vec: Column) -> Column:
    """Vectors that hold finite numbers only."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec.isNotNull() & ~F.coalesce(bad, F.lit(True))


def integers(column: pa.Array, dim: int) -> np.ndarray:
    """floor(SCALE * x) of each component, as long integers or, where some are too large, as Python's."""
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim) * SCALE)
    if np.abs(x).max(initial=0) <= SAFE:
        return x.astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.array([n * SCALE // d for n, d in map(float.as_integer_ratio, flat.tolist())], object).reshape(-1, dim)


class Cells:
    """The VA-file of one codebook: for each coordinate the bounds of its cells, for each entry the cell of each coordinate."""

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        self.entries, (count, self.dim), self.cells = entries, entries.shape, 1 << bits
        self.small = entries.dtype != object and np.abs(entries).max(initial=0) <= SAFE
        if not self.small:
            return
        ordered = np.sort(entries, axis=0)
        at = np.minimum(np.arange(self.cells + 1) * count // self.cells, count - 1)
        self.low, self.high = ordered[at[:-1]].T.copy(), ordered[at[1:]].T.copy()  # cells that hold about as many entries each
        cell = np.stack([np.clip(np.searchsorted(self.low[d], entries[:, d], "right") - 1, 0, self.cells - 1) for d in range(self.dim)], 1)
        place = np.arange(self.dim) * self.cells + cell
        self.high = np.maximum(self.high, self.low)
        self.chosen = np.zeros((self.dim * self.cells, count))  # which cells an entry has: tables times this adds them up
        self.chosen[place.ravel(), np.repeat(np.arange(count), self.dim)] = 1

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each part, ties to the lower entry."""
        if not self.small or parts.dtype == object:
            return self._slow(parts)
        best, error = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
        for s in range(0, len(parts), BATCH):
            x = parts[s : s + BATCH]
            below, above = self.low - x[:, :, None], x[:, :, None] - self.high
            least = np.maximum(np.maximum(below, above), 0).reshape(len(x), -1).astype(np.float64)
            most = np.maximum(np.abs(below), np.abs(above)).reshape(len(x), -1).astype(np.float64)
            lower, upper = (least * least) @ self.chosen, (most * most) @ self.chosen
            room = 1 + 1e-12 * upper.max(initial=0)  # sums beyond 2^53 are rounded
            row, entry = np.nonzero(lower <= upper.min(1)[:, None] + room)
            gap = x[row] - self.entries[entry]
            distance = np.einsum("ij,ij->i", gap, gap)
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            low = np.minimum.reduceat(distance, first)
            hit = np.flatnonzero(distance == low[row])
            winner = hit[np.r_[True, row[hit][1:] != row[hit][:-1]]]
            best[s : s + BATCH], error[s : s + BATCH] = entry[winner], low
        return best, error

    def _slow(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Without bounds, with integers of any size."""
        entries = self.entries.astype(object)
        found = [min((sum((a - b) ** 2 for a, b in zip(p, e, strict=True)), k) for k, e in enumerate(entries.tolist())) for p in parts.astype(object).tolist()]
        return np.array([k for _, k in found], np.int64), np.array([d for d, _ in found], object)


def _sums(rows: DataFrame, books: Broadcast, dim: int) -> DataFrame:
    """(part, entry, n, sums): how many parts are nearest to each entry, and their sums as decimals in text, from each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, width = [Cells(b) for b in books.value], dim // PARTS
        n = np.zeros((PARTS, max(map(len, books.value))), np.int64)
        sums = np.zeros((*n.shape, width), np.int64)
        wide: dict = {}  # sums that don't fit
        seen = 0
        for b in batches:
            x = integers(b.column(0), dim)
            seen += b.num_rows
            for p in range(PARTS):
                own = x[:, p * width : (p + 1) * width]
                entry, _ = cells[p].nearest(own)
                np.add.at(n[p], entry, 1)
                if own.dtype == object or seen > 1 << 34:
                    for e, v in zip(entry.tolist(), own.tolist(), strict=True):
                        wide[p, e] = [a + int(c) for a, c in zip(wide.get((p, e), [0] * width), v, strict=True)]
                else:
                    np.add.at(sums[p], entry, own)
        part, entry = np.nonzero(n)
        whole = [[a + c for a, c in zip(sums[p, e].tolist(), wide.get((p, e), [0] * width), strict=True)] for p, e in zip(part.tolist(), entry.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]), pa.array([list(map(str, s)) for s in whole], pa.list_(pa.string()))], names=["part", "entry", "n", "sums"])

    return rows.select("vec").mapInArrow(run, "part int, entry int, n bigint, sums array<string>")


def _trained(rows: DataFrame, books: list[np.ndarray], dim: int, rounds: int) -> list[np.ndarray]:
    """The codebooks after some rounds: each entry becomes the floor of the mean of its parts, unused ones stay."""
    width = dim // PARTS
    for _ in range(rounds):
        sent = rows.sparkSession.sparkContext.broadcast(books)
        totals = [F.sum(F.get("sums", k).cast("decimal(38,0)")).alias(f"s{k}") for k in range(width)]
        found = _sums(rows, sent, dim).groupBy("part", "entry").agg(F.sum("n").alias("n"), *totals).toArrow().to_pylist()  # PARTS * ENTRIES rows
        books = [b.copy() for b in books]
        for r in found:
            mean = [int(r[f"s{k}"]) // r["n"] for k in range(width)]
            if max(map(abs, mean)) > SAFE:
                books[r["part"]] = books[r["part"]].astype(object)
            books[r["part"]][r["entry"]] = mean
    return books


def encode(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(`id_col`, code, error, label_error, codebooks_sha256) of each usable vector, and the codebooks.

    Defined cases: vectors that are null or hold null or non-finite components are dropped; zero vectors aren't; so are vectors of another
    number of components than most have (of as many, the smaller number), as they have no place in the codebooks; ValueError if that
    number isn't a multiple of PARTS. The first codebooks come from the smallest ids, null ids last, of repeated ids in order of the vector's hash; with fewer vectors than entries, there are as many
    entries as vectors. Null ids and labels pass. Components are exact at any size; an error beyond a long integer is the
    largest long one. Other columns aren't read; an empty table gives no rows and no codebooks.
    """
    spark = ship(vectors.sparkSession)
    kind = vectors.schema[vec_col].dataType.simpleString()
    rows = vectors.select(named(id_col).alias("id"), named(vec_col).alias("vec"), named(label_col).alias("label")).where(usable(F.col("vec")))
    common = rows.groupBy(F.size("vec").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    dim = common["dim"] if common else 0
    if dim % PARTS:
        raise ValueError(f"{dim} components can't be cut into {PARTS} parts")
    rows = rows.where(F.size("vec") == dim)
    first = rows.orderBy(F.asc_nulls_last("id"), F.xxhash64("vec")).limit(entries).select("vec").toArrow() if dim else None
    books: list[np.ndarray] = []
    if first is not None and first.num_rows:
        start = integers(first["vec"].combine_chunks(), dim)
        books = _trained(rows, np.split(start, PARTS, axis=1), dim, rounds)
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b.tolist() for v in e).encode()).hexdigest()
    sent = spark.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, width = [Cells(b) for b in sent.value], dim // PARTS
        for b in batches:
            x = integers(b.column(2), dim) if dim else np.zeros((b.num_rows, 0), np.int64)
            found = [c.nearest(x[:, p * width : (p + 1) * width]) for p, c in enumerate(cells)]
            codes = np.stack([e for e, _ in found], 1).astype(np.uint8) if found else np.zeros((b.num_rows, PARTS), np.uint8)
            errors = [min(int(sum(e)), _MOST) for e in zip(*(d.tolist() for _, d in found), strict=True)] if found else [0] * b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(errors, pa.int64())], names=["id", "label", "code", "error"])

    id_kind, label_kind = (vectors.schema[c].dataType.simpleString() for c in (id_col, label_col))
    coded = cut(rows.select("id", "label", F.col("vec").cast(kind).alias("vec")).mapInArrow(run, f"id {id_kind}, label {label_kind}, code string, error bigint"))
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_MOST).cast("decimal(38,0)")).cast("long")
    sums = coded.groupBy("label").agg(total.alias("label_error")).withColumnRenamed("label", "of")
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")), books


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))[0]


QUERIES = {"op13_vector_codes": op13_vector_codes}


def _oracle() -> str:
    """Four parts of each vector, four rounds and the last assignment, one after the other."""
    steps = [
        f"""v AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * x::DOUBLE) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"w AS (SELECT r, p, e[p * len(e) // {PARTS} + 1:(p + 1) * len(e) // {PARTS}] AS x FROM v, range({PARTS}) t(p))",
        f"b0 AS (SELECT p, CAST(r - 1 AS BIGINT) AS k, x AS c FROM w WHERE r <= {ENTRIES})",
    ]
    for n in range(ROUNDS + 1):
        steps.append(f"a{n} AS (SELECT p, r, x, arg_min(k, (d, k)) AS k, min(d) AS d FROM (SELECT w.p, r, x, k, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM w JOIN b{n} b ON w.p = b.p) GROUP BY p, r, x)")
        if n < ROUNDS:
            steps.append(f"""m{n} AS (SELECT p, k, list(f ORDER BY i) AS c FROM (SELECT p, k, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS f
  FROM (SELECT p, k, i, sum(y) AS s, count(*) AS n FROM (SELECT p, k, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM a{n}) GROUP BY ALL)) GROUP BY p, k)""")
            steps.append(f"b{n + 1} AS (SELECT b.p, b.k, coalesce(m.c, b.c) AS c FROM b{n} b LEFT JOIN m{n} m ON b.p = m.p AND b.k = m.k)")
    steps.append(f"h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM b{ROUNDS})")
    steps.append(f"o AS (SELECT r, string_agg(lower(lpad(to_hex(k), 2, '0')), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r)")
    return f"WITH {', '.join(steps)}\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM o JOIN v USING (r), h"


ORACLE = {"op13_vector_codes": _oracle()}
