"""SimHash near-dedup with deletion-variant signatures.

A fingerprint's 64 bits are cut into five segments. If two fingerprints differ in at most four bits, some segment is
equal in both while the next one round the circle differs in at most one bit:

* at least one segment is equal, for four bits can't touch all five;
* if two neighbours are equal, the first of them will do;
* else one or two segments are equal, no two of them neighbours, and the other three or four differ. With one equal
  segment the four others differ in one bit each. With two, the three others share four bits, so at most one of them
  differs in two, and the followers of the two equal ones are not the same segment: one of these differs in one bit.

So each fingerprint is filed under 64 keys: for each segment, the segment itself with each one-wildcard variant of the
next one. Fingerprints that link meet under an equal key, of 24 or 25 fixed bits, and are verified there.

Equal fingerprints are one entry, whatever their number. Under a key, at most DENSE entries are compared pair by pair; a
larger run is walked from entry to entry, each comparing itself with those that no walk has reached yet, and gives a
spanning forest of all its links, so a large group of near copies costs little more than its size.

Four bits of 64 are copies of a Jaccard similarity of about 0.96. `similar_groups` finds less similar texts, from 0.8 of their
sets of five-word shingles on. What meets under a fingerprint's key and differs in at most NEAR bits is verified on the
shingles themselves. The pairs whose fingerprints share no key are met under their rarest shingles: of two sets with that similarity,
one of the first fifth of each is the same, in any order that is the same for all (a prefix filter). Large runs are walked
by fingerprints first, of which WIDE bits may differ, and what is verified of that becomes one group. Then, in runs of any size, all
entries of different groups are compared by what no similar pair can break: the sizes of their sets, and the parities of
their hashes by FOLDS * 64 slots, which differ in no more slots than the sets do in hashes. What is left is verified, so no pair is missed.

Before two sets are compared, whatever way they met, so are their sizes and their parities by as many slots as the larger set has
hashes: a 64th of the sets' bytes, which leaves few pairs of a similarity below 0.7. Only what is left carries whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillwork.functions.columns import named
from rillwork.functions.shared import cut, freed, ship
from rillwork.llm import bits as bit_table
from rillwork.llm.links import components

BITS, SEGMENTS = 4, (13, 13, 13, 13, 12)
DENSE = 48
#: Bits that may differ where pairs are verified on their shingles: under a key of fingerprints, and under a shingle. At a
#: similarity of 0.8 fingerprints differ in 9.7 bits on average, with a deviation of 2.9.
NEAR, WIDE = 8, 21
#: Entries of the table of frequent shingles, and entries of a shingle's run that are held at a time.
SLOTS, RUN = 1 << 20, 1 << 14
#: Longs of a set's parities, and entries of a run's block where all are compared.
FOLDS, BLOCK = 4, 256
#: Pairs are verified in so many steps one after the other: each pair carries a whole set, and a step's shuffle files go with its end.
STEPS = 4


def shingles(text: str | None, words_each: int) -> np.ndarray:
    """The hashes of the text's word shingles in order; of a text without words that of the empty shingle."""
    words = (text or "").encode().lower().split()  # of bytes: only A-Z and only ASCII white space
    if not words:
        return np.array([xxhash.xxh64_intdigest(b"", 42)], np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(words) - words_each + 1)
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), ends[min(words_each, len(words)) - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], 42) for a, b in spans), np.uint64, n)


def _majority(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 16384):
        block = hashes[k : k + 16384].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words_each: int = 4) -> int:
    """Bit k is set if it is in more than half of the hashes of the text's word shingles, repeats included; 0 without words."""
    return _majority(shingles(text, words_each)) if text and text.encode().split() else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 4) -> DataFrame:
    """(id, fp) for every row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), words_each) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(named(id_col).alias("id"), named(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp bigint")


def _keys(fp: Column) -> list[Column]:
    """The keys of a fingerprint: turned so that a segment and the next are its lowest bits, one bit of the next cleared."""
    keys, at = [], 0
    for k, own in enumerate(SEGMENTS):
        after = SEGMENTS[(k + 1) % len(SEGMENTS)]
        turned = F.shiftrightunsigned(fp, at).bitwiseOR(F.shiftleft(fp, 64 - at)) if at else fp
        for wild in range(after):
            fixed = ((1 << (own + after)) - 1) & ~(1 << (own + wild))
            keys.append(turned.bitwiseAND(F.lit(fixed)).bitwiseOR(F.lit(len(keys) << 32)))
        at += own
    return keys


def _walk(fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, first) by place: links that join what is linked within the run, each entry met removing its neighbours from
    those left; and the first entry of each part that is joined so."""
    a, b, first, left = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [], np.arange(len(fps))
    while left.size:
        stack, left = [left[:1]], left[1:]
        first.append(stack[0][0])
        while stack and left.size:
            for x in stack.pop():
                near = np.bitwise_count(fps[left] ^ fps[x]) <= bits
                if near.any():
                    found, left = left[near], left[~near]
                    a.append(np.full(found.size, x))
                    b.append(found)
                    stack.append(found)
                if not left.size:
                    break
    return np.concatenate(a), np.concatenate(b), np.array(first, np.int64)


def _forest(fps: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    a, b, _ = _walk(fps, bits)
    return [(fps[a], fps[b])]


def _links(keys: np.ndarray, fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links (a, b) under equal keys; keys are sorted."""
    edge = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
    sizes = np.diff(edge)
    found = []
    dense = sizes > DENSE
    for k in np.flatnonzero(dense):
        found += _forest(fps[edge[k] : edge[k + 1]], bits)
    if dense.any():
        small = ~np.repeat(dense, sizes)
        keys, fps, sizes = keys[small], fps[small], sizes[~dense]
    for d in range(1, int(sizes.max(initial=1))):
        same = np.flatnonzero(keys[d:] == keys[:-d])
        if not same.size:
            break
        near = same[np.bitwise_count(fps[same] ^ fps[same + d]) <= bits]
        found.append((fps[near], fps[near + d]))
    if not found:
        return fps[:0], fps[:0]
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def link(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp` that differ in at most `bits` bits.

    Not every pair: enough of them that what is linked stays connected. Up to four bits none is missed; with more, those
    are found that share a key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(parts: list) -> pa.RecordBatch:
            a, b = _links(*(np.concatenate(x) for x in zip(*parts, strict=True)), bits)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        held: list = []  # the run of one key, which may go on in the next batch
        for batch in batches:
            keys, fps = (np.array(c) for c in batch.columns)
            fps = fps.view(np.uint64)
            last = int(np.searchsorted(keys, keys[-1])) if keys.size else 0
            if held and keys.size and keys[0] != held[0][0][0]:
                yield out(held)
                held = []
            if last:
                yield out([*held, (keys[:last], fps[:last])])
                held = []
            if keys.size:
                held.append((keys[last:], fps[last:]))
        if held:
            yield out(held)

    ship(fps.sparkSession)
    filed = fps.select(F.explode(F.array(*_keys(F.col("fp")))).alias("key"), "fp")
    return filed.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a bigint, b bigint").distinct()


@freed()
def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 4, bits: int = BITS) -> DataFrame:
    """One row per row of docs: `id_col`, fingerprint (16 hexadecimal digits), component_id.

    Two rows link if their fingerprints differ in at most `bits` bits; component_id is the smallest id reachable.
    Defined cases: a null text is an empty one; texts without words have the fingerprint zero and link like others; a
    null id takes part, but is never a component_id unless all ids of its component are null; rows that repeat an id
    each have their text's component; other columns are not read; an empty table gives no rows.
    """
    rows = cut(fingerprints(docs, id_col, text_col, words_each), stay=True)
    distinct = cut(rows.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(link(distinct, bits)).select(F.col("node").alias("fp"), "root")
    tied = cut(distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    lowest = tied.groupBy("root").agg(F.min("least").alias("component_id"))
    of = cut(tied.join(lowest, "root").select("fp", "component_id"), stay=True)
    return rows.join(of, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def frequent(texts: DataFrame, words_each: int) -> np.ndarray:
    """How frequent the shingles of each of SLOTS hashes are, as steps of a logarithm; 0 for most.

    A task reports the slots that are frequent in it. Any table gives a right order of shingles, a better one a faster.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.int64)
        for b in batches:
            for t in b.column(0):
                np.add.at(counts, np.unique(shingles(t.as_py(), words_each)) & np.uint64(SLOTS - 1), 1)
        often = np.flatnonzero(counts >= max(4, 8 * counts.mean()))
        yield pa.RecordBatch.from_arrays([pa.array(often.astype(np.int32)), pa.array(counts[often])], names=["slot", "n"])

    found = texts.select("text").mapInArrow(run, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # SLOTS at most
    levels = np.zeros(SLOTS, np.uint8)
    levels[found["slot"].to_numpy()] = 1 + np.log2(found["n"].to_numpy().astype(float))
    return levels


def first_shingles(own: np.ndarray, levels: np.ndarray, threshold: tuple[int, int]) -> np.ndarray:
    """Of a set of hashes the rarest, so many that sets of that similarity share one."""
    part, whole = threshold
    n = len(own) - -(-len(own) * part // whole) + 1
    return own[np.lexsort((own, levels[own & np.uint64(SLOTS - 1)]))[:n]]


def _met(numbers: np.ndarray, fps: np.ndarray, groups: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, kept): places of the entries of one run that are near and not of one group yet, and entries that stand for all.

    Up to DENSE entries all are compared. Of more, a group is one entry, and the walk joins them.
    """
    if len(fps) <= DENSE:
        a, b = np.triu_indices(len(fps), 1)
        near = (np.bitwise_count(fps[a] ^ fps[b]) <= bits) & (groups[a] != groups[b])
        return a[near], b[near], np.arange(len(fps))
    one = np.sort(np.unique(groups, return_index=True)[1])  # in the run's order
    a, b, first = _walk(fps[one], bits)
    return one[a], one[b], one[first]


def meet(keyed: DataFrame, bits: int = WIDE) -> DataFrame:
    """(a, b) with a < b: numbers of entries (key, pos, number, fp, group) that meet under a key and differ in at most `bits` bits.

    Of a large run not every pair: those come first for which the key is among the first shingles, that is, which have few
    rarer ones, as the text that the others are edited from; the walk compares the others with them. It goes in pieces of
    RUN, of which what stands for the others is compared with the next piece, so a task's memory is bounded, and its time
    grows with the run where it is of copies.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.int64)]

        def out(last: bool) -> pa.RecordBatch:
            """Handles the runs held but the last one, which may go on; of that one only what stands for it stays once it is long."""
            nonlocal held
            key, number, fp, group = held
            edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True]) if key.size else np.zeros(1, np.int64)
            a, b, rest = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.zeros(0, np.int64)
            for s, e in zip(edge[:-1], edge[1:], strict=True):
                if e == key.size and not last and e - s < RUN:
                    rest = np.arange(s, e)
                    break
                if e - s > 1:
                    x, y, kept = _met(number[s:e], fp[s:e], group[s:e], bits)
                    a.append(number[s + x])
                    b.append(number[s + y])
                    rest = s + kept if e == key.size and not last else rest
            held = [c[rest] for c in held]
            x, y = np.concatenate(a), np.concatenate(b)
            pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            key, number, fp, group = (np.array(c) for c in batch.columns)
            held = [np.concatenate(c) for c in zip(held, (key, number, fp.view(np.uint64), group), strict=True)]
            if held[0].size >= RUN:
                yield out(False)
        yield out(True)

    ship(keyed.sparkSession)
    dealt = keyed.select("key", "pos", "number", "fp", "group").repartition("key").sortWithinPartitions("key", "pos", "number")
    return dealt.drop("pos").mapInArrow(run, "a bigint, b bigint").distinct()


def parities(own: np.ndarray, slots: int = 64 * FOLDS) -> np.ndarray:
    """For each bit of these longs, FOLDS of them or as many as hold `slots`, whether an odd number of the set's hashes falls on it."""
    odd = np.bincount((own >> np.uint64(40)).astype(np.int64) % slots, minlength=slots) % 2
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8")


def wide_parities(own: np.ndarray) -> np.ndarray:
    """The set's parities by slots that grow with it: the power of two from its size on, 256 at least."""
    return parities(own, 1 << max(8, (len(own) - 1).bit_length()))


def may_match(threshold: tuple[int, int]) -> Column:
    """Whether size_a, wide_a and size_b, wide_b leave room for that similarity, which is over 1/2.

    Sizes that do differ by less than a factor of two, so one of the parities may have to be folded once: slots that lie a half
    apart are one slot of the shorter kind.
    """
    part, whole = threshold
    less, more, both = F.least("size_a", "size_b"), F.greatest("size_a", "size_b"), F.col("size_a") + F.col("size_b")

    def shorter(own: str, other: str) -> Column:
        half = F.floor(F.size(own) / 2).cast("int")
        folded = F.zip_with(F.slice(own, 1, half), F.slice(own, half + 1, half), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(own) > F.size(other), folded).otherwise(F.col(own))

    odd = F.zip_with(shorter("wide_a", "wide_b"), shorter("wide_b", "wide_a"), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    differing = F.aggregate(odd, F.lit(0), lambda n, x: n + x)
    return F.when(less * whole >= more * part, differing * (part + whole) <= both * (whole - part)).otherwise(False)


def unlike(shared: DataFrame, facts: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """(a, b) with a < b: all pairs of entries (key, number, group) under a key that may be similar and aren't of one group.

    facts has each number's `size` and parities `fold0`... A run's largest group isn't compared with itself, and what is
    compared is dealt into blocks, so the work of a key is that of two blocks.
    """
    part, whole = threshold
    sizes = shared.groupBy("key", "group").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max_by("group", F.struct("n", "group")).alias("top"), F.sum("n").alias("all"), F.max("n").alias("most"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    mixed = sizes.where(F.col("most") < F.col("all")).select("key", "top", blocks(F.col("all") - F.col("most")).alias("across"), blocks(F.col("all")).alias("down"))
    entry = shared.join(mixed, "key").join(facts, "number")
    own = lambda n: F.pmod(F.xxhash64("number"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    given = ["number", "group", "size", *(f"fold{k}" for k in range(FOLDS))]
    x = entry.where("group <> top").select("key", own("across").alias("across"), every("down").alias("down"), *[F.col(c).alias(f"x_{c}") for c in given])
    y = entry.select("key", every("across").alias("across"), own("down").alias("down"), F.col("group").eqNullSafe(F.col("top")).alias("is_top"), *[F.col(c).alias(f"y_{c}") for c in given])
    differing = sum((F.bit_count(F.col(f"x_fold{k}").bitwiseXOR(F.col(f"y_fold{k}"))) for k in range(FOLDS)), F.lit(0))
    less, more = F.least("x_size", "y_size"), F.greatest("x_size", "y_size")
    fits = (less * whole >= more * part) & (differing * (part + whole) <= (less + more) * (whole - part))
    met = x.join(y, ["key", "across", "down"]).where((F.col("x_group") != F.col("y_group")) & (F.col("is_top") | (F.col("x_number") < F.col("y_number"))) & fits)
    return met.select(F.least("x_number", "y_number").alias("a"), F.greatest("x_number", "y_number").alias("b")).distinct()


@freed()
def similar_groups(rows: DataFrame, number: str, text: str, words_each: int = 5, threshold: tuple[int, int] = (4, 5)) -> DataFrame:
    """(number, group) of rows told apart by the long `number`: group is the smallest number of those reachable by similar pairs.

    Similar are texts of equal words (but for the case of A-Z), and pairs whose sets of shingles have a Jaccard similarity of
    `threshold` or more; every pair is verified. Not every pair is made: what is joined already isn't compared again. No
    group is missed by that. Texts without words are equal.
    """
    part, whole = threshold
    known = ["fp", "size", *(f"fold{k}" for k in range(FOLDS))]
    ship(rows.sparkSession)
    texts = rows.select(named(number).alias("number"), named(text).alias("text"))
    sent = rows.sparkSession.sparkContext.broadcast(frequent(texts, words_each))  # SLOTS bytes

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, fps, keys, wide = np.empty(b.num_rows, np.uint64), np.empty(b.num_rows, np.uint64), [], []
            sizes, folds = np.empty(b.num_rows, np.int32), np.empty((b.num_rows, FOLDS), np.int64)
            for k, t in enumerate(b.column(1)):
                t = t.as_py()
                own = shingles(t, words_each)
                words[k], fps[k] = xxhash.xxh64_intdigest(b" ".join((t or "").encode().lower().split()), 7), _majority(own)
                own = np.unique(own)
                sizes[k], folds[k] = len(own), parities(own)
                wide.append(wide_parities(own))
                keys.append(first_shingles(own, sent.value, threshold).view(np.int64))
            columns = [b.column(0), pa.array(words.view(np.int64)), pa.array(fps.view(np.int64)), pa.array(sizes), *map(pa.array, folds.T), *(pa.array(c, pa.list_(pa.int64())) for c in (wide, keys))]
            yield pa.RecordBatch.from_arrays(columns, names=["number", "words", *known, "wide", "keys"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.unique(shingles(t.as_py(), words_each)).view(np.int64) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64()))], names=["number", "set"])

    @freed()
    def verified(edges: DataFrame) -> DataFrame:
        marks = prints.select("number", "size", "wide")
        marked = edges.join(marks.toDF("a", "size_a", "wide_a"), "a").join(marks.toDF("b", "size_b", "wide_b"), "b")
        edges = cut(marked.where(may_match(threshold)).select("a", "b"))
        asked = cut(edges.select(F.col("a").alias("number")).unionByName(edges.select(F.col("b").alias("number"))).distinct())
        key = F.xxhash64("number")
        some = bit_table.mark(texts, cut(bit_table.build(asked, key)), key, "asked").where("asked").select("number", "text")  # so few other texts are shuffled
        held = cut(some.join(asked, "number", "left_semi").mapInArrow(sets, "number bigint, set array<bigint>"))

        def step(k: int) -> DataFrame:
            some = edges.where(F.pmod(F.xxhash64("a", "b"), F.lit(STEPS)) == k)
            both = some.join(held.toDF("a", "set_a"), "a").join(held.toDF("b", "set_b"), "b")
            return cut(both.where(F.size(F.array_intersect("set_a", "set_b")) * (part + whole) >= (F.size("set_a") + F.size("set_b")) * part).select("a", "b"), stay=True)

        return reduce(DataFrame.unionByName, [step(k) for k in range(STEPS)])

    prints = cut(texts.mapInArrow(sketch, f"number bigint, words bigint, fp bigint, size int, {', '.join(f'fold{k} bigint' for k in range(FOLDS))}, wide array<bigint>, keys array<bigint>"))
    distinct = cut(prints.groupBy("words").agg(F.min("number").alias("number"), F.min_by(F.struct(*known), "number").alias("of")).select("words", "number", "of.*"))

    reps = cut(distinct.groupBy("fp").agg(F.min("number").alias("rep")))
    same = distinct.join(reps, "fp").where("number <> rep").select(F.col("rep").alias("a"), F.col("number").alias("b"))
    pairs = link(reps.select("fp"), NEAR).join(reps.toDF("a", "at_a"), "a").join(reps.toDF("b", "at_b"), "b").select(F.least("at_a", "at_b").alias("a"), F.greatest("at_a", "at_b").alias("b"))
    joined = cut(components(verified(same.unionByName(pairs).distinct())).toDF("b", "a"))

    def grouped(df: DataFrame) -> DataFrame:
        return df.join(joined.toDF("number", "root"), "number", "left").withColumn("group", F.coalesce("root", "number")).drop("root")

    keyed = prints.select("number", "keys").join(grouped(distinct.select("number")), "number").select(F.posexplode("keys").alias("pos", "key"), "number", "group")
    run = Window.partitionBy("key")
    shared = keyed.withColumns({"least": F.min("group").over(run), "most": F.max("group").over(run), "n": F.count(F.lit(1)).over(run)})
    shared = cut(shared.where("least < most").select("key", "pos", "number", "group", "n"))  # few shingles are in two groups
    walked = verified(meet(shared.where(F.col("n") > DENSE).join(distinct.select("number", "fp"), "number")))
    joined = cut(components(joined.unionByName(walked)).toDF("b", "a"))
    rest = verified(unlike(grouped(shared.select("key", "number")), distinct.select("number", *known[1:]), threshold))
    roots = components(joined.unionByName(rest)).toDF("first", "root")
    of_text = distinct.select("words", F.col("number").alias("first")).join(roots, "first", "left").select("words", F.coalesce("root", "first").alias("group"))
    return cut(prints.select("number", "words").join(of_text, "words").select("number", "group"), stay=True)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op9_simhash": op9_simhash}
#: SQL has no fingerprints of this kind: tested against brute force.
ORACLE: dict[str, str] = {}
