"""Token counts by a map-side two-tier lookup.

Tier one is a broadcast table of the corpus's most frequent pre-tokens and their lengths in tokens; its size is a
parameter. Tier two is a cache in each Python worker that encodes a pre-token when it first misses and forgets all when
it is full. No pre-token is ever shuffled: each task of a scan over all texts counts its pre-tokens and sends the driver
its most frequent ones, the fewer the more tasks there are, so that the driver merges about ENTRIES in all. A pre-token of
more than LONGEST characters is in no summary, table or cache: it is encoded whenever it is met.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.functions.columns import named
from rillwork.functions.shared import ship
from rillwork.llm.pieces import SPACE, Normaliser, cutter, model_bytes, processor, vocabulary

#: Pre-tokens in tier one, in a task's summary at most and at least, in all summaries, and in a worker's cache.
FREQUENT, SUMMARY, FEWEST, ENTRIES, RECENT = 32768, 8192, 16, 1 << 20, 400_000
#: Characters of the longest pre-token that is kept; the number of its tokens fits 16 bits.
LONGEST = 64
#: Joins the pre-tokens of a summary; no pre-token but its own holds a newline.
_SEP = "\n"


class Lengths(dict):
    """Pre-token to its number of tokens: itself tier one, with tier two behind it."""

    def __init__(self, model: bytes, frequent: str, lengths: bytes):
        super().__init__(zip(frequent.split(_SEP), memoryview(lengths).cast("H"), strict=True) if frequent else ())
        self.proc, self.recent = processor(model), {}
        self.cut, self.normal = cutter(vocabulary(self.proc)), Normaliser(model)
        self[_SEP] = self.encoded(_SEP)

    def encoded(self, part: str) -> int:
        """The library puts a space before every text, so one is taken away first, or a newline shields the part."""
        if part.startswith(SPACE):
            return len(self.proc.encode(part[1:])) or 1
        return len(self.proc.encode("\n" + part)) - len(self.proc.encode("\n"))

    def __missing__(self, part: str) -> int:
        n = self.recent.get(part)
        if n is None:
            if len(part) > LONGEST:
                return self.encoded(part)
            if len(self.recent) >= RECENT:
                self.recent.clear()
            n = self.recent[part] = self.encoded(part)
        return n

    def count(self, text: str | None) -> int:
        return sum(map(self.__getitem__, self.cut.findall(self.normal(text)))) if text else 0


def _trim(counts: Counter, most: int) -> Counter:
    return Counter(dict(counts.most_common(most)))


def _pack(counts: Counter) -> pa.RecordBatch:
    return pa.record_batch({"words": [_SEP.join(counts)], "counts": [list(counts.values())]}, schema=_SUMMARY)


_SUMMARY = pa.schema([("words", pa.string()), ("counts", pa.list_(pa.int64()))])


def frequent_pretokens(docs: DataFrame, text_col: str, model: bytes, most: int = FREQUENT) -> list[str]:
    """Up to `most` pre-tokens that are frequent in the whole column; an estimate, which only speed depends on."""
    texts = docs.select(named(text_col))
    each = min(SUMMARY, max(FEWEST, ENTRIES // max(1, texts.rdd.getNumPartitions())))

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, normal, counts = cutter(vocabulary(processor(model))), Normaliser(model), Counter()
        for b in batches:
            for text in b.column(0):
                if t := text.as_py():
                    words = cut.findall(normal(t))
                    counts.update(words if max(map(len, words), default=0) <= LONGEST else [w for w in words if len(w) <= LONGEST])
                if len(counts) > 32 * SUMMARY:
                    counts = _trim(counts, 8 * SUMMARY)
        counts.pop(_SEP, None)
        if counts:
            yield _pack(_trim(counts, each))

    ship(docs.sparkSession)
    total: Counter = Counter()
    for r in texts.mapInArrow(summarise, "words string, counts array<bigint>").collect():  # one row a task
        total.update(dict(zip(r["words"].split(_SEP), r["counts"], strict=True)))
    return [w for w, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:most]]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None, limit: int = 4096) -> DataFrame:
    """One row per row of docs: `id_col`, n_bytes, n_tokens, over_limit (n_tokens > limit).

    The counts are those of the model's library on whole texts. Defined cases: a null or empty text has no bytes and no
    tokens; null and repeated ids pass through, row by row; other columns are not read; an empty table gives no rows.
    """
    model = model_bytes(model_path)
    words = frequent_pretokens(docs, text_col, model)
    first = Lengths(model, "", b"")
    lengths = memoryview(bytearray(2 * len(words))).cast("H")
    for k, w in enumerate(words):
        lengths[k] = first.encoded(w)
    table = ship(docs.sparkSession).sparkContext.broadcast((model, _SEP.join(words), lengths.tobytes()))  # FREQUENT pre-tokens of LONGEST characters at most

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiers = Lengths(*table.value)
        for b in batches:
            n = [tiers.count(t.as_py()) for t in b.column(1)]
            yield pa.record_batch([b.column(0), b.column(2), pa.array(n, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(named(id_col).alias("id"), named(text_col).alias("text"), F.coalesce(F.octet_length(named(text_col)), F.lit(0)).cast("long").alias("n_bytes"))
    out = rows.mapInArrow(count, f"id {kind}, n_bytes bigint, n_tokens bigint")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op1_token_counts": op1_token_counts}
#: SQL has no tokenizer: the query is tested against the library on whole texts.
ORACLE: dict[str, str] = {}
