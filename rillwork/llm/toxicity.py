"""Toxicity by compression distance.

Texts are compressed in windows of WINDOW words, one every STRIDE words, with dictionaries of ordinary and of toxic text. The
gain of a window is how many bytes shorter a toxic dictionary makes it than the ordinary one. The score is a logistic
function of a few statistics of a text's gains (their largest, their mean, the shares of windows above fixed gains ...).

The ordinary dictionaries are trained by zstandard on ordinary texts. Most of a toxic text is ordinary prose, and a dictionary
trained on whole toxic texts tells little, so a toxic dictionary is an ordinary one's content followed by those stretches
of the words of toxic texts whose character n-grams take a far larger share of toxic than of ordinary texts, the most frequent
last, where matches are cheapest: both compress ordinary prose alike and a gain shows only where the toxic part matches.

There are two pairs (PAIRS). One has short n-grams and a large ordinary dictionary, and finds words of their own. The other
has longer n-grams, a small ordinary dictionary, and no matches below seven bytes: it finds new words on stems that ordinary
words share, as these are not put together from short matches in ordinary prose.

The statistics that the function is fitted to are those of rows that had no part in the toxic dictionaries they are measured
with: the labelled rows are dealt over FOLDS parts, and each is measured with dictionaries made from the others.

The fit is on a sample whose size is a parameter (`toxic_rows`, `ordinary_rows`, and `longest`, the bytes of a text in it); its
texts are whole, and the scan that scores reads all texts whole.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.functions.columns import named
from rillwork.functions.shared import cut, ship

WINDOW, STRIDE, TOXIC_BYTES = 12, 4, 4096
#: The pairs of dictionaries: length of the toxic n-grams, bytes of the ordinary dictionary, shortest match in compressing.
PAIRS = ((5, 32768, 5), (7, 8192, 7))
#: Labelled rows to fit on.
TOXIC_ROWS, ORDINARY_ROWS = 1500, 4000
#: Longer texts (bytes) are scored but not fitted on, so a fit holds at most 5,500 x 128 KB.
LONGEST = 1 << 17
#: An n-gram is toxic if its mean share of the words of toxic texts is so many times that of ordinary ones.
ENRICHED, FOLDS = 20, 3
#: What an n-gram's shares in ordinary texts are at least, in millionths.
UNSEEN = 1000


def windows(text: str | None, stride: int = STRIDE) -> list[bytes]:
    words = (text or "").lower().encode().split()
    return [b" ".join(words[i : i + WINDOW]) for i in range(0, max(1, len(words) - (WINDOW - stride)), stride)]


def _compressor(content: bytes, shortest: int) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters.from_level(
        3, strategy=zstandard.STRATEGY_DFAST, min_match=shortest, window_log=17, hash_log=17, chain_log=16,
        write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
    )
    held = zstandard.ZstdCompressionDict(content)
    held.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=params)


@dataclass
class Gains:
    """Compresses windows with pairs of an ordinary and a toxic dictionary: (ordinary, toxic part) for each of PAIRS."""

    pairs: tuple[tuple[bytes, bytes], ...]

    def __post_init__(self):
        self.sizes = [(_compressor(plain, shortest).compress, _compressor(plain + part, shortest).compress) for (plain, part), (_, _, shortest) in zip(self.pairs, PAIRS, strict=True)]

    def statistics(self, text: str | None) -> tuple[float, ...]:
        cut_up = windows(text)
        out = [math.log1p(len(cut_up))]
        for plain, toxic in self.sizes:
            gain = np.fromiter((len(plain(w)) - len(toxic(w)) for w in cut_up), float, len(cut_up))
            top = np.sort(gain)[-3:]
            at_least = [int((gain >= g).sum()) for g in (1, 2, 3, 4)]
            out += [top[-1], top.mean(), gain.mean(), *(x / len(gain) for x in at_least[:3]), *(math.log1p(x) for x in at_least[1:])]
        return tuple(out)


@dataclass
class Model:
    gains: tuple[tuple[bytes, bytes], ...]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def scores(self, rows: list[tuple[float, ...]]) -> np.ndarray:
        z = (np.array(rows) - self.mean) / self.scale @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _padded(word: bytes) -> bytes:
    return b" " + word + b" "


def _split(text: str) -> list[bytes]:
    return text.lower().encode().split()


def _words(texts: list[str]) -> Counter:
    """In how many texts each word is."""
    return Counter(w for t in texts for w in set(_split(t)))


def _shares(texts: list[str]) -> Counter:
    """Each word's shares of the words of each text, summed in millionths: a long text counts as much as a short one."""
    out: Counter = Counter()
    for words in map(_split, texts):
        for w, n in Counter(words).items():
            out[w] += round(n * 1e6 / len(words))
    return out


def _grams(words: Counter, size: int, of: set[bytes] | None = None) -> Counter:
    """n-grams of words, each with the sum of its words' numbers; only those in `of`, if given."""
    out: Counter = Counter()
    for word, times in words.items():
        word = _padded(word)
        for i in range(max(1, len(word) - size + 1)):
            if of is None or word[i : i + size] in of:
                out[word[i : i + size]] += times
    return out


def _least(toxic: int) -> float:
    """In how many of so many toxic texts an n-gram must be."""
    return max(4, 0.01 * toxic) if toxic > 8 else 1


def _stretches(word: bytes, telling: set[bytes], size: int) -> list[bytes]:
    """The parts of a word that telling n-grams cover."""
    word, out = _padded(word), []
    for i in range(max(1, len(word) - size + 1)):
        if word[i : i + size] in telling:
            if out and i <= out[-1][1]:
                out[-1][1] = i + size
            else:
                out.append([i, i + size])
    return [word[i:j] for i, j in out]


def _toxic_part(words: Counter, of_toxic: Counter, toxic: int, of_plain: Counter, plain: int, size: int) -> bytes:
    """The telling stretches of the words of `toxic` texts.

    `words` says in how many of them each word is, `of_toxic` and `of_plain` are the n-grams' shares of the texts.
    """
    least = _least(toxic)
    telling = {g for g, n in of_toxic.items() if (of_plain[g] + UNSEEN) / plain < n / toxic / ENRICHED}
    found: Counter = Counter()
    for w, n in words.items():
        for x in _stretches(w, telling, size):
            found[x] += n
    return b"".join(x for x, n in sorted(found.items(), key=lambda x: (x[1], x[0])) if n >= least)[-TOXIC_BYTES:]


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; where there is too little to train on, the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(samples)[-size:]


def _logistic(x: np.ndarray, y: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton steps; the intercept is moved from the sample's odds to `prior`'s."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z, w = np.c_[(x - mean) / scale, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.05 * np.eye(len(w)), z.T @ (p - y) + 0.05 * w)
    w[-1] += math.log(prior / (1 - prior)) - math.log(y.mean() / (1 - y.mean()))
    return mean, scale, w


def train(toxic: list[str], ordinary: list[str], prior: float) -> Model | None:
    """None if either class has no text: then every score is `prior`."""
    toxic, ordinary = sorted(set(toxic)), sorted(set(ordinary) - set(toxic))
    if not toxic or not ordinary:
        return None
    folds = max(1, min(FOLDS, len(toxic), len(ordinary)))
    parts = [(toxic[k::folds], ordinary[k::folds]) for k in range(folds)]
    words, shares = [_words(bad) for bad, _ in parts], [tuple(map(_shares, part)) for part in parts]
    all_words = sum(words, Counter())
    # n-grams that can tell in any part: few, so the ordinary texts' many others are never held
    least = min(_least(len(toxic) - len(bad)) for bad, _ in parts) if folds > 1 else _least(len(toxic))
    often = [{g for g, n in _grams(all_words, size).items() if n >= least} for size, _, _ in PAIRS]
    grams = [[tuple(_grams(w, size, of) for w in part) for part in shares] for (size, _, _), of in zip(PAIRS, often, strict=True)]
    all_grams = [[sum((g[y] for g in of_size), Counter()) for y in (0, 1)] for of_size in grams]
    samples = [w for t in ordinary for w in windows(t, WINDOW)]
    plain = [_dictionary(samples, n) or b" " * 8 for _, n, _ in PAIRS]
    whole = tuple((p, _toxic_part(all_words, of[0], len(toxic), of[1], len(ordinary), size)) for p, of, (size, _, _) in zip(plain, all_grams, PAIRS, strict=True))

    x, y = [], []
    for k, (bad, good) in enumerate(parts):
        apart = whole
        if folds > 1:
            others = all_words - words[k]
            n_toxic, n_plain = len(toxic) - len(bad), len(ordinary) - len(good)
            apart = tuple((p, _toxic_part(others, of[0] - own[k][0], n_toxic, of[1] - own[k][1], n_plain, size)) for p, of, own, (size, _, _) in zip(plain, all_grams, grams, PAIRS, strict=True))
        gains = Gains(apart)
        x += [gains.statistics(t) for t in bad + good]
        y += [1.0] * len(bad) + [0.0] * len(good)
    return Model(whole, *_logistic(np.array(x), np.array(y), min(max(prior, 1e-3), 1 - 1e-3)))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.encode(named(id_col).cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS, longest: int = LONGEST) -> tuple[Model | None, float]:
    """A model from at most so many labelled rows that aren't held out, picked by a hash of the id; and the base rate.

    Of an id that several documents have, the text of least hash is taken, whole; texts of more than `longest` bytes are not.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & named(id_col).isNotNull() & ~held_out(id_col)).groupBy(named(id_col).alias("label_id")).agg(F.max("toxic").alias("label"))
    rates = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = rates.get(1, 0) / max(1, sum(rates.values()))
    picked = [known.where(F.col("label") == y).orderBy(F.xxhash64("label_id"), "label_id").limit(n) for y, n in ((1, toxic_rows), (0, ordinary_rows))]
    ids = cut(picked[0].unionByName(picked[1]))
    # At most toxic_rows + ordinary_rows ids, so they can be broadcast and no other text is shuffled.
    texts = docs.select(named(id_col).alias("label_id"), named(text_col).alias("text")).where(F.octet_length("text") <= longest).join(F.broadcast(ids), "label_id")
    rows = texts.groupBy("label_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("label", "text")

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: tuple[list[str], list[str]] = ([], [])
        for b in batches:
            for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                of[label].append(text)
        yield pa.record_batch({"model": pa.array([pickle.dumps(train(of[1], of[0], prior))], pa.binary())})

    # One task fits the sample, whose size is bounded; the driver gets the model alone.
    ship(docs.sparkSession)
    made = rows.repartition(1).mapInArrow(fitted, "model binary").first()
    return (pickle.loads(made["model"]) if made else None), prior


def score(docs: DataFrame, model: Model | None, prior: float, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), name: str = "score") -> DataFrame:
    """One row per row of docs: `id_col`, the columns in `keep`, and the score from 0 to 1, called `name`.

    Defined cases: a null text is an empty one, which is one empty window; null and repeated ids pass row by row; texts
    of any length are cut into windows whole; other columns aren't read; an empty table gives no rows; without labelled
    rows of both classes every score is the base rate. ValueError if a column that is kept has the score's name.
    """
    kept = list(dict.fromkeys((id_col, *keep)))
    if name in kept:
        raise ValueError(f"a column is called {name} already")
    sent = ship(docs.sparkSession).sparkContext.broadcast(model)  # four dictionaries, 88 KB at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        gains = Gains(m.gains) if m else None
        for b in batches:
            texts = b.column(b.num_columns - 1)
            s = m.scores([gains.statistics(t.as_py()) for t in texts]) if m and b.num_rows else np.full(b.num_rows, prior)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s, pa.float64())], names=[*[f"c{k}" for k in range(len(kept))], "score"])

    kinds = ", ".join(f"c{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(kept))
    rows = docs.select(*[named(c).alias(f"c{k}") for k, c in enumerate(kept)], named(text_col).alias("whole_text"))
    return rows.mapInArrow(run, f"{kinds}, score double").select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(kept)], F.col("score").alias(name))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model, prior = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model, prior).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op4_toxicity": op4_toxicity}
#: SQL has no compressor: the query is tested by its accuracy on held-out rows.
ORACLE: dict[str, str] = {}
