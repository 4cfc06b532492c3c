"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The machine is a composition of four, compiled from the model's file:

* the normaliser (see pieces.py), which spells spaces as pieces do and puts one before the text if the model says so;
* the pieces: one arc for each piece of the vocabulary, reading its characters and writing its id;
* byte fallback: for a character without a piece, one arc that reads it and writes the ids of its UTF-8 bytes;
* an acceptor of pairs of neighbouring arcs, which gives the tropical weight 0 to a pair that the model's merges leave as
  it is and infinity to every other pair.

The model is a BPE model: its piece scores rank merges and are not path weights, so the pair acceptor carries them. A
sequence of pieces is the model's encoding exactly if each pair of neighbours, merged alone, stays that pair: the first
merge across a border in the whole text would also be made within that pair alone.

A text is composed with the machine as it is read. A state is a position with the last arc; its distance is the least, over
the arcs that reach it, of the distance before plus the arc's weight (min and plus, the tropical semiring), and states
at infinity are not kept. By the property above, a prefix has one path of finite weight, so a position keeps one state.

No piece crosses from one pre-token into the next (see pieces.py), so each pre-token is a composition of its own, and the
worker keeps the latest paths.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.functions.columns import named
from rillwork.functions.shared import ship
from rillwork.llm.pieces import SPACE, Normaliser, cutter, model_bytes, only_merges, processor, slices, vocabulary

#: Paths that a worker keeps, the characters of the longest pre-token among them, and pair weights: some 60 MB at most.
#: Bytes of texts in work at a time.
PATHS, LONGEST, PAIRS, BYTES = 250_000, 64, 250_000, 1 << 21
INFINITY = float("inf")


class Merges(dict):
    """The pair acceptor: the weights of two neighbouring arcs by left << 20 | right, each found when first asked for.

    Seen from its end, a piece is a series of ever shorter pieces, each there from the merge that makes it to the merge that
    takes it into the next; so it is from its start. Two pieces are merged across their border if at some time one of the
    first's last parts and one of the second's first parts stood there together and made a piece of an earlier merge
    than those that took them away.
    """

    def __init__(self, names: list[str], rank: dict[str, int]):
        super().__init__()
        self.names, self.rank = names, rank
        self.ends: dict[int, list[tuple[str, int]]] = {}
        self.starts: dict[int, list[tuple[str, int]]] = {}

    def split(self, text: str) -> tuple[str, str] | None:
        """The two pieces whose merge ends the making of a piece; None if the merges of its text end otherwise."""
        parts, rank, none = list(text), self.rank, 1 << 40
        while len(parts) > 2:
            scores = [rank.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
            if (best := min(scores)) == none:
                return None
            k = scores.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return (parts[0], parts[1]) if parts[0] + parts[1] in rank else None

    def series(self, text: str, side: int) -> list[tuple[str, int]]:
        """The parts of a piece at its start (side 0) or end (1), the longest first, each with the rank of its making."""
        out = []
        while len(text) > 1:
            out.append((text, self.rank[text]))
            text = self.split(text)[side]
        return [*out, (text, -1)]

    def __missing__(self, pair: int) -> float:
        if len(self) >= PAIRS:
            self.clear()
        self[pair] = value = self.weight(pair >> 20, pair & 0xFFFFF)
        return value

    def weight(self, left: int, right: int) -> float:
        if max(left, right) >= len(self.names):  # the start of a path and what byte fallback reads take no part in merges
            return 0.0
        a, b = self.ends.get(left), self.starts.get(right)
        if a is None:
            a = self.ends[left] = self.series(self.names[left], 1)
        if b is None:
            b = self.starts[right] = self.series(self.names[right], 0)
        rank, i, j = self.rank, 0, 0
        until_a = until_b = 1 << 40
        (x, made_x), (y, made_y) = a[0], b[0]
        while True:
            merge = rank.get(x + y)
            # of equal merges the leftmost is first: one within the first piece before this one, this one before the second's
            if merge is not None and merge < until_a and merge <= until_b:
                return INFINITY
            if made_x > made_y:
                until_a, i = made_x, i + 1
                x, made_x = a[i]
            elif made_y >= 0:
                until_b, j = made_y, j + 1
                y, made_y = b[j]
            else:
                return 0.0


class Transducer(dict):
    """Pre-token to the bytes of its ids (array code `code`); a missing one is composed and searched.

    Arcs are numbers: a piece's id, the next number for no piece (where a path starts), and the one after for byte fallback.
    """

    def __init__(self, model: bytes):
        super().__init__()
        proc = processor(model)
        size = proc.get_piece_size()
        pieces = vocabulary(proc)
        only_merges(proc, model)
        self.cut, self.normal = cutter(pieces), Normaliser(model)
        # a lower score is a later merge; ids of equal score keep their order
        order = sorted((i for p, i in pieces.items() if len(p) > 1), key=lambda i: (-proc.get_score(i), i))
        self.start, self.fallback, names = size, size + 1, [""] * size
        for p, i in pieces.items():
            names[i] = p
        self.reads = list(map(len, names))
        self.merges = Merges(names, {names[i]: k for k, i in enumerate(order)})
        self.single = {p: i for p, i in pieces.items() if len(p) == 1}
        self.bytes = {int(proc.id_to_piece(i)[1:-1], 16): i for i in range(size) if proc.is_byte(i)}
        self.code, self.kind = ("H", np.uint16) if size <= 65536 else ("I", np.uint32)
        self.unknown = proc.unk_id()
        # the arcs of two characters or more: all that end at a position, the longest first
        self.arcs = ahocorasick.Automaton()
        for i in order:
            self.arcs.add_word(names[i], (len(names[i]), i))
        self.arcs.make_automaton()
        # decoding reads the machine backwards: from ids to bytes
        self.spelt = [p.replace(SPACE, " ").encode() for p in names]
        self.spaced = {i for p, i in pieces.items() if p[0] == SPACE}
        for b, i in self.bytes.items():
            self.spelt[i] = bytes([b])
        if self.unknown >= 0:
            self.spelt[self.unknown] = " ⁇ ".encode()
        self.older: dict[str, bytes] = {}

    def shortest(self, text: str) -> list[int]:
        """The arcs of the shortest path over a pre-token: relaxation over min and plus, position by position.

        A position's distance is the least of its arcs' starts' distances plus the weights. Weights aren't negative, so an arc
        that leaves the distance 0 ends the search there, and the arc of the position's own character, the last to be
        looked at, is only weighed where none did.
        """
        weights, single, fallback = self.merges, self.single, self.fallback
        last, back, least, known = [self.start], [0], [0.0], 0
        for c in text:
            last.append(single.get(c, fallback))
            back.append(1)
            least.append(INFINITY)
        for at, (length, arc) in self.arcs.iter(text):  # all arcs, in order of their ends
            while known < at:
                known += 1
                if least[known] == INFINITY:
                    least[known] = least[known - 1] + weights[last[known - 1] << 20 | last[known]]
            end = at + 1
            if least[end] > 0.0 and (distance := least[end - length] + weights[last[end - length] << 20 | arc]) < least[end]:
                last[end], back[end], least[end] = arc, length, distance
        out, end = [], len(text)
        while end:
            out.append(last[end])
            end -= back[end]
        out.reverse()
        return out

    def compute(self, part: str) -> bytes:
        arcs = self.shortest(part)
        if self.fallback not in arcs:
            return array(self.code, arcs).tobytes()
        ids, at = array(self.code), 0
        for arc in arcs:
            if arc != self.fallback:
                ids.append(arc)
                at += self.reads[arc]
            else:
                ids.extend(map(self.bytes.__getitem__, part[at].encode()) if self.bytes else [self.unknown])
                at += 1
        return ids.tobytes()

    def __missing__(self, part: str) -> bytes:
        """Two halves are kept: when the newer one is full, the older one is forgotten."""
        value = self.older.get(part)
        if value is None:
            value = self.compute(part)
        if len(part) <= LONGEST:
            if len(self) >= PATHS // 2:
                self.older = dict(self)
                self.clear()
            self[part] = value
        return value

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, self.cut.findall(self.normal(text)))) if text else b""

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: bytes that aren't UTF-8 become U+FFFD one by one, and the space put first goes."""
        raw = b"".join(map(self.spelt.__getitem__, ids.tolist()))
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            text = raw.decode("utf-8", "surrogateescape")
            text = "".join("�" if "\udc80" <= c <= "\udcff" else c for c in text)
        return text[1:] if text[:1] == " " and int(ids[0]) in self.spaced else text


@lru_cache(maxsize=1)
def machine_of(model: bytes) -> Transducer:
    """The worker's machine: what it has learnt serves its later tasks too."""
    return Transducer(model)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None, keep_text: bool = False) -> DataFrame:
    """One row per row of docs: `id_col`, n_tokens, ids (array<int>), round_trip, and with keep_text the decoded text.

    round_trip says that decoding the ids gives the text back (a U+2581 in it comes back as the space it stands for).
    Defined cases: a null or empty text has no ids and its round trip holds; null and repeated ids pass row by row;
    texts of any length are searched whole; other columns are not read; an empty table gives no rows.
    """
    model = ship(docs.sparkSession).sparkContext.broadcast(model_bytes(model_path))  # one model file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = machine_of(model.value)
        for batch in batches:
            for b in slices(batch, 1, BYTES):
                coded, same, texts = [], [], []
                for t in b.column(1).to_pylist():
                    coded.append(machine.encode(t))
                    back = machine.decode(np.frombuffer(coded[-1], machine.kind))
                    same.append(back == (t or "").replace(SPACE, " "))
                    if keep_text:
                        texts.append(back)
                width = np.dtype(machine.kind).itemsize
                n = np.array([len(c) // width for c in coded], np.int32)
                values = np.frombuffer(b"".join(coded), machine.kind).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(values))
                columns = {"id": b.column(0), "n_tokens": pa.array(n.astype(np.int64)), "ids": ids, "round_trip": pa.array(same, pa.bool_())}
                yield pa.RecordBatch.from_pydict(columns | ({"text": pa.array(texts, pa.string())} if keep_text else {}))

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(named(id_col).alias("id"), named(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_tokens bigint, ids array<int>, round_trip boolean" + ", text string" * keep_text).withColumnRenamed("id", id_col)


def decode(coded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model_path: str | None = None) -> DataFrame:
    """(id, text) of ids; null ids give an empty text, as no ids do."""
    model = ship(coded.sparkSession).sparkContext.broadcast(model_bytes(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = machine_of(model.value)
        for b in batches:
            texts = [machine.decode(np.array(ids or (), np.int64)) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"id": b.column(0), "text": pa.array(texts, pa.string())})

    kind = coded.schema[id_col].dataType.simpleString()
    return coded.select(named(id_col).alias("id"), named(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op2_sentencepiece": op2_sentencepiece}
#: SQL has no tokenizer: tested against the library and by the round trip.
ORACLE: dict[str, str] = {}
