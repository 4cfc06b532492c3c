"""Line dedup by an exact set-similarity join.

A line is the set of its words. In the order of documents and lines, a line goes if an earlier one has a Jaccard
similarity of at least THRESHOLD with it (equal lines have 1). The join is exact; its filters only leave out what can't match:

* prefix: words are ordered by rarity, and two similar lines share one of their first (rarest) words. A line of n words,
  joined with lines of at least its size, needs its first n - ceil(2t/(1+t) n) + 1 words, with smaller ones its first
  n - ceil(t n) + 1;
* length: the smaller has at least t times as many words as the larger;
* positional: what follows the shared word in both lines must be enough for the overlap that the threshold asks for;
* 128 parities of each line's words, one for each value of some bits of a word's hash, bound how many words two lines don't
  share: a word that one line lacks turns one of them. Unlike bits that any word sets, they tell long lines apart as well.

Equal lines are one entry, found by a grouping with map-side aggregation. Of large groups of alike lines not all pairs are
made: a line is first compared only with the earliest line of each of a few keys and with some lines of its family, and
the join is left to the lines that this hasn't removed. The earliest line of a key is an aggregate; a family's lines meet in
one task, each with some LEADERS of it, so a very large family is not spread. Words are compared as 64-bit hashes, lines are told
apart by two of them.

Rarity is counted over all texts in a table of fixed size by word hash; any order is right for the join, a finer one is
faster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.functions.columns import named
from rillwork.functions.shared import cut, freed
from rillwork.llm import bits

#: Entries of the rarity table, each from 0 to 15.
RARITY = 1 << 18
#: Keys of a line in the first comparison, from the end of its first words.
KEYS = 2
#: Lines whose maps differ by up to ROOM times what similar ones may, but no more than FAR bits, are of one family.
ROOM, FAR = 4, 34
#: About so many lines of a family are compared with the others of it.
LEADERS = 64
#: A line's place is its document's id and its number in one decimal: the id counted from the least long, the number in 31 bits.
_LEAST, _NUMBERS = -(1 << 63), 1 << 31


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, no, line): th tells texts of one id apart; documents without an id are the least one."""
    rows = docs.select(F.coalesce(named(id_col).cast("long"), F.lit(_LEAST)).alias("id"), named(text_col).alias("text")).where("text IS NOT NULL")
    return rows.select("id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n")).alias("no", "line"))


def _place() -> Column:
    return F.expr(f"CAST((CAST(id AS DECIMAL(20, 0)) + {-_LEAST}BD) * {_NUMBERS}BD + no AS DECIMAL(38, 0))")


def _with_words(lines: DataFrame) -> DataFrame:
    """The lines that aren't blank; asked of the line itself, as a condition on its words would have them made twice."""
    return lines.where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))


def _words(line: Column) -> Column:
    """The words of a line, and empty ones where white space meets."""
    for blank in "\t\x0b\x0c\r":
        line = F.replace(line, F.lit(blank), F.lit(" "))
    return F.split(line, " ")


def _slot(word: Column, entries: int) -> Column:
    return F.hash(word).bitwiseAND(F.lit(entries - 1))


def rarity(docs: DataFrame, text_col: str = "text", entries: int = RARITY) -> tuple[list[int], int]:
    """How common the words of each hash are, as 16 steps of a logarithm, and the step from which on half of all words are."""
    words = docs.select(F.explode(F.split(F.replace(named(text_col), F.lit("\n"), F.lit(" ")), " ")).alias("word"))
    counts = cut(words.groupBy(_slot(F.col("word"), entries).alias("at")).agg(F.count(F.lit(1)).alias("n")))
    mean = counts.agg(F.percentile_approx("n", 0.5)).first()[0] or 1
    step = F.least(F.greatest(F.floor(F.log2(F.col("n") / F.lit(mean)) * 2) + 2, F.lit(0)), F.lit(15)).cast("long")
    stepped = counts.withColumn("step", step)
    slots = stepped.groupBy(F.floor(F.col("at") / 16).cast("int").alias("slot"))
    packed = slots.agg(F.expr("bit_or(shiftleft(step, 4 * (at % 16)))").alias("packed"))
    out = [0] * entries
    for r in packed.collect():  # entries / 16 rows, a fixed number
        out[16 * r["slot"] : 16 * r["slot"] + 16] = [r["packed"] >> 4 * k & 15 for k in range(16)]
    of = {r["step"]: r["n"] for r in stepped.groupBy("step").agg(F.sum("n").alias("n")).collect()}  # 16 rows at most
    return out, min(range(1, 16), key=lambda k: abs(sum(n if step < k else -n for step, n in of.items())))


def _coded(line: Column, table: list[int], entries: int) -> Column:
    """A line's set of words as sorted longs: six bits of rarity, then 58 bits of hash. Words are looked at once."""
    held = F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")  # a constant, folded once; of short numbers, as plans print it

    def code(word: Column) -> Column:
        level = F.coalesce(F.get(held, _slot(word, entries)), F.lit(0).cast("long"))  # never null: arrays of plain longs sort faster
        return F.xxhash64(word).bitwiseAND(F.lit((1 << _HASH) - 1)).bitwiseOR(F.shiftleft(level, _HASH))

    return F.sort_array(F.array_except(F.transform(_words(line), code), F.array(code(F.lit("")))))


def _hashed(line: Column) -> Column:
    """A line's set of words, as 64-bit hashes."""
    return F.array_distinct(F.array_remove(F.transform(_words(line), lambda w: F.xxhash64(w)), F.xxhash64(F.lit(""))))


def _prefix(t: tuple[int, int]) -> str:
    a, b = t
    return f"(n - CAST((n * {a} + {b - 1}) DIV {b} AS INT) + 1)"


def _index_prefix(t: tuple[int, int], n: str) -> str:
    a, b = t
    return f"({n} - CAST(({n} * {2 * a} + {a + b - 1}) DIV {a + b} AS INT) + 1)"


def _overlap(t: tuple[int, int], m: str, n: str) -> str:
    """The least overlap of sets of m and n words with that similarity."""
    a, b = t
    return f"CAST((({m} + {n}) * {a} + {a + b - 1}) DIV {a + b} AS INT)"


def _parted(code: Column, bound: int) -> Column:
    """A line's words in order, with a bound between the rarer and the more common ones."""
    return F.sort_array(F.concat(code, F.array(F.lit(bound).cast("long"))))


def _maps(parted: Column, bound: int) -> list[Column]:
    """64 parities of the line's rarer words and 64 of its more common ones. Each word is looked at once."""
    at = F.array_position(parted, bound).cast("int")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")

    def half(words: Column) -> Column:
        return F.aggregate(words, none, lambda m, c: m.bitwiseXOR(F.call_function("shiftleft", one, c.bitwiseAND(F.lit(63)).cast("int"))))

    return [half(F.slice(parted, 1, at - 1)), half(F.slice(parted, at + 1, F.size(parted) - at))]


def _differ(x: str, y: str) -> str:
    """No more than the words that one of two lines lacks."""
    return " + ".join(f"bit_count({x}{sig} ^ {y}{sig})" for sig in _MAPS)


def _alike(x: str, y: str, need: str) -> str:
    """Whether the maps of two lines leave room for the overlap that is needed."""
    return f"{_differ(x, y)} <= {x}n + {y}n - 2 * {need}"


def _related(x: str, y: str, need: str) -> str:
    """Whether they may be of one family; those that may be alike are."""
    room = f"({x}n + {y}n - 2 * {need})"
    return f"{_differ(x, y)} <= greatest({room}, least({ROOM} * {room}, {FAR}))"


_MAPS = ("sig", "sig2")
#: Bits of a word's hash in its code.
_HASH = 58


def _first_lines(lines: DataFrame, table: list[int], middle: int, t: tuple[int, int], entries: int) -> DataFrame:
    """One row for each distinct line with words: lh, lh2, place, id and no (of its first place), times, n, sig, sig2, head (its first words).

    Lines are coded before they are grouped: their codes are half as much to shuffle as their texts.
    """
    own = ["id", "no", "place", "lh", "lh2"]
    coded = _with_words(lines).select("id", "no", _place().alias("place"), F.xxhash64("line").alias("lh"), F.xxhash64("line", F.lit("second")).alias("lh2"), _coded(F.col("line"), table, entries).alias("code"))
    sized = coded.select(*own, F.size("code").alias("n"), "code", _parted(F.col("code"), middle << _HASH).alias("parted"))
    head = F.transform(F.slice("code", 1, F.expr(_prefix(t))), lambda c: c.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))
    whole = sized.select(*own, "n", *[m.alias(sig) for m, sig in zip(_maps(F.col("parted"), middle << _HASH), _MAPS, strict=True)], head.alias("head"))
    return whole.groupBy("lh", "lh2", "n", *_MAPS, "head").agg(F.min("place").alias("place"), F.min_by("id", "place").alias("id"), F.min_by("no", "place").alias("no"), F.count(F.lit(1)).alias("times"))


def _verified(pairs: DataFrame, lines: DataFrame, t: tuple[int, int]) -> DataFrame:
    """The pairs (x, y) of hashes of lines whose similarity is high enough.

    The lines' words are taken from the texts again, only of lines that a fixed-size bit table lets through.
    """
    asked = cut(pairs.select(F.col("x").alias("lh")).unionByName(pairs.select(F.col("y").alias("lh"))).distinct())
    known = cut(bits.build(asked, F.col("lh")))
    some = bits.mark(lines.select("line", F.xxhash64("line").alias("lh")), known, F.col("lh"), "asked").where("asked")
    words = some.groupBy("lh", "line").agg(F.count(F.lit(1))).join(asked, "lh", "left_semi").select("lh", _hashed(F.col("line")).alias("code"))
    words = cut(words)
    both = pairs.join(words.select(F.col("lh").alias("x"), F.col("code").alias("a")), "x").join(words.select(F.col("lh").alias("y"), F.col("code").alias("b")), "y")
    shared = F.size(F.array_intersect("a", "b"))
    return both.where(shared * (t[0] + t[1]) >= (F.size("a") + F.size("b")) * t[0]).select("x", "y")


def _early(first: DataFrame, lines: DataFrame, t: tuple[int, int]) -> DataFrame:
    """(lh, gone): lines that an earlier one of a few removes, found with a number of comparisons that grows with the lines.

    A line is compared with the earliest line of each of its keys. Lines that are not far from such a leader are its family,
    and are compared with about LEADERS lines of it, dealt by a hash.
    """
    keys = F.array_distinct(F.transform(F.sequence(F.lit(1), F.least(F.size("head"), F.lit(KEYS))), lambda k: F.element_at("head", -k)))
    own = ["lh", "id", "no", "n", *_MAPS]
    keyed = first.select("place", *own, F.explode(keys).alias("key")).repartition("key")  # shuffled once, for the leaders and for what is compared with them
    leads = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("of"), F.min("place").alias("lead_place"), *[F.min_by(c, "place").alias(f"lead_{c}") for c in ("lh", "n", *_MAPS)]).where("of > 1")
    need = _overlap(t, "lead_n", "n")
    led = keyed.join(leads.hint("shuffle_hash"), "key").where(f"lead_lh <> lh AND {_related('lead_', '', need)} AND lead_place <> place")
    family = cut(led.select(F.col("lead_lh").alias("family"), *own, F.expr(_alike("lead_", "", need)).alias("close")).distinct())

    sizes = family.groupBy("family").agg(F.count(F.lit(1)).alias("members"))
    dealt = family.join(sizes, "family").where(F.pmod(F.xxhash64("lh"), F.greatest(F.expr(f"members DIV {LEADERS}"), F.lit(1))) == 0)
    on = f"x.family = y.family AND (x.id < y.id OR x.id = y.id AND x.no < y.no) AND {_alike('x.', 'y.', _overlap(t, 'x.n', 'y.n'))}"
    met = dealt.alias("x").join(family.alias("y"), F.expr(on)).select(F.col("x.lh").alias("x"), F.col("y.lh").alias("y"))
    pairs = cut(family.where("close").select(F.col("family").alias("x"), F.col("lh").alias("y")).unionByName(met).distinct())
    return cut(_verified(pairs, lines, t).select(F.col("y").alias("lh"), F.lit(True).alias("gone")).distinct())


@freed()
def _judged(docs: DataFrame, lines: DataFrame, text_col: str, t: tuple[int, int], entries: int) -> DataFrame:
    """(lh, lh2, first_id, first_no, gone) of the distinct lines that occur twice or that an earlier line removes: their first place, and whether one does."""
    table, middle = rarity(docs, text_col, entries)
    first = cut(_first_lines(lines, table, middle, t, entries))
    early = _early(first, lines, t)

    # The join proper: pairs whose later line isn't removed yet; x is the line of fewer words. No condition is on x
    # alone, so both sides are one exchange, read twice. `is` holds a line's words, the word's position and whether it is gone.
    packed = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.shiftleft(F.col("pos").cast("long"), 1)).bitwiseOR(F.coalesce("gone", F.lit(False)).cast("long"))
    marked = first.join(early.hint("shuffle_hash"), "lh", "left").select("lh", "id", "no", "n", "gone", *_MAPS, F.posexplode("head").alias("pos", "word"))
    marked = marked.select("word", *[F.coalesce(c, F.lit(0).cast(kind)).alias(c) for c, kind in (("lh", "long"), ("id", "long"), ("no", "int"), *[(sig, "long") for sig in _MAPS])], F.coalesce(packed, F.lit(0).cast("long")).alias("is"))  # never null: the join asks each pair less
    m, n = (f"CAST(shiftright({side}.is, 32) AS INT)" for side in "xy")
    at_x, at_y = (f"CAST(shiftright({side}.is & 4294967295, 1) AS INT)" for side in "xy")
    before, after = (f"(x.id {c} y.id OR x.id = y.id AND x.no {c} y.no)" for c in "<>")
    need = _overlap(t, m, n)
    differ = _differ("x.", "y.")
    on = (  # the first test of the maps asks a little less than the last one, but is cheaper
        f"x.word = y.word AND ({m} < {n} OR {m} = {n} AND x.lh < y.lh) AND {m} * {t[1]} >= {n} * {t[0]} AND ({differ}) * {t[0] + t[1]} <= ({m} + {n}) * {t[1] - t[0]}"
        f" AND ((y.is & 1) = 0 AND {before} OR (x.is & 1) = 0 AND {after})"
        f" AND {at_x} < {_index_prefix(t, f'least({m}, {n})')} AND least({m} - {at_x}, {n} - {at_y}) >= {need} AND {differ} <= {m} + {n} - 2 * {need}"
    )
    ends = [F.expr(f"IF({before}, {a}.lh, {b}.lh)").alias(end) for a, b, end in (("x", "y", "x"), ("y", "x", "y"))]
    pairs = marked.alias("x").join(marked.alias("y"), F.expr(on)).select(*ends).distinct()  # x is the earlier line from here on
    late = _verified(cut(pairs), lines, t).select(F.col("y").alias("lh"), F.lit(True).alias("gone"))
    gone = early.unionByName(late).distinct()

    places = first.select("lh", "lh2", F.col("id").alias("first_id"), F.col("no").alias("first_no"), "times")
    judged = places.join(gone.hint("shuffle_hash"), "lh", "left").withColumn("gone", F.coalesce("gone", F.lit(False))).where("gone OR times > 1").drop("times")
    return cut(judged, stay=True)


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: tuple[int, int] = (4, 5), entries: int = RARITY) -> DataFrame:
    """(id, th, gone, n_removed) of the texts that lose lines: the numbers of these, from 0; a null id is the least long here.

    threshold is a fraction, from 1/2 on.
    """
    lines = _lines(docs, id_col, text_col)
    judged = _judged(docs, lines, text_col, threshold, entries)
    seen = lines.select("id", "th", "no", F.xxhash64("line").alias("lh"), F.xxhash64("line", F.lit("second")).alias("lh2"))
    goes = seen.join(judged.hint("shuffle_hash"), ["lh", "lh2"]).where("gone OR id <> first_id OR no <> first_no").select("id", "th", "no")
    return goes.groupBy("id", "th").agg(F.sort_array(F.collect_set("no")).alias("gone")).withColumn("n_removed", F.size("gone"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: tuple[int, int] = (4, 5)) -> DataFrame:
    """docs with the texts that are left, in the same columns; a text all of whose lines go is empty.

    Defined cases: ids are whole numbers; a null text stays null; blank lines always stay; lines are parted at newlines and
    words at ASCII white space; equal rows (id and text) are one document and keep the same lines; rows that share an id
    only have their lines in order of number, and each keeps a line that two of them have at the same number; null ids come
    first in order, as one document; other columns pass through unread, whatever their names; an empty table stays empty.
    """
    gone = removed_lines(docs, id_col, text_col, threshold)
    text, names = named(text_col), [f"c{k}" for k in range(len(docs.columns))]
    kept = [(F.split(text, "\n") if c == text_col else named(c)).alias(k) for k, c in zip(names, docs.columns, strict=True)]
    rows = docs.select(F.coalesce(named(id_col).cast("long"), F.lit(_LEAST)).alias("id"), F.xxhash64(text).alias("th"), *kept)
    lines = names[docs.columns.index(text_col)]
    numbers = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "gone")
    left = F.when(F.col("gone").isNull(), F.col(lines)).otherwise(F.transform(numbers, lambda k: F.get(F.col(lines), k)))
    joined = rows.join(gone.hint("shuffle_hash"), ["id", "th"], "left")
    return joined.select(*[(F.array_join(left, "\n") if k == lines else F.col(k)).alias(c) for k, c in zip(names, docs.columns, strict=True)])


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed): the numbers of the lines that go, from 0, as text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    gone = removed_lines(docs).select("id", "th", "n_removed", F.array_join("gone", ",").alias("removed"))
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(_LEAST)).alias("id"), F.xxhash64("text").alias("th"), F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"))
    return rows.join(gone, ["id", "th"], "left").select("doc_id", "n_lines", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("removed", F.lit("")).alias("removed"))


QUERIES = {"op5_line_dedup": op5_line_dedup}
ORACLE = {
    "op5_line_dedup": r"""
WITH l AS (SELECT doc_id, text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no, unnest(string_split(text, chr(10))) AS line FROM documents),
d AS (SELECT line, min((doc_id, no)) AS place, list_distinct(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS words FROM l GROUP BY line),
k AS (SELECT row_number() OVER (ORDER BY place) AS r, line, place, words, len(words) AS n FROM d WHERE len(words) > 0),
w AS (SELECT r, n, unnest(words) AS word FROM k),
f AS (SELECT word, count(*) AS c FROM w GROUP BY word),
o AS (SELECT r, n, word, row_number() OVER (PARTITION BY r ORDER BY c, word) AS p FROM w JOIN f USING (word)),
x AS (SELECT * FROM o WHERE p <= n - ceil(0.8 * n - 1e-9) + 1),
c AS (SELECT DISTINCT a.r AS a, b.r AS b FROM x a JOIN x b ON a.word = b.word AND a.r < b.r AND least(a.n, b.n) * 5 >= greatest(a.n, b.n) * 4),
g AS (SELECT DISTINCT b AS r FROM c JOIN k ka ON ka.r = c.a JOIN k kb ON kb.r = c.b WHERE len(list_intersect(ka.words, kb.words)) * 9 >= (ka.n + kb.n) * 4),
j AS (SELECT l.doc_id, l.no, coalesce(g.r IS NOT NULL OR (l.doc_id, l.no) <> k.place, false) AND k.r IS NOT NULL AS goes FROM l LEFT JOIN k USING (line) LEFT JOIN g USING (r))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (goes) AS n_removed, coalesce(string_agg(no::VARCHAR, ',' ORDER BY no) FILTER (goes), '') AS removed FROM j GROUP BY doc_id"""
}
