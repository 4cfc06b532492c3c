"""Mixing sources to target weights by temperature.

A source's share of the tokens is raised to an exponent between 0 (all sources alike) and 1 (as they are), and the results
are normalised to weights. The exponent is found by bisection: the largest one whose weights reach a target entropy, or
the smallest one that repeats no source more than a limit.

A source's weight times the budget is its number of tokens in the mixture. It is realised as whole passes over the source
and a last, partial one over a permutation of its blocks: documents are dealt to BLOCKS blocks by a hash, blocks are taken
in a permuted order while they fit, and of the block that doesn't fit its documents, permuted too, while they fit. So the
running sums are over BLOCKS rows for each source and over the rows of one block, never over a source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillwork.functions.columns import named
from rillwork.functions.shared import cut

BLOCKS = 4096
#: Points of one step of the bisection, and its steps: 16 ** 9 = 2 ** 36.
POINTS, STEPS = 16, 9


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _number(text: Column) -> Column:
    """A number from a hash that other SQL engines have as well."""
    return F.conv(F.substring(F.md5(F.encode(text, "UTF-8")), 1, 8), 16, 10).cast("long")


def exponent(shares: DataFrame, entropy: float | None = None, repeats: float | None = None, whole: bool = False) -> float:
    """The exponent for (share) > 0, by bisection in steps of POINTS; each step is one aggregate over the sources.

    entropy is a fraction of the largest possible one. repeats bounds how often the most repeated source is read, of a
    budget of all tokens or, if `whole`, of the least budget that reads every source at least once.
    """
    if (entropy is None) == (repeats is None):
        raise ValueError("give a target entropy or a limit of repetition")
    low, high = 0.0, 1.0
    for _ in range(STEPS):
        width = (high - low) / POINTS
        grid = shares.select("share", F.explode(F.sequence(F.lit(0), F.lit(POINTS))).alias("k")).withColumn("a", F.lit(low) + F.col("k") * F.lit(width))
        power = F.pow("share", "a")
        sums = grid.groupBy("k", "a").agg(F.sum(power).alias("z"), F.sum(power * F.ln("share")).alias("l"), F.min("share").alias("least"), F.max("share").alias("most"), F.count(F.lit(1)).alias("n"))
        rows = sums.orderBy("k").collect()  # POINTS + 1 rows
        if not rows:
            return 1.0
        if entropy is not None:
            good = [r["n"] < 2 or (r["z"] and _entropy(r) >= entropy * math.log(r["n"])) for r in rows]
            last = max((k for k, g in enumerate(good) if g), default=0)
        else:
            reads = [(r["least"] / r["most"]) ** (r["a"] - 1) if whole else r["least"] ** (r["a"] - 1) / r["z"] for r in rows]
            first = min((k for k, x in enumerate(reads) if x <= repeats * (1 + 1e-12)), default=POINTS)
            last = first - 1
        if entropy is None and first == 0 and low == 0.0:
            return 0.0
        if entropy is not None and last == POINTS and high == 1.0:
            return 1.0
        last = min(max(last, 0), POINTS - 1)
        low, high = low + last * width, low + (last + 1) * width
    return low if entropy is not None else high


def _entropy(r) -> float:
    return math.log(r["z"]) - r["a"] * r["l"] / r["z"]


def _keys(id_col: str, text_col: str, source_col: str) -> dict[str, Column]:
    """src names a source (null is one, too); kid names a document: its id, or of a null id a hash of its text."""
    return {
        "src": F.coalesce(F.concat(F.lit("s"), named(source_col).cast("string")), F.lit("n")),
        "kid": F.coalesce(named(id_col).cast("string"), F.concat(F.lit("t"), F.md5(F.encode(F.coalesce(named(text_col), F.lit("")), "UTF-8")))),
    }


def plan(docs: DataFrame, entropy: float | None = None, repeats: float | None = None, budget: int | None = None, whole: bool = False, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of docs: id, source, src, kid, n_tokens, weight, copies (how often the mixture holds the row).

    The budget in tokens is that of all documents unless given; with `whole` it is the least that reads every source at
    least once, so that no document is left out.

    Defined cases: tokens are words; a null source is a source of its own; rows that repeat a source and an id (or, of
    null ids, a text) have equal copies; a source without tokens has weight 0 and its documents are held once; an empty
    table gives no rows; other columns aren't read.
    """
    keys = _keys(id_col, text_col, source_col)
    rows = docs.select(named(id_col).alias("id"), named(source_col).alias("source"), n_words(named(text_col)).alias("n_tokens"), *[c.alias(k) for k, c in keys.items()])
    rows = cut(rows.withColumn("block", (_number(F.concat(F.lit("block "), "kid")) % BLOCKS).cast("int")))
    blocks = cut(rows.groupBy("src", "block").agg(F.sum("n_tokens").alias("in_block")))
    sources = blocks.groupBy("src").agg(F.sum("in_block").alias("in_source")).where("in_source > 0")
    total = sources.agg(F.sum("in_source").alias("t")).first()["t"] or 0
    shares = cut(sources.withColumn("share", F.col("in_source") / F.lit(float(total or 1))))
    a = exponent(shares, entropy, repeats, whole)
    z = shares.agg(F.sum(F.pow("share", F.lit(a))).alias("z"), F.max(F.col("share") / F.pow("share", F.lit(a))).alias("m")).first()
    if whole and z["z"]:
        budget = total * z["m"] * z["z"]
    weight = F.pow("share", F.lit(a)) / F.lit(z["z"] or 1.0)
    goal = F.round(weight * F.lit(float(total if budget is None else budget)), 3)
    goals = shares.select("src", weight.alias("weight"), F.floor(goal / F.col("in_source") + F.lit(1e-9)).cast("int").alias("passes"), goal.alias("goal"), "in_source")
    goals = goals.withColumn("rest", F.floor(F.col("goal") - F.col("passes") * F.col("in_source") + F.lit(1e-6)))

    order = Window.partitionBy("src").orderBy(_number(F.concat_ws(" ", F.lit("order"), "src", "block", "passes")), "block")
    dealt = blocks.join(goals, "src", "left").withColumn("before", F.sum("in_block").over(order) - F.col("in_block"))
    dealt = cut(dealt.select("src", "block", "weight", "passes", (F.col("rest") - F.col("before")).alias("room"), "in_block"))

    within = Window.partitionBy("src", "block").orderBy(_number(F.concat(F.lit("row "), "kid")), "kid")
    found = rows.join(dealt, ["src", "block"]).withColumn("upto", F.sum("n_tokens").over(within))
    taken = (F.col("in_block") <= F.col("room")) | (F.col("upto") <= F.col("room"))
    copies = F.when(F.col("weight").isNull(), 1).otherwise(F.col("passes") + F.when(taken, 1).otherwise(0)).cast("int")
    return found.select("id", "source", "src", "kid", "n_tokens", F.coalesce("weight", F.lit(0.0)).alias("weight"), copies.alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **target) -> DataFrame:
    """docs with each row as often as its source's weight asks for; see plan()."""
    of = plan(docs, id_col=id_col, text_col=text_col, source_col=source_col, **target).select(F.col("src").alias("__src"), F.col("kid").alias("__kid"), F.col("copies").alias("__copies")).distinct()
    keys = _keys(id_col, text_col, source_col)
    rows = docs.select(F.struct(*[named(c) for c in docs.columns]).alias("row"), *[c.alias(k) for k, c in keys.items()])  # so no name of docs can clash
    joined = rows.join(of.hint("shuffle_hash"), (F.col("src") == F.col("__src")) & (F.col("kid") == F.col("__kid")))
    again = joined.select("row", F.explode(F.when(F.col("__copies") > 0, F.sequence(F.lit(1), F.col("__copies")))))
    return again.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return plan(docs, repeats=1.5).select(F.col("id").alias("doc_id"), "source", "n_tokens", F.round("weight", 6).alias("weight"), "copies")


QUERIES = {"op6_mixing": op6_mixing}
ORACLE = {
    "op6_mixing": r"""
WITH RECURSIVE r AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens,
         coalesce('s' || source, 'n') AS src, coalesce(doc_id::VARCHAR, 't' || md5(coalesce(text, ''))) AS kid FROM documents),
d AS (SELECT *, ('0x' || md5('block ' || kid)[1:8])::BIGINT % 4096 AS block, ('0x' || md5('row ' || kid)[1:8])::BIGINT AS turn FROM r),
b AS (SELECT src, block, sum(n_tokens)::BIGINT AS in_block FROM d GROUP BY ALL),
s AS (SELECT src, sum(in_block)::BIGINT AS in_source FROM b GROUP BY ALL HAVING in_source > 0),
p AS (SELECT src, in_source, in_source / (SELECT sum(in_source) FROM s)::DOUBLE AS share FROM s),
l AS (SELECT list(share) AS shares, min(share) AS least FROM p),
x(k, lo, hi) AS (
  SELECT 0, CASE WHEN least ** -1.0 / len(shares) <= 1.5 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END, CASE WHEN least ** -1.0 / len(shares) <= 1.5 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END FROM l
  UNION ALL
  SELECT k + 1, CASE WHEN ok THEN lo ELSE (lo + hi) / 2 END, CASE WHEN ok THEN (lo + hi) / 2 ELSE hi END
  FROM (SELECT k, lo, hi, lo >= 0 AND least ** ((lo + hi) / 2 - 1) / list_sum(list_transform(shares, lambda q: q ** ((lo + hi) / 2))) <= 1.5 AS ok FROM x, l WHERE k < 36)),
e AS (SELECT max_by(hi, k) AS a FROM x),
g AS (SELECT src, in_source, share ** a / (SELECT sum(share ** a) FROM p, e) AS weight FROM p, e),
o AS (SELECT *, round(weight * (SELECT sum(in_source) FROM s), 3) AS goal FROM g),
q AS (SELECT *, floor(goal / in_source + 1e-9)::INT AS passes FROM o),
t AS (SELECT *, floor(goal - passes * in_source + 1e-6) AS rest FROM q),
u AS (SELECT b.src, b.block, in_block, weight, passes, rest - (sum(in_block) OVER (PARTITION BY b.src ORDER BY ('0x' || md5(concat_ws(' ', 'order', b.src, b.block, passes))[1:8])::BIGINT, b.block) - in_block) AS room FROM b LEFT JOIN t USING (src)),
f AS (SELECT d.*, weight, passes, room, in_block, sum(n_tokens) OVER (PARTITION BY src, block ORDER BY turn, kid) AS upto FROM d JOIN u USING (src, block))
SELECT doc_id, source, n_tokens::BIGINT AS n_tokens, round(coalesce(weight, 0), 6) AS weight,
       CASE WHEN weight IS NULL THEN 1 ELSE passes + CASE WHEN in_block <= room OR upto <= room THEN 1 ELSE 0 END END AS copies FROM f"""
}
