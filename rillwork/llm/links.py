"""Connected components of links, by alternating stars: every step is a join and an aggregate over the links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwork.functions.shared import cut


def _state(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _star(pairs: DataFrame, both: bool) -> DataFrame:
    """Ties what lies round each node to the smallest of it: the larger neighbours if `both`, else the smaller ones."""
    around = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else pairs
    least = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low"))
    tied = around.join(least, "u")
    if both:
        return tied.where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
    own = least.select("u", F.col("low").alias("v"))
    return tied.where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(own).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b), whose root is the smallest node reachable. Links to self may occur.

    Each round's links are written to the shared folder, so lineage stays short. The number of rounds grows with the
    logarithm of the number of nodes.
    """
    ends = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = cut(ends)
    before = _state(pairs)
    while before[0]:
        # Every pair is (larger, smaller), before and after each star.
        pairs = cut(_star(cut(_star(pairs, both=True)), both=False))
        after = _state(pairs)
        if after == before:
            break
        before = after
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
