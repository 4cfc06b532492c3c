"""Items seen together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwork.functions.shared import cut

MIN_SUPPORT = 2
#: Items of a group that meet under one key: larger groups are dealt into blocks of about so many.
BLOCK = 256
#: Rows of a partition, about.
ROWS = 500_000


def pair_support(baskets: DataFrame, by: list[str], item: str, min_support: int = MIN_SUPPORT, block: int = BLOCK) -> DataFrame:
    """(item_a < item_b, the columns of `by` but the first, weight): in how many groups both are. by[0] names a group.

    Items in fewer groups than the support can't be in a pair and go first. A group of many items is dealt into blocks, and
    what meets under a key is one pair of blocks (low, high), of the triangle low <= high: no key holds more pairs than two blocks
    give, whatever the size of its group. The number of partitions grows with the rows, so that a task's memory doesn't.
    """
    entry = cut(baskets.where(F.col(item).isNotNull()).select(*by, F.col(item).alias("item")))
    parts = max(-(-entry.count() // ROWS), int(entry.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    entry = cut(entry.repartition(parts, *entry.columns).distinct(), parts=parts)
    if min_support > 1:
        often = entry.groupBy("item", *by[1:]).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_support).drop("_n")
        entry = entry.join(often, ["item", *by[1:]], "left_semi")
    large = entry.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block).withColumn("_blocks", F.ceil(F.col("_n") / block).cast("int")).drop("_n")
    blocks = F.coalesce("_blocks", F.lit(1))
    dealt = entry.join(large, by, "left").select(*by, "item", blocks.alias("_blocks"), F.pmod(F.xxhash64("item"), blocks).cast("int").alias("_own"))
    low = dealt.select(*by, F.col("item").alias("_x"), F.col("_own").alias("_low"), F.explode(F.sequence("_own", F.col("_blocks") - 1)).alias("_high"))
    high = dealt.select(*by, F.col("item").alias("_y"), F.explode(F.sequence(F.lit(0), "_own")).alias("_low"), F.col("_own").alias("_high"))
    met = low.join(high, [*by, "_low", "_high"]).where("_low < _high OR _x < _y")
    counted = met.groupBy(F.least("_x", "_y").alias("item_a"), F.greatest("_x", "_y").alias("item_b"), *by[1:]).agg(F.count(F.lit(1)).alias("weight"))
    return cut(counted.where(F.col("weight") >= min_support), parts=parts)


def _seen_or_bought(tagged: DataFrame) -> DataFrame:
    kind = F.when(F.col("event") == "view", "view").when(F.col("event") == "transaction", "purchase")
    return tagged.withColumn("pair_type", kind).where("pair_type IS NOT NULL")


def cooccurrence_pairs(tagged: DataFrame, min_support: int = MIN_SUPPORT) -> DataFrame:
    """(item_a, item_b, weight, pair_type) of items viewed or bought in the same sessions, both kinds in one pass."""
    return pair_support(_seen_or_bought(tagged), ["session_id", "pair_type"], "itemid", min_support).select("item_a", "item_b", "weight", "pair_type")


def pairs_by_day(tagged: DataFrame, day: str = "session_date") -> DataFrame:
    """(item_a, item_b, weight, pair_type, `day`): the pairs of the sessions of each day, all of them, so days can be added up."""
    return pair_support(_seen_or_bought(tagged), ["session_id", "pair_type", day], "itemid", 1).select("item_a", "item_b", "weight", "pair_type", day)


def summed(*parts: DataFrame) -> DataFrame:
    """(item_a, item_b, pair_type, weight): the sums of signed counts, without what cancels out."""
    columns = ["item_a", "item_b", "pair_type", "weight"]
    whole = parts[0].select(*columns)
    for p in parts[1:]:
        whole = whole.unionByName(p.select(*columns))
    return whole.groupBy("item_a", "item_b", "pair_type").agg(F.sum("weight").alias("weight")).where("weight <> 0")


def feature_cooccur(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.concat("item_a", F.lit("-"), "item_b", F.lit("-"), "pair_type").alias("pair_id"), "item_a", "item_b", "pair_type", "weight")
