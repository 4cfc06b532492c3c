"""Sharding over fixed virtual slots.

A record's slot is a hash of its id and never changes. What changes is the slot-to-shard map: a small table with a
version, in which each version is an edit of the one before. Growing by a shard hands it a share of every old shard's
slots and moves nothing between old shards. `rebalance` edits the map by the bytes found in each slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillwork.functions.columns import named
from rillwork.functions.shared import cut

#: Thousands of slots; the bound of every table of slots below.
SLOTS = 16384


def slot_of(id_col: str, text_col: str, n_slots: int = SLOTS) -> Column:
    """The virtual slot: a hash of the id; of a null id, of the text's hash, so that null ids don't share a slot."""
    return F.pmod(F.xxhash64(F.coalesce(named(id_col).cast("string"), F.concat(F.lit("null "), F.coalesce(F.crc32(F.encode(named(text_col), "UTF-8")), F.lit(0)).cast("string")))), F.lit(n_slots)).cast("int")


def _joins(slot: str, count) -> Column:
    """Whether a slot moves to the newest of `count` shards: one slot in `count` does, by a hash of both."""
    return F.pmod(F.xxhash64(slot, F.lit("joins"), count), F.lit(1 << 40)) * count < F.lit(1 << 40)


def first_map(spark: SparkSession, shards: int, n_slots: int = SLOTS) -> DataFrame:
    """(version, vslot, shard): the map for so many shards, as if grown from one shard on; version is their number."""
    slots = spark.range(n_slots).select(F.col("id").cast("int").alias("vslot"))
    steps = slots.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(shards)))).where(_joins("vslot", F.col("step")))
    return steps.groupBy("vslot").agg((F.max("step") - 1).alias("shard")).select(F.lit(shards).alias("version"), "vslot", "shard")


def grow(slots: DataFrame, shards: int) -> DataFrame:
    """The next version, with one shard more than `shards`: it takes its share of every shard's slots, no other moves.

    first_map(n + 1) is grow(first_map(n), n); an edited map can grow as well.
    """
    moved = F.when(_joins("vslot", F.lit(shards + 1)), F.lit(shards)).otherwise(F.col("shard")).alias("shard")
    return slots.select((F.col("version") + 1).alias("version"), "vslot", moved)


def rebalance(slots: DataFrame, load: DataFrame) -> DataFrame:
    """The next version with sizes evened out: (version, vslot, shard) from the map and (vslot, bytes).

    Shards above the mean give up their last slots (in slot order) until they are at it; those slots fill the shards
    below it in order. All tables here have at most one row per slot, a fixed number.
    """
    known = slots.join(load, "vslot", "left").select("version", "vslot", "shard", F.coalesce("bytes", F.lit(0)).alias("bytes"))
    shards = slots.select("shard").distinct()
    mean = known.agg((F.sum("bytes") / F.count_distinct("shard")).alias("m")).first()["m"] or 0.0
    run = F.sum("bytes").over(Window.partitionBy("shard").orderBy("vslot"))
    split = known.withColumn("over", run > F.lit(mean))
    room = shards.join(split.where("NOT over").groupBy("shard").agg(F.sum("bytes").alias("has")), "shard", "left").select("shard", F.greatest(F.lit(mean) - F.coalesce("has", F.lit(0)), F.lit(0.0)).alias("room"))
    edges = room.withColumn("to", F.sum("room").over(Window.orderBy("shard"))).select(F.col("shard").alias("new"), (F.col("to") - F.col("room")).alias("lo"), F.col("to").alias("hi"))
    moved = split.where("over").withColumn("mid", F.sum("bytes").over(Window.orderBy(F.desc("bytes"), "vslot")) - F.col("bytes") / 2)
    placed = moved.join(F.broadcast(edges), (F.col("mid") >= F.col("lo")) & (F.col("mid") < F.col("hi")), "left").groupBy("version", "vslot", "shard", "bytes").agg(F.min("new").alias("new"))
    stay = split.where("NOT over").select("version", "vslot", "shard")
    return stay.unionByName(placed.select("version", "vslot", F.coalesce("new", "shard").alias("shard"))).withColumn("version", F.col("version") + 1)


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", n_slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """(rows, map): where each row goes under the law `key`, and the stored map with both versions and the bytes per slot.

    rows: `id_col`, size, text_crc32, law, shard, slot (the row's place in its shard, from 0 without gaps), grown_shard,
    vslot. map: version, vslot, shard, bytes, rows.

    A place is the number of rows in the shard's earlier slots plus the place within the slot, so no task ever holds a
    shard, or all rows of one id. Defined cases: a null text has no bytes and the checksum 0; rows that repeat an id share its slot and are
    placed in parts by their checksums; a null id is placed by its text; other columns are not read; an empty table
    gives no rows and a map with zero bytes.
    """
    body = F.encode(F.coalesce(named(text_col), F.lit("")), "UTF-8")
    rows = cut(docs.select(named(id_col).alias("id"), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), slot_of(id_col, text_col, n_slots).alias("vslot"), F.monotonically_increasing_id().alias("row")))
    load = cut(rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")))
    now = first_map(docs.sparkSession, shards, n_slots)
    both = now.unionByName(grow(now, shards)).join(F.broadcast(load), "vslot", "left").select("version", "vslot", "shard", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("rows", F.lit(0)).alias("rows"))
    both = cut(both)  # the stored, versioned map
    start = F.sum("rows").over(Window.partitionBy("shard").orderBy("vslot")) - F.col("rows")
    place = both.where(F.col("version") == shards).select("vslot", "shard", start.alias("start"))
    place = place.join(both.where(F.col("version") == shards + 1).select("vslot", F.col("shard").alias("grown_shard")), "vslot")
    # An id that many rows repeat is one slot, so a slot's rows are numbered in parts, after the sizes of the parts before.
    parted = rows.withColumn("part", (F.shiftright("text_crc32", 26) * 16 + F.pmod("row", F.lit(16))).cast("int"))
    sizes = parted.groupBy("vslot", "part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("vslot", "part", (F.sum("n").over(Window.partitionBy("vslot").orderBy("part")) - F.col("n")).alias("before"))  # 1,024 parts of a slot
    within = F.row_number().over(Window.partitionBy("vslot", "part").orderBy("id", "text_crc32", "size")) - 1
    numbered = parted.withColumn("within", within).join(before, ["vslot", "part"]).withColumn("within", F.col("within") + F.col("before"))
    out = numbered.join(F.broadcast(place), "vslot")
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("within")).cast("long").alias("slot"), "grown_shard", "vslot"), both


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), 24)[0]


QUERIES = {"op7_sharding": op7_sharding}
#: DuckDB has no CRC-32: the query is tested against a brute-force version.
ORACLE: dict[str, str] = {}
