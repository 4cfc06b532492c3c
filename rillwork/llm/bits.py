"""A fixed-size bit table over hashed keys, made and asked with Spark's bitmap functions.

It answers "may this key be in the set?" without shuffling the rows that ask. It has BUCKETS rows of 4 KB, whatever the
input, so it can be broadcast: 1 MB is its proven bound. Two keys may share a bit; such a row is only examined in vain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 256
#: Bits in a value of bitmap_construct_agg.
WIDTH = 32768


def _slot(key: Column) -> Column:
    return F.pmod(key, F.lit(BUCKETS * WIDTH))


def build(keys: DataFrame, key: Column) -> DataFrame:
    """(bucket, bitmap) of the 64-bit hashes `key`; at most BUCKETS rows."""
    at = keys.select(_slot(key).alias("at"))
    return at.groupBy(F.expr(f"CAST(at DIV {WIDTH} AS INT)").alias("bit_bucket")).agg(F.bitmap_construct_agg(F.col("at") % WIDTH).alias("bits"))


def mark(rows: DataFrame, table: DataFrame, key: Column, name: str) -> DataFrame:
    """rows with a boolean column `name`: whether the key may be in the table."""
    at = _slot(key)
    asked = rows.withColumns({"bit_bucket": F.floor(at / WIDTH).cast("int"), "bit_at": (at % WIDTH).cast("int")})
    joined = asked.join(F.broadcast(table), "bit_bucket", "left")
    byte = F.conv(F.hex(F.substring("bits", F.expr("bit_at DIV 8 + 1").cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.col("bits").isNotNull() & (byte.bitwiseAND(F.expr("SHIFTLEFT(1, bit_at % 8)")) != 0)
    return joined.withColumn(name, F.coalesce(hit, F.lit(False))).drop("bit_bucket", "bit_at", "bits")
