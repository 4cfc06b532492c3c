"""What tables that cut lineage leave behind."""

import time
from pathlib import Path

from pyspark.sql import functions as F

from rillwork.functions.shared import cut, freed, scratch


def _shuffled(spark) -> set[str]:
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f.name for d in folders for f in Path(d).rglob("shuffle_*")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    before = _shuffled(spark)
    made = cut(spark.range(20_000).groupBy((F.col("id") % 977).alias("k")).count())
    assert made.count() == 977
    again = cut(made.join(spark.range(977).withColumnRenamed("id", "k"), "k"))  # a plan that reads it stands by itself
    for _ in range(50):
        left = {x for x in _shuffled(spark) - before if not x.endswith(".checksum.crc32c")}
        if not left:
            break
        time.sleep(0.1)
    assert len(left) <= 8, left  # of count() alone
    assert again.agg(F.sum("count")).first()[0] == 20_000


def _tables(spark) -> set[str]:
    return {p.name for p in Path(scratch(spark).removeprefix("file://")).iterdir()}


def test_tables_of_a_scope_go_with_it(spark):
    before = _tables(spark)

    @freed()
    def inner():
        return cut(cut(spark.range(10)).where("id > 3"), stay=True)

    with freed():
        made = cut(inner().where("id < 9"), stay=True)
        assert len(_tables(spark) - before) == 2
    assert len(_tables(spark) - before) == 1 and made.count() == 5
