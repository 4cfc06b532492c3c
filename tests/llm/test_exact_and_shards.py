import hashlib
import re
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from rillwork.llm import exact_dedup, sharding

from .common import ODD, docs, prose


def test_groups_equal_brute_force(spark):
    texts = ODD + prose(30) + prose(10) * 4 + ODD
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(docs(spark, texts), digest_all=True).collect()}
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    assert len(got) == len(texts)
    for text, ids in groups.items():
        for i in ids:
            assert got[i]["keep_id"] == min(ids) and got[i]["group_size"] == len(ids) and got[i]["kept"] == (i == min(ids))
            assert got[i]["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_only_survivors_are_hashed(spark):
    got = {r["doc_id"]: r["text_sha256"] for r in exact_dedup.exact_dedup(docs(spark, ["only one", "two", "two"])).collect()}
    assert got[0] is None and got[1] == got[2] is not None


def test_repeated_and_null_ids(spark):
    df = docs(spark, ["x", "x", "x", "y", "y"], [3, 3, None, None, None]).withColumn("id", F.lit(1)).withColumn("n", F.lit(2)).withColumn("key", F.lit("k"))
    got = sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(df).collect())
    assert got == [("3", "3", 3, True), ("3", "3", 3, True), ("None", "3", 3, False), ("None", "None", 2, True), ("None", "None", 2, True)]


def test_empty_tables(spark):
    none = docs(spark, [])
    assert exact_dedup.exact_dedup(none).count() == 0
    rows, slots = sharding.shard(none, 3)
    assert rows.count() == 0 and slots.agg(F.sum("bytes")).first()[0] == 0


def test_shards_follow_the_id_alone(spark):
    texts = ODD + prose(200)
    rows = sharding.shard(docs(spark, texts), 5)[0].collect()
    for r in rows:
        body = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(body) + 8, zlib.crc32(body), "key")
        assert r["grown_shard"] in (r["shard"], 5)
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert 0 < sum(r["grown_shard"] == 5 for r in rows) < len(rows) / 2
    some = {r["doc_id"]: r["shard"] for r in sharding.shard(docs(spark, ["other"] * 50, list(range(50))), 5)[0].collect()}
    assert some == {r["doc_id"]: r["shard"] for r in rows if r["doc_id"] in some}
    more = {r["doc_id"]: r["shard"] for r in sharding.shard(docs(spark, texts), 6)[0].collect()}
    assert more == {r["doc_id"]: r["grown_shard"] for r in rows}


def test_null_ids_are_spread_and_repeated_ids_stay_together(spark):
    rows = sharding.shard(docs(spark, prose(60) + ["a", "b"], [None] * 60 + [7, 7]), 4)[0].collect()
    assert len({r["vslot"] for r in rows if r["doc_id"] is None}) > 20
    assert len({r["shard"] for r in rows if r["doc_id"] == 7}) == 1


def test_rebalancing_edits_the_map(spark):
    slots = sharding.first_map(spark, 4, 64)
    load = spark.range(64).select(F.col("id").cast("int").alias("vslot"), F.when(F.col("id") < 16, 1000).otherwise(10).cast("long").alias("bytes"))
    even = sharding.rebalance(slots, load)
    sizes = [r[0] for r in even.join(load, "vslot").groupBy("shard").agg(F.sum("bytes")).select(F.col("sum(bytes)")).collect()]
    assert even.count() == 64 and even.select("vslot").distinct().count() == 64
    assert max(sizes) <= sum(sizes) / 4 + 1000 and even.first()["version"] == 5
