import random

from pyspark.sql import functions as F

from rillwork.llm import line_dedup

from .common import ODD, docs, prose


def brute(texts):
    seen, out = [], []
    for t in texts:
        left = []
        for line in (t or "").split("\n"):
            words = set(line.replace("\t", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ")) - {""}
            late = bool(words) and any(9 * len(words & o) >= 4 * (len(words) + len(o)) for o in seen)
            if words:
                seen.append(words)
            if not late:
                left.append(line)
        out.append(None if t is None else "\n".join(left))
    return out


def variants(base, n, seed):
    rng, out = random.Random(seed), []
    for _ in range(n):
        words = base.split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(["new", "other", "odd", "word"]) + str(rng.randrange(50))
        out.append(" ".join(words))
    return out


def test_equal_to_brute_force(spark):
    lines = prose(40, 1, 12) + prose(10, 2, 80)
    rng = random.Random(7)
    texts = ["\n".join(rng.choice(lines + variants(rng.choice(lines), 3, k)) for _ in range(rng.randint(1, 6))) for k in range(120)] + ODD
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(docs(spark, texts)).collect()}
    want = brute(texts)
    assert [got[i] for i in range(len(texts))] == want


def test_a_large_group_of_alike_lines(spark):
    base = prose(1, 3, 60)[0]
    texts = [base, *variants(base, 150, 4)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_columns_ids_and_empty_tables(spark):
    df = docs(spark, ["x y\nz", "x y", None, "x y"], [None, 2, 3, 3]).withColumn("th", F.lit(1)).withColumn("no", F.lit(2))
    out = line_dedup.line_dedup(df)
    assert out.columns == df.columns
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in out.collect()) == [("2", ""), ("3", ""), ("3", "None"), ("None", "x y\nz")]
    assert line_dedup.line_dedup(docs(spark, [])).count() == 0


def test_maps_tell_long_lines_apart(spark):
    base = prose(1, 5, 300)[0].split()
    for lacks in (0, 5, 40):  # words that one of the two lines lacks
        texts = [" ".join(base), " ".join([f"new{k}" for k in range(lacks)] + base[lacks:])]
        df = docs(spark, texts)
        table, middle = line_dedup.rarity(df)
        first = line_dedup._first_lines(line_dedup._lines(df, "doc_id", "text"), table, middle, (4, 5), line_dedup.RARITY)
        maps = [[r[c] & (1 << 64) - 1 for c in line_dedup._MAPS] for r in first.collect()]
        differ = sum((a ^ b).bit_count() for a, b in zip(maps[0], maps[-1], strict=True))
        sets = [set(t.split()) for t in texts]
        lacking = len(sets[0] ^ sets[1])
        assert differ <= lacking and (lacking - differ) % 2 == 0 and differ >= min(lacking, 128) // 3
