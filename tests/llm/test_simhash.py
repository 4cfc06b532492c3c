import random
import re
from pathlib import Path

import numpy as np
import xxhash

from rillwork.functions.shared import scratch
from rillwork.llm import line_dedup, simhash
from rillwork.llm.links import components

from .common import ODD, docs, prose


def brute_fingerprint(text, each=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + each]).encode(), 42) for i in range(max(1, len(words) - each + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, bits):
    up = {i: i for i in fps}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in fps:
        for j in fps:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= bits and top(i) != top(j):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: top(i) for i in fps}


def near(texts, n, seed):
    rng, out = random.Random(seed), []
    for _ in range(n):
        words = rng.choice(texts).split()
        words[rng.randrange(len(words))] = "edit" + str(rng.randrange(9))
        out.append(" ".join(words))
    return out


def test_equal_to_brute_force(spark):
    base = prose(20, 1, 200)
    texts = ODD + base + base[:5] * 3 + near(base[:3], 60, 2)
    rows = simhash.simhash_groups(docs(spark, texts)).collect()
    fps = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    want = brute_components(fps, 4)
    assert {r["doc_id"]: r["fingerprint"] for r in rows} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {r["doc_id"]: r["component_id"] for r in rows} == want
    assert len(set(want.values())) < len(set(fps.values()))


def test_any_four_bits_share_a_key(spark):
    rng = random.Random(4)
    pairs = []
    for _ in range(3000):
        x = rng.getrandbits(64)
        pairs.append((x, x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))))
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(signed(v),) for v in {v for p in pairs for v in p}], "fp long")
    root = {r["node"]: r["root"] for r in components(simhash.link(df)).collect()}
    assert all(root[signed(a)] == root[signed(b)] for a, b in pairs)


def test_runs_of_any_size_are_joined():
    rng = np.random.default_rng(5)
    chain = [np.uint64(0)]
    for k in range(200):  # a long chain of near ones, and strangers
        chain.append(chain[-1] ^ np.uint64(1 << int(rng.integers(64))))
    fps = np.unique(np.array(chain + [rng.integers(1 << 63, dtype=np.uint64) for _ in range(100)], np.uint64))
    rng.shuffle(fps)
    a, b = simhash._links(np.zeros(len(fps), np.int64), fps, 4)
    want = brute_components(dict(enumerate(map(int, fps))), 4)
    at = {int(f): k for k, f in enumerate(fps)}
    up = dict(enumerate(range(len(fps))))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for x, y in zip(a, b, strict=True):
        assert int(x ^ y).bit_count() <= 4
        up[top(at[int(x)])] = top(at[int(y)])
    groups = lambda of: sorted(sorted(k for k in want if of(k) == r) for r in {of(k) for k in want})
    assert groups(top) == groups(lambda k: want[k])


def test_components_of_long_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 300)] + [(7, 7), (500, 501), (501, 500)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(61)) and all(got[k] == 100 for k in range(100, 300)) and got[501] == 500
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_null_and_repeated_ids_and_empty_tables(spark):
    t = prose(2, 6)
    rows = simhash.simhash_groups(docs(spark, [t[0], t[0], t[0], t[1]], [None, 5, 5, None])).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in rows) == [("5", "5"), ("5", "5"), ("None", "5"), ("None", "None")]
    assert simhash.simhash_groups(docs(spark, [])).count() == 0


def brute_similar(texts):
    sets = [set(simhash.shingles(t, 5).tolist()) for t in texts]
    up = list(range(len(texts)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b) and top(i) != top(j):
                low, high = sorted((top(i), top(j)))
                up[high] = low
    return {i: top(i) for i in range(len(texts))}


def test_similar_texts_whose_fingerprints_are_far_apart(spark):
    """Repeats turn a text's fingerprint but not its set of shingles; and a run of many texts of which some are similar."""
    rng, base = random.Random(8), prose(12, 9, 120)
    often = [" ".join(prose(1, 90 + k, 5)[0].split()[:5]) for k in range(4)]
    texts = base + [t + " " + " ".join([rng.choice(often)] * 300) for t in base for _ in range(2)]
    core = base[0].split()
    for k in range(90):  # more than DENSE under their rarest shingles, at similarities from 0.6 on
        words = list(core)
        for at in rng.sample(range(len(words)), rng.randint(1, 7)):
            words[at] = f"other{k}x{at}"
        texts.append(" ".join(words) + (" " + " ".join([often[k % 4]] * 200) if k % 3 == 0 else ""))
    rng.shuffle(texts)
    want = brute_similar(texts)
    got = {r["number"]: r["group"] for r in simhash.similar_groups(docs(spark, texts), "doc_id", "text").collect()}
    assert got == want and len(set(want.values())) > 12


def test_long_texts_are_told_apart_before_their_sets_meet(spark):
    """Of sets beyond FOLDS * 64 slots too: no similar pair is dropped, whatever the sizes, and few others are left."""
    rng, rows = np.random.default_rng(3), []
    for k, n in enumerate([1, 40, 255, 256, 257, 1000, 1020, 4000, 9000] * 12):
        m = int(n * rng.uniform(0.7, 1.3)) + 1
        both = int(min(n, m) * rng.choice([0.3, 0.6, 0.85, 0.93, 1]))
        drawn = rng.integers(0, 1 << 64, n + m - both, np.uint64)
        a, b = np.unique(drawn[:n]), np.unique(drawn[n - both :])
        like = 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b))
        far = len(np.intersect1d(a, b)) * 5 < 3 * len(np.union1d(a, b)) and n > 900
        rows.append((k, like, far, len(a), simhash.wide_parities(a).tolist(), len(b), simhash.wide_parities(b).tolist()))
    pairs = spark.createDataFrame(rows, "k long, like boolean, far boolean, size_a int, wide_a array<bigint>, size_b int, wide_b array<bigint>")
    got = {r["k"]: r["left"] for r in pairs.select("k", simhash.may_match((4, 5)).alias("left")).collect()}
    assert all(got[r[0]] for r in rows if r[1]) and sum(r[1] for r in rows) > 20
    assert not any(got[r[0]] for r in rows if r[2]) and sum(r[2] for r in rows) > 12


def test_operators_leave_what_their_results_read(spark):
    def tables():
        return {p.name for p in Path(scratch(spark).removeprefix("file://")).iterdir()}

    texts = [f"the same long line of words {k // 3} and\nanother line {k}" for k in range(30)]
    rows = docs(spark, texts)
    for made, left in ((lambda: simhash.similar_groups(rows, "doc_id", "text"), 1), (lambda: simhash.simhash_groups(rows), 2), (lambda: line_dedup.line_dedup(rows), 1)):
        before = tables()
        found = made()
        assert len(tables() - before) == left
        assert found.count() == 30
