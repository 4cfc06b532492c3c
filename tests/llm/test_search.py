import math
import random
from collections import Counter

import pytest

from rillwork.llm import ranked_search as s

from .common import ODD, docs, prose


def brute(rows, queries, k):
    found = [(i, Counter(w)) for i, t in rows if (w := s.terms(t))]
    n, total = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(w for _, c in found for w in c)
    weight = {w: math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for w, x in df.items()}
    items: dict = {}
    for q, t in queries:
        items.setdefault(q, set()).update(s.terms(t))
    out = []
    for q, its in items.items():
        scored = []
        for i, c in found:
            m = 50 + (50 * sum(c.values()) * n) // total
            score = sum(weight[w] * ((10**9 * c[w]) // (1000 * c[w] + 20 * m)) for w in its if w in c)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(q, r, None if none else i, -score) for r, (score, none, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def got(spark, rows, queries, k):
    asked = spark.createDataFrame(queries, "item_id long, text string, rank int, score int, term string") if queries and len(queries[0]) == 5 else spark.createDataFrame(queries, "item_id long, text string")
    return sorted((tuple(r) for r in s.search(docs(spark, [t for _, t in rows], [i for i, _ in rows]), asked, k).collect()), key=str)


def test_terms():
    assert s.terms("A_b-C3 É.é\x00x\x7fy\xa0z") == [b"a", b"b", b"c3", "É".encode(), "é".encode(), b"x", "y\xa0z".encode()]
    assert s.terms(None) == s.terms(" .,") == []


@pytest.mark.parametrize("k", [1, 7, 50])
@pytest.mark.parametrize("block", [16, 4096])
def test_equal_to_brute_force(spark, monkeypatch, k, block):
    monkeypatch.setattr(s, "BLOCK", block)
    texts = [*prose(250, 1), *ODD, *prose(3, 1)[:3] * 30, "rare word here", "Rare WORD here", ""]
    rows = list(enumerate(texts)) + [(3, "repeated id of other text"), (None, texts[5]), (None, texts[5])]
    queries = [(k, t) for k, t in enumerate(prose(12, 1))] + [(3, "rare word"), (None, "rare here"), (90, ""), (91, None), (92, "notthere")]
    assert got(spark, rows, queries, k) == brute(rows, queries, k)


def test_rests_of_lists_are_looked_up(spark, monkeypatch):
    """Two frequent terms and a rare one: the rare one sets a bound above most of the others' impacts."""
    monkeypatch.setattr(s, "BLOCK", 32)
    rng = random.Random(4)
    rows = [(k, " ".join(["common"] * rng.randint(0, 3) + ["often"] * rng.randint(0, 2) + ["filler"] * rng.randint(1, 60) + ["rare"] * (k % 23 == 0))) for k in range(400)]
    queries = [(1, "common often rare"), (2, "rare"), (3, "filler common")]
    assert got(spark, rows, queries, 5) == brute(rows, queries, 5)


def test_queries_in_parts(spark, monkeypatch):
    monkeypatch.setattr(s, "PAIRS", 20)
    rows, queries = list(enumerate(prose(80, 2))), list(enumerate(prose(9, 2, 12)))
    assert got(spark, rows, queries, 6) == brute(rows, queries, 6)


def test_empty_tables_and_clashing_columns(spark):
    rows, queries = list(enumerate(prose(5, 3))), list(enumerate(prose(2, 3)))
    assert got(spark, rows, [], 5) == [] == got(spark, [(1, None)], queries, 5)
    assert s.search(docs(spark, ["a"]).limit(0), docs(spark, ["a"]).withColumnRenamed("doc_id", "item_id")).count() == 0
    clash = docs(spark, [t for _, t in rows]).withColumnsRenamed({"lang": "block", "source": "ids"})
    asked = spark.createDataFrame([(i, t, 1, "x") for i, t in queries], "item_id long, text string, term int, query string")
    assert sorted((tuple(r) for r in s.search(clash, asked, 5).collect()), key=str) == brute(rows, queries, 5)
