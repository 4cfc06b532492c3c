import math

import pytest
from pyspark.sql import functions as F

from rillwork.llm import mixing

from .common import docs, prose


def corpus(spark, sizes):
    texts, sources = [], []
    for k, (name, n) in enumerate(sizes.items()):
        texts += prose(n, k)
        sources += [name] * n
    return docs(spark, texts, sources=sources)


def test_repeats_are_limited_and_weights_realised(spark):
    rows = mixing.plan(corpus(spark, {"big": 600, "mid": 150, "small": 30}), repeats=2.0).collect()
    total = sum(r["n_tokens"] for r in rows)
    for s in ("big", "mid", "small"):
        own = [r for r in rows if r["source"] == s]
        have, put = sum(r["n_tokens"] for r in own), sum(r["n_tokens"] * r["copies"] for r in own)
        assert put / have <= 2.001
        assert put == pytest.approx(own[0]["weight"] * total, rel=0.05)
    assert sum({r["source"]: r["weight"] for r in rows}.values()) == pytest.approx(1)
    assert max(r["copies"] for r in rows) == 2


def test_entropy_is_reached(spark):
    rows = mixing.plan(corpus(spark, {"big": 300, "mid": 60, "small": 20}), entropy=0.9).collect()
    weights = {r["source"]: r["weight"] for r in rows}.values()
    assert -sum(w * math.log(w) for w in weights) == pytest.approx(0.9 * math.log(3), abs=1e-6)


def test_whole_budget_holds_every_document(spark):
    df = corpus(spark, {"big": 200, "small": 20})
    out = mixing.mix(df, repeats=3.0, whole=True)
    assert out.columns == df.columns
    held = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert set(held) == set(range(220)) and set(held.values()) <= {1, 2, 3} and out.where("source = 'small'").count() > 50


def test_odd_rows(spark):
    df = docs(spark, ["a b", "a b", None, "", "c d e", "c d e"], [None, None, 3, 4, 5, 5], [None, None, "empty", "empty", "x", "x"])
    rows = mixing.plan(df, repeats=1.0).collect()
    assert len(rows) == 6 and {r["copies"] for r in rows if r["source"] == "empty"} == {1}
    assert mixing.mix(df, repeats=1.0).count() == 6
    assert mixing.plan(docs(spark, []), repeats=2.0).count() == 0 == mixing.mix(docs(spark, []), entropy=0.5).count()
    with pytest.raises(ValueError):
        mixing.plan(df)
