"""The registered queries against their SQL, or brute force, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from rillwork.llm import registry
from rillwork.llm.pieces import model_bytes, processor

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equal_to_sql(spark, name):
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS FROM '{p}'")
    want = con.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, str(SF)).select(*want.columns)
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want.fetchall()))


def test_token_queries(spark):
    lib = processor(model_bytes())
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = {i: lib.encode(t) for i, t in texts.items()}
    assert {r["doc_id"]: r["n_tokens"] for r in registry.queries()["op1_token_counts"](spark, str(SF)).collect()} == {i: len(x) for i, x in want.items()}
    assert {r["doc_id"]: r["ids"] for r in registry.queries()["op2_sentencepiece"](spark, str(SF)).collect()} == want


@pytest.mark.parametrize("name", ["op4_toxicity", "op8_nearest", "op10_html_text", "op9_simhash", "op7_sharding"])
def test_runs(spark, name):
    assert registry.queries()[name](spark, str(SF)).count() > 0
