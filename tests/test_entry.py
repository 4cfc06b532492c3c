"""Registered queries give what their SQL gives."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = Path("/root/testdata/sf0.001")
NAMES = sorted(entry.clickstream.queries())


def test_sql_only_for_known_queries(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def cell(v) -> str:
    if v is None or v is pd.NA or v is pd.NaT or v != v:
        return "null"
    return f"{v:.9g}" if isinstance(v, float) else str(pd.Timestamp(v)) if hasattr(v, "year") else str(v)


def table(df) -> list[tuple[str, ...]]:
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(f"{float(v):.9g}" if isinstance(v, int) and not isinstance(v, bool) else cell(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
@pytest.mark.parametrize("name", [n for n in NAMES if n in entry.oracle.oracle_sql()])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS FROM '{p}'")
    got, want = entry.queries()[name](spark, str(SF)).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert table(got) == table(want)


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
@pytest.mark.parametrize("name", [n for n in NAMES if n not in entry.oracle.oracle_sql()])
def test_query_runs(spark, name):
    assert entry.queries()[name](spark, str(SF)).count() >= 0
