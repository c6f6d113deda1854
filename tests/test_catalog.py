"""Every registered query runs; those with check SQL give the same rows in another engine."""

import math

import duckdb
import pandas as pd
import pytest

from __spark_entry__ import SMOKE_DIR, entry, oracle_sql, queries

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]
QUERIES, ORACLES = queries(), oracle_sql()


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMOKE_DIR}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)) or v is pd.NA:
        return ""
    if isinstance(v, (pd.Timestamp,)) or hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or hasattr(v, "item"):
        return f"{float(v):.6f}"
    return str(v)


def _rows(pdf):
    names = sorted(pdf.columns)
    return sorted(tuple(_cell(v) for v in r) for r in pdf[names].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, engine, name):
    got = QUERIES[name](spark, SMOKE_DIR).toPandas()
    if name not in ORACLES:
        assert len(got) > 0
        return
    want = engine.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    out = entry(spark)
    assert out.columns == ["model", "split", "mae", "rmse", "n"] and out.count() == 6
