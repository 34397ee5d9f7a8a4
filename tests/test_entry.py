"""Driver contract and a DuckDB oracle pass on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as E
from panelforge.plans.panel import TABLES
from tests.conftest import SF_SMALL


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["entity", "yr", "mean_v", "total", "n", "yoy"]


def test_registry_contract():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 150


def _canon(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.mark.parametrize("name", sorted(E.ORACLE))
def test_oracle_small(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    df = E.queries()[name](spark, SF_SMALL)
    res = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    order_s = sorted(range(len(df.columns)), key=lambda i: df.columns[i])
    order_d = sorted(range(len(dcols)), key=lambda i: dcols[i])
    srows = sorted((tuple(_canon(r[i]) for i in order_s) for r in df.collect()), key=repr)
    drows = sorted((tuple(_canon(r[i]) for i in order_d) for r in res.fetchall()), key=repr)
    assert srows == drows
