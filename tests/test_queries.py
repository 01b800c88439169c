"""Every query with SQL against DuckDB over the same tables, and the contract of the entry module."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SQL = {name: text for m in entry.CORE for name, text in m.SQL.items()}
QUERIES = {name: f for m in entry.CORE for name, f in m.QUERIES.items()}


def canon(df):
    def value(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
            return "NULL"
        if isinstance(x, pd.Timestamp):
            return (x if x.tz is None else x.tz_convert("UTC").tz_localize(None)).isoformat()
        if isinstance(x, str):
            return x
        try:
            return repr(round(float(x), 6) + 0.0)
        except (TypeError, ValueError):
            return str(x)

    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(map(value, r)) for r in df.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in os.listdir(data):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{data}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, data, con, name):
    assert canon(QUERIES[name](spark, data).toPandas()) == canon(con.execute(SQL[name]).df())


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())


def test_pruning_and_pushdown(spark, data):
    plan = entry.queries()["metric_list_filtered"](spark, data)._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "EqualTo(stage,ocr)" in plan and "total_tokens" not in plan.split("ReadSchema")[-1].split("\n")[0]
