"""Every query of the catalogue against its SQL in DuckDB, and the entry point."""

import os

import duckdb
import pytest

import __spark_entry__
from gridloom.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in catalogue.ORACLE_SQL:
        assert rows
        return
    got = duck.execute(catalogue.ORACLE_SQL[name])
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(df.columns)
    want = [dict(zip(columns, r)) for r in got.fetchall()]
    key = lambda r: tuple(repr(r[c]) for c in sorted(columns))
    assert sorted(key(r.asDict()) for r in rows) == sorted(map(key, want))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_forecast_plan_scans_two_columns(spark):
    plan = catalogue.gather_forecast(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,value:double>" in plan and "PythonUDF" not in plan
