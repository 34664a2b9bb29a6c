"""Every query with an SQL twin against DuckDB on the smallest tables; the others must run."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from loomlog.plans import data_problems, data_problems_sql, engine, reference, reference_sql, streams  # noqa: F401

DATA = "/root/testdata/sf0.001"
QUERIES = reference.QUERIES | data_problems.QUERIES
ORACLES = reference_sql.ORACLES | data_problems_sql.ORACLES


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


def canon(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    if hasattr(v, "isoformat"):
        return str(pd.Timestamp(v))
    return repr(round(v, 6)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan and "BatchEvalPython" not in plan
    rows = df.collect()
    if name not in ORACLES:
        assert df.columns
        return
    r = duck.execute(ORACLES[name])
    columns = [x[0] for x in r.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    want = sorted(tuple(canon(x[columns.index(c)]) for c in order) for x in r.fetchall())
    assert sorted(tuple(canon(x[c]) for c in order) for x in rows) == want


def test_filters_and_columns_reach_the_scan(spark):
    from loomlog.sources import log as L
    from loomlog.sources.fixtures import events_log

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    page = plan(L.list_events(events_log(spark, DATA), 50, cursor=900))
    assert "LessThan(position,900)" in page and "TakeOrderedAndProject" in page
    scan = [x for x in plan(data_problems.p2_found(spark, DATA)).splitlines() if "ReadSchema" in x]
    assert all("payload" not in x for x in scan)


def test_entry(spark):
    assert entry.entry(spark).columns == ["id", "top_id", "depth"]
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
