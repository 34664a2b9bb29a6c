"""The p1..p6 queries on empty tables and on rows with a null in each column, repeats, and extra columns with clashing names."""

import json

import pytest
from pyspark.sql import functions as F

from loomlog.plans.data_problems import QUERIES, TARGET

DATA = "/root/testdata/sf0.001"
TABLES = ["stored_events", "reactor_outcomes", "intent_commits", "pointer_status", "event_tombstones", "archive_lines", "upcasters"]
CLASH = ["key", "parent", "top", "depth", "field", "text", "kind", "slot", "state", "us", "month", "role", "path", "change", "h", "e", "p", "_p", "w", "m"]


def write(spark, at, rows):
    for t in TABLES:
        df = spark.read.parquet(f"{DATA}/{t}.parquet")
        rows(df).write.parquet(f"{at}/{t}.parquet")
    return str(at)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), lambda df: df.limit(0))


@pytest.fixture(scope="module")
def holes(spark, tmp_path_factory):
    def rows(df):
        some = df.limit(40)
        out = some.union(some)
        for c in df.columns:
            out = out.union(some.limit(15).withColumn(c, F.lit(None).cast(dict(df.dtypes)[c])))
        nothing = some.limit(1).select(*(F.lit(None).cast(t).alias(c) for c, t in df.dtypes))
        out = out.union(nothing).union(nothing)
        return out.select("*", *(F.lit("clash").alias(c) for c in CLASH if c not in df.columns))

    return write(spark, tmp_path_factory.mktemp("holes"), rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables_give_no_rows(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == []


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_nulls_repeats_and_extra_columns(spark, holes, name):
    df = QUERIES[name](spark, holes)
    rows = df.collect()
    if name.endswith("_found") and name != "p3_found":
        assert len(set(rows)) == len(rows) or name == "p5_found"
    if name == "p6_table":  # one column for every field that the data hold, so other data have others; the target's are always there
        columns = [f"f_{c}" for c in TARGET]
        assert df.columns[:4] == ["line_no", "producer", "segment_no", "event_type"] and set(columns) <= set(df.columns) and df.columns[-1] == "_rescued"
        left = [k for r in rows if r["_rescued"] for k in json.loads(r["_rescued"]) if k != "_raw"]
        assert not left
    else:
        assert df.columns == QUERIES[name](spark, DATA).columns
