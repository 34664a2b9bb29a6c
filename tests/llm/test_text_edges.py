"""The p7..p9 queries on empty tables, null columns, very long and odd texts, and extra columns with clashing names."""

import pytest
from pyspark.sql import functions as F

from loomlog.llm import tokens
from loomlog.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
LONG = {1001: "x" * 300_000, 1002: "語" * 200_000, 1003: "a b " * 100_000, 1004: "{{" * 20_000 + "}}" * 20_000, 1005: "[[" * 20_000, 1006: "<ref>" * 20_000, 1007: " " * 100_000, 1008: "<!--" * 20_000, 1009: "\n|" * 50_000, 1010: "&amp;" * 40_000, 1011: "{| a=b" * 10_000, 1012: "''" * 50_000}


def write(spark, at, rows):
    for t in ("documents", "eval_items"):
        rows(spark.read.parquet(f"{DATA}/{t}.parquet")).write.parquet(f"{at}/{t}.parquet")
    return str(at)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), lambda df: df.limit(0))


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    def rows(df):
        some = df.limit(30)
        out = some.union(some)
        for c in df.columns:
            out = out.union(some.limit(5).withColumn(c, F.lit(None).cast(dict(df.dtypes)[c])))
        if "text" in df.columns:
            for i, t in LONG.items():
                out = out.union(some.limit(1).withColumn("doc_id", F.lit(i).cast("bigint")).withColumn("text", F.lit(t)))
        return out.select("*", *(F.lit("clash").alias(c) for c in ("ids", "block", "refs", "h", "kind", "n_windows", "piece_no", "start", "end", "boundary")))

    return write(spark, tmp_path_factory.mktemp("odd"), rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables_give_no_rows(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == []


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_texts(spark, odd, name):
    rows = QUERIES[name](spark, odd).collect()
    if name == "p7_ids":
        e = tokens.encoding()
        got = {r["doc_id"]: r["ids"] for r in rows if r["doc_id"] in LONG}
        assert got == {i: e.encode_ordinary(t) for i, t in LONG.items()}
    if name == "p9_found":
        assert {r["doc_id"] for r in rows} >= {1001, 1002, 1003}
