"""Upcasting as an expression against the Python steps."""

import json

import pytest
from loomlog.functions import text
from pyspark.sql import functions as F

STEPS = [
    ("a", 0, '{"op": "set", "field": "x", "value": {"k": [1, null, "q\\"uote"]}}'), ("a", 1, '{"op": "rename", "from": "old", "to": "m.new"}'), ("a", 2, '{"op": "drop", "field": "m.gone"}'),
    ("a", 3, '{"op": "cast", "field": "n", "to": "string"}'), ("a", 3, '{"op": "rename", "from": "m.up", "to": "up"}'), ("b", 5, '{"op": "set", "field": "m.z", "value": null}'),
]
DOCS = [
    '{"old": 1, "n": 5}', '{"old": null, "m": {"gone": 1, "keep": "é\\n"}, "n": "7"}', '{"m": 5, "old": 2}', '{"m": {"up": [1, {"z": 2}], "new": 0}, "n": 1.5}', '{"n": null}', "{}", "[1]", '"text"',
    "{broken", '{"old": 1}}', '{"old": 1}, {"old": 2}', None, '{"k\\"ey": true, "m": null, "n": 12345678901234567890, "old": "x"}',
]


def test_the_expression_does_what_the_steps_do(spark):
    rows = [(t, v, p) for t in ("a:one", "a", "b:x", "c", None) for v in (None, 0, 1, 2, 3, 4, 9) for p in DOCS]
    df = spark.createDataFrame(rows, "t string, v int, p string")
    one = text.upcast(F.col("t"), F.col("v"), F.col("p"), STEPS)
    up = text.upcaster(STEPS)

    def value(x):
        try:
            return json.loads(x)
        except (TypeError, ValueError):
            return x

    for r in df.select("t", "v", "p", one.alias("one"), up("t", "v", "p").alias("two")).collect():
        assert value(r["one"]) == value(r["two"]), r
    assert "ArrowEvalPython" not in df.select(one)._jdf.queryExecution().executedPlan().toString()


def test_no_steps_and_deep_steps(spark):
    df = spark.createDataFrame([("a", 0, "{}")], "t string, v int, p string")
    assert df.select(text.upcast(F.col("t"), F.col("v"), F.col("p"), [])).first()[0] == "{}"
    with pytest.raises(ValueError):
        text.upcast(F.col("t"), F.col("v"), F.col("p"), [("a", 0, '{"op": "drop", "field": "a.b.c"}')])
