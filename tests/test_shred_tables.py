import json

import __spark_entry__ as entry
from loomlog.operators import shred

DATA = "/root/testdata/sf0.001"
STATE = {"shipments": [
    {"shipment_id": "s1", "carrier": "c", "address": {"zone": "Z1", "geo": {"x": 1.5}}, "tags": ["a", [2, None]], "more": {"t": [{"k": 1}]}},
    {"shipment_id": "s2", "weight": 3, "Carrier": "d", "variant": True, "address": {"lines": [{"line_id": "l", "qty": 2.5, "opt": "x"}]}},
]}


def test_every_field_has_a_column_or_child_row(spark):
    df = shred.shred(spark.createDataFrame([("e", json.dumps(STATE))], "event_id string, text string"), "s", False).cache()
    t = shred.subtype(df, "shipment")
    rows = {r["record_id"]: r.asDict() for r in t.collect()}
    assert dict(t.dtypes) | {"carrier": "string", "address.geo.x": "double", "weight": "bigint", "variant_": "boolean"} == dict(t.dtypes)
    assert rows["s1"]["address.zone"] == "Z1" and rows["s1"]["address.geo.x"] == 1.5 and rows["s1"]["weight"] is None
    assert rows["s2"]["Carrier_"] == "d" and rows["s2"]["weight"] == 3 and rows["s2"]["carrier"] is None
    lists = {(r["record_id"], r["field"], r["position"], r["value"]) for r in shred.lists(df).collect()}
    assert lists == {("s1", "tags", "0", "a"), ("s1", "tags", "1.0", "2"), ("s1", "tags", "1.1", None), ("s1", "more.t.k", "0", "1")}
    line = shred.subtype(df, "line").first()
    assert (line["qty"], line["opt"], line["parent_record_id"]) == (2.5, "x", "s2")
    one = shred.subtype(df, "shipment", rows["s1"]["variant"])
    assert one.count() == 1 and "weight" not in one.columns and "address.zone" in one.columns


def test_tables_of_all_kinds(spark):
    got = {k: entry.queries()[f"p3_{k}s"](spark, DATA) for k in ("shipment", "line", "adjustment")}
    found = entry.queries()["p3_found"](spark, DATA).groupBy("kind").count().collect()
    assert {k: df.count() for k, df in got.items()} == {r["kind"]: r["count"] for r in found}
    assert got["shipment"].filter("`address.zone` is null").count() == 0
