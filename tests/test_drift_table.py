import json

from test_drift import LINES, rows

import __spark_entry__ as entry
from loomlog.operators import drift
from loomlog.plans.data_problems import TARGET

RENAMES = {
    "quantity": "qty", "units": "qty", "amount_minor": "amount", "total": "amount", "address.city": "city", "town": "city",
    "sales_channel": "channel", "meta.channel": "channel", "orderRef": "order_ref", "order.ref": "order_ref",
    "is_active": "active", "enabled": "active",
}
DATA = "/root/testdata/sf0.001"


def test_every_field_gets_one_column(spark):
    data = rows((1, [
        {"temp": 1.5, "tags": ["a", "b"], "city": ["B"], "w": [3], "on": True}, {"temperature": "2.5", "tags": "c", "town": "D", "w": 4, "on": "no", "is_active": 0},
        {"labels": [], "big": 2**60, "Temp": 7},
    ]))
    lines = spark.createDataFrame(data, LINES)
    columns, renames = drift.target(lines, [*RENAMES.items(), ("temp", "temperature"), ("tags", "labels")], TARGET)
    got = drift.promote_all(drift.ingest(lines, TARGET, renames, single=True), {c: k for c, k in columns.items() if c not in TARGET}, renames, single=True)
    assert {"f_tags": "array<string>", "f_w": "double", "f_on": "boolean", "f_big": "string", "f_city": "string", "f_Temp": "double"}.items() <= dict(got.dtypes).items()
    r = sorted(got.collect(), key=lambda r: r["line_no"])
    assert [x["f_Temp"] for x in r] == [1.5, 2.5, 7.0] and [x["f_tags"] for x in r] == [["a", "b"], ["c"], []] and [x["f_city"] for x in r] == ["B", "D", None]
    assert [x["f_w"] for x in r] == [3.0, 4.0, None] and [x["f_on"] for x in r] == [True, False, None] and r[1]["f_active"] is False and r[2]["f_big"] == str(2**60)
    assert all(x["_rescued"] is None for x in r)


def test_p6_table_leaves_no_field_behind(spark):
    t = entry.queries()["p6_table"](spark, DATA)
    left = [k for r in t.select("_rescued").collect() if r[0] for k in json.loads(r[0]) if k != "_raw"]
    assert len(t.columns) > 15 and not left
    assert t.filter("f_city like '[%' or f_channel like '[%' or f_order_ref like '[%'").count() == 0
