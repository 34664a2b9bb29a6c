import json

from loomlog.operators import drift

LINES = "line_no bigint, producer string, segment_no int, event_type string, payload string, path string"


def rows(*segments, producer="p", kind="t"):
    return [(i, producer, n, kind, x if x is None or isinstance(x, str) else json.dumps(x), "clash") for n, lines in segments for i, x in enumerate(lines)]


def changes(spark, data):
    got = drift.report(spark.createDataFrame(data, LINES)).collect()
    return {(r["producer"], r["segment_no"], r["field"], r["old_field"], r["change"]) for r in got}


def test_changes(spark):
    data = rows(
        (1, [{"qty": 5, "a": {"b": "x"}, "tags": ["k"], "gone": 1}, {"qty": 7}, "{broken", None, "", "[1]"]),
        (3, [{"quantity": 7, "b": "x", "tags": ["k"], "new": None}, json.dumps({"quantity": 5}), {}]),
        (4, [None, "[2]"]),
        (9, [{"quantity": "7", "b": "x", "tags": None, "new": 3}]),
    )
    data += rows((1, [{"z": 1}]), producer=None) + rows((1, [{"z": 1}]), (2, [{"z": 1}]), producer="same")
    assert changes(spark, data + data) == {
        ("p", 3, "quantity", "qty", "renamed"), ("p", 3, "b", "a.b", "renamed"), ("p", 3, "gone", "", "removed"), ("p", 3, "new", "", "added"),
        ("p", 9, "quantity", "", "retyped"),
    }


def test_rename_goes_to_the_best_pair(spark):
    data = rows((1, [{"a": 1, "b": 2}, {"a": 3, "b": 4}]), (2, [{"c": 1, "d": 2}, {"c": 3, "d": 1}]))
    assert changes(spark, data) == {("p", 2, "c", "a", "renamed"), ("p", 2, "d", "b", "renamed")}
    assert changes(spark, []) == set()


def test_rescue_and_promotion(spark):
    lines = rows((1, [{"qty": 5, "x": {"y": [1]}, "city": "B"}, {"quantity": 6.5}, {"qty": "many", "city": 3}, "{broken", None, json.dumps({"qty": True})]))
    table = drift.ingest(spark.createDataFrame(lines, LINES), {"qty": "double", "city": "string"}, {"quantity": "qty"})
    got = {r["line_no"]: (r["f_qty"], r["f_city"], None if r["_rescued"] is None else json.loads(r["_rescued"])) for r in table.collect()}
    assert got == {
        0: (5.0, "B", {"x.y": [1]}), 1: (6.5, None, None), 2: (None, "3", {"qty": "many"}), 3: (None, None, {"_raw": "{broken"}), 4: (None, None, None),
        5: (None, None, {"qty": True}),
    }
    promoted = {r["line_no"]: (r["f_x__y"], r["_rescued"]) for r in drift.promote(table, "x.y", "string").collect()}
    assert promoted[0] == ("[1]", None) and promoted[2] == (None, '{"qty": "many"}')
