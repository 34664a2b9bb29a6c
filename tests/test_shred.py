import json

from loomlog.operators import shred

IDS = {"shipments": ("shipment", "shipment_id"), "lines": ("line", "line_id"), "components": ("line", "line_id"), "adjustments": ("adjustment", "adj_id")}


def brute(v, around=""):
    """Independent recursive reading."""
    if isinstance(v, str):
        try:
            w = json.loads(v)
        except ValueError:
            return []
        return brute(w, around) if isinstance(w, (dict, list)) else []
    if isinstance(v, list):
        return [r for x in v for r in brute(x, around)]
    if not isinstance(v, dict):
        return []
    out = []
    for k, x in v.items():
        if k not in IDS:
            out += brute(x, around)
            continue
        kind, own = IDS[k]
        if isinstance(x, str):
            try:
                x = json.loads(x)
            except ValueError:
                continue
        if isinstance(x, dict) and own not in x:
            held = [(r, key) for key, r in x.items() if isinstance(r, dict)]
        else:
            held = [(r, k) for r in (x if isinstance(x, list) else [x]) if isinstance(r, dict)]
        for r, key in held:
            rid = r.get(own) or key
            out.append((kind, rid, around))
            out += brute({a: b for a, b in r.items()}, rid)
    return out


SAMPLES = [
    {"shipments": [None, {"shipment_id": "s1", "lines": {"l1": {"qty": 1}, "l2": {"components": json.dumps([{"line_id": "l3", "adjustments": {"adj_id": "a1"}}])}}}]},
    {"details": {"lines": {"line_id": "l9", "details": {"adjustments": {"a1": {"cents": 1}}}}}},
    {"lines": {}, "adjustments": [], "shipments": None},
    {"state": json.dumps({"lines": [{"line_id": "x", "note": "[not json"}]})},
    {"lines": "[{\"line_id\": \"cut"},
    [], "text", None, 5,
]


def test_records_match_brute_force():
    a = shred.Automaton()
    for s in SAMPLES:
        assert sorted((k, r, p) for k, _, r, p, _ in shred.records(s, a)) == sorted(brute(s))


def test_automaton_names_structures():
    a, b = shred.Automaton(), shred.Automaton()
    assert a.state({"x": 1, "y": [1, 2]}) == b.state({"y": [3], "x": 9.5}) != a.state({"x": "1", "y": [1]})
    assert a.variant({"line_id": "1", "qty": 1, "lines": []}) == a.variant({"line_id": "2", "qty": 3, "lines": None})


def test_tables(spark):
    texts = [(f"e{i}", json.dumps(s), "x") for i, s in enumerate(SAMPLES)] + [("n", None, "x"), ("b", "{\"lines\": [", "x"), ("nan", "{\"lines\": [{\"line_id\": NaN}]}", "x")]
    df = shred.shred(spark.createDataFrame(texts, "event_id string, text string, kind string"), "src", False)
    got = sorted((r["event_id"], r["kind"], r["record_id"], r["parent_record_id"]) for r in df.collect())
    assert got == sorted((f"e{i}", *r) for i, s in enumerate(SAMPLES) for r in brute(s))
    lines = {r["record_id"]: r for r in shred.subtype(df, "line").collect()}
    assert lines["l1"]["qty"] == 1 and lines["l1"]["parent_record_id"] == "s1" and lines["l1"]["sku"] is None
    assert shred.variants(df).count() > 2
    assert shred.shred(spark.createDataFrame([], "event_id string, text string"), "src", True).count() == 0


def test_per_key_and_depth(spark):
    snaps = json.dumps({"Order:1": {"lines": [{"line_id": "a"}]}, "Order:2": json.dumps({"lines": [{"line_id": "b"}]}), "lines": [{"line_id": "c"}]})
    df = shred.shred(spark.createDataFrame([("e", snaps)], "event_id string, text string"), "s", True)
    assert sorted((r["aggregate_key"], r["record_id"]) for r in df.collect()) == [("Order:1", "a"), ("Order:2", "b"), ("lines", "c")]
    deep = {"lines": [{"line_id": "0"}]}
    for i in range(1, 400):
        deep = {"lines": [{"line_id": str(i), "details": deep}]}
    assert len(list(shred.records(deep, shred.Automaton()))) == 400
    text = '{"details":[' * 1500 + '{"lines":[{"line_id":"x"}]}' + "]}" * 1500
    assert [r[2] for r in shred.records(shred.parse(text), shred.Automaton())] == ["x"]
