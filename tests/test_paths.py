import random

import pandas as pd
import pytest
from test_hierarchy import SCHEMA, brute, forest

import __spark_entry__ as entry
from loomlog.operators import hierarchy

DATA = "/root/testdata/sf0.001"


def walk(up):
    """Independent: key to its path, None on and below loops."""
    out = {}
    for k in up:
        path = [k]
        while up[path[0]] in up and up[path[0]] not in path:
            path.insert(0, up[path[0]])
        out[k] = None if up[path[0]] in up else path
    return out


def clean(x):
    x = (x or "").strip(" \t\r\n")
    h = x.lower().translate(str.maketrans("", "", "{}()-")).removeprefix("urn:uuid:")
    if not x or h == "0" * 32:
        return None
    return f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}" if len(h) == 32 and not set(h) - set("0123456789abcdef") else x


@pytest.fixture(scope="module")
def log():
    up = {}
    for r in pd.read_parquet(f"{DATA}/stored_events.parquet", columns=["seq", "id", "parent_id"]).sort_values("seq").itertuples():
        if clean(r.id) is not None:
            up.setdefault(clean(r.id), clean(r.parent_id))
    return walk(up)


def test_p1_paths(spark, log):
    rows = entry.queries()["p1_paths"](spark, DATA).collect()
    assert len(rows) == len(log) and {r["id"]: r["path"] and r["path"].split("/") for r in rows} == log
    assert all((r["top_id"], r["depth"]) == (log[r["id"]][0], len(log[r["id"]]) - 1) for r in rows if r["path"] is not None)
    assert all(r["depth"] == -1 and r["top_id"] in log for r in rows if r["path"] is None)


def test_p1_descendants(spark, log):
    rows = entry.queries()["p1_descendants"](spark, DATA).collect()
    want = sorted((a, k, len(p) - 1 - i) for k, p in log.items() if p for i, a in enumerate(p[:-1]))
    assert want and sorted((r["id"], r["descendant_id"], r["distance"]) for r in rows) == want


@pytest.mark.parametrize("n,loops,local,parts,base", [(0, 0, True, 3, 10), (300, 6, True, 4, 200_000), (300, 6, False, 4, 3), (400, 10, True, 8, 3), (200, 0, False, 3, 1)])
def test_paths_through_the_quotient(spark, n, loops, local, parts, base):
    nodes = forest(random.Random(n + loops), n, loops, local)
    df = spark.createDataFrame([(bytearray(k), None if p is None else bytearray(p), i, "x", "y") for i, (k, p) in enumerate(nodes)], SCHEMA)
    got = hierarchy.paths(df, hierarchy.resolve(df, parts, base), parts, base).collect()
    assert len(got) == n and {bytes(r["key"]): r["path"] and [bytes(x) for x in r["path"]] for r in got} == walk(dict(nodes))
    assert all((r["path"] is None) == (brute(nodes)[bytes(r["key"])][1] < 0) for r in got)
