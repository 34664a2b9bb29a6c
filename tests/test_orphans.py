import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from loomlog.operators import orphans

CODES = st.lists(st.integers(0, 200_000), max_size=60)


@given(CODES, CODES, st.booleans())
@settings(max_examples=60, deadline=None)
def test_bitmaps(a, b, dense):
    if dense:
        a = [*a, *range(5000)]
    x, y = orphans.Bitmap(np.array(a, np.int64)), orphans.Bitmap(np.array(b, np.int64))
    assert x.codes().tolist() == sorted(set(a))
    assert x.and_not(y).codes().tolist() == sorted(set(a) - set(b))
    assert (x & y).codes().tolist() == sorted(set(a) & set(b))
    assert y.and_not(x).codes().tolist() == sorted(set(b) - set(a))


def test_find(spark):
    rng = random.Random(3)
    keys = [bytes([i]) for i in range(60)]
    events = {k: rng.randrange(1000) for k in keys[:30]}
    dead = keys[25:45]
    refs = []
    for h in range(1500):
        k = keys[59] if rng.random() < 0.4 else rng.choice(keys)
        us = None if rng.random() < 0.1 else rng.randrange(1000)
        refs.append((rng.randrange(2), h // 2, bytearray(k), us, -1 if us is None else us // 100, "x"))
    r = spark.createDataFrame(refs, "ref_table int, holder bigint, key binary, us bigint, month int, state string")
    e = spark.createDataFrame([(bytearray(k), t, "x") for k, t in events.items()], "key binary, us bigint, slot string")
    d = spark.createDataFrame([(bytearray(k),) for k in [*dead, dead[0]]], "key binary")
    want = set()
    for table, holder, k, us, month, _ in refs:
        k = bytes(k)
        if k not in events:
            want.add((table, month, holder, k, "deleted" if k in dead else "missing"))
        elif us is not None and us < events[k]:
            want.add((table, month, holder, k, "late"))
    got = [(x["ref_table"], x["month"], x["holder"], bytes(x["key"]), x["state"]) for x in orphans.find(r, e, d, 3).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert orphans.find(r.limit(0), e.limit(0), d.limit(0), 2).count() == 0
    assert {x["state"] for x in orphans.find(r, e.limit(0), d.limit(0), 2).collect()} == {"missing"}


def test_heavy_keys_are_joined_apart(spark):
    rng = random.Random(5)
    keys = [bytes([i]) for i in range(20)]
    refs = [(0, h, bytearray(keys[h % 3] if h % 2 else rng.choice(keys)), h, 1) for h in range(900)]
    r = spark.createDataFrame(refs, "ref_table int, holder bigint, key binary, us bigint, month int")
    e = spark.createDataFrame([(bytearray(k), 300) for k in (keys[0], keys[1], keys[7])], "key binary, us bigint")  # 0 and 1 are heavy, 1 late for some
    d = spark.createDataFrame([(bytearray(keys[2]),)], "key binary")
    rows = lambda heavy: sorted((x["holder"], bytes(x["key"]), x["state"]) for x in orphans.find(r, e, d, 3, heavy).collect())
    assert rows(100) == rows(10**9) == rows(0) != []
