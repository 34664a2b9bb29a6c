"""Numbers, neighbours and as-of states with and without heavy keys, against plain Python."""

import random

from loomlog.operators import fold, ordered
from pyspark.sql import functions as F


def data(seed=1, n=600):
    rng = random.Random(seed)
    order = rng.sample(range(10 * n), n)
    return [(rng.choice(["hot"] * 5 + ["a", "b", None]), order[i], rng.choice([None, *range(9)]), "x") for i in range(n)]


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r[1]):
        out.setdefault(r[0], []).append(r)
    return out


SCHEMA = "k string, at bigint, v bigint, extra string"


def test_numbered_and_neighbours(spark):
    rows = data()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = {}
    for k, rs in by_key(rows).items():
        for i, r in enumerate(rs):
            want[k, r[1]] = (i + 1, rs[i - 1][2] if i else None, rs[i + 1][1] if i + 1 < len(rs) else None)
    for bound in (10**6, 50):
        got = ordered.numbered(df, ["k"], ["at"], "n", bound)
        assert {(r["k"], r["at"]): r["n"] for r in got.collect()} == {k: w[0] for k, w in want.items()} and got.columns == [*df.columns, "n"]
        got = ordered.neighbours(df, ["k"], ["at"], {"pv": "v"}, {"na": "at"}, bound)
        assert {(r["k"], r["at"]): (r["pv"], r["na"]) for r in got.collect()} == {k: w[1:] for k, w in want.items()}
        assert ordered.numbered(df.limit(0), ["k"], ["at"], "n", bound).count() == 0


def test_running_sum(spark):
    rows = data(5)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = {}
    for k, rs in by_key(rows).items():
        total = None
        for r in rs:
            total = total if r[2] is None else (total or 0) + r[2]
            want[k, r[1]] = total
    for bound in (10**6, 50):
        assert {(r["k"], r["at"]): r["s"] for r in ordered.running_sum(df, ["k"], ["at"], "s", "v", bound).collect()} == want


def test_lookup_of_heavy_keys(spark):
    from loomlog.session import lookup

    rows = [(i, "hot" if i % 3 else f"k{i % 7}" if i % 5 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "i bigint, k string")
    of = spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", 3)], "k string, v int")
    for how in ("left", "inner"):
        got = [sorted(((r["i"], r["k"], r["v"]) for r in lookup(df, of, "k", how, heavy).select("i", "k", "v").collect()), key=repr) for heavy in (10**6, 100, 10, 0)]
        assert got[0] == got[1] == got[2] == got[3] and len(got[0]) == (300 if how == "left" else sum(k in ("hot", "k0", "k3") for _, k in rows))


def test_latest(spark):
    states, probes = data(2, 300), data(3, 200)
    a, b = spark.createDataFrame(states, SCHEMA), spark.createDataFrame(probes, "k string, at bigint, v bigint, extra string").withColumnRenamed("v", "own")
    want = []
    for k, at, v, x in probes:
        past = [s for s in states if s[0] == k and s[1] <= at]
        want.append((k, at, v, x, max(past, key=lambda s: s[1])[2] if past else None))
    for bound in (10**6, 30):
        got = ordered.latest(b, a, ["k"], "at", ["v"], bound)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr) and got.columns == ["k", "at", "own", "extra", "v"]
        assert ordered.latest(b, a.limit(0), ["k"], "at", ["v"], bound).filter("v is not null").count() == 0


def test_a_running_fold_splits_heavy_keys_itself(spark):
    df = spark.createDataFrame(data(4), SCHEMA).filter("k is not null")
    f = fold.Fold(["k"], "at", {"n": fold.Field("count"), "s": fold.Field("sum", value=F.col("v")), "l": fold.Field("last", value=F.col("v"), default=-1)})
    rows = lambda heavy: sorted(map(tuple, f.running(df, heavy=heavy).collect()))
    assert rows(10**6) == rows(20)
    t = lambda heavy: sorted(map(tuple, f.transitions(df, lambda prev, nxt: prev("l") != nxt("l"), ["v"], heavy=heavy).select("k", "at", "prev_l", "l").collect()))
    assert t(10**6) == t(20) != []


def test_a_snapshot_then_the_default_value(spark):
    """The newest event sets the default's own value: the snapshot must not win."""
    f = fold.Fold(["k"], "version", {"st": fold.Field("last", value=F.col("st"), default="none"), "t": fold.Field("last", value=F.col("t"), default=0.0), "n": fold.Field("count")})
    e = spark.createDataFrame([("a", 1, "open", 5.0), ("a", 2, "none", 0.0), ("b", 1, "open", 5.0), ("c", 1, None, None)], "k string, version bigint, st string, t double")
    snaps = spark.createDataFrame([("a", 1, "open", 5.0, 1), ("b", 1, "open", 5.0, 1), ("d", 3, "none", 1.0, 3)], "k string, version bigint, st string, t double, n bigint")
    got = {r["k"]: tuple(r)[1:] for r in f.seeded(snaps, e).collect()}
    assert got == {"a": ("none", 0.0, 2), "b": ("open", 5.0, 1), "c": ("none", 0.0, 1), "d": ("none", 1.0, 3)}


def test_the_policy_counts_from_the_last_snapshot(spark):
    rows = [("a", v) for v in range(1, 31)] + [("b", v) for v in range(1, 26)]
    states = spark.createDataFrame(rows, "k string, version bigint")
    taken = spark.createDataFrame([("a", 7), ("a", 20)], "k string, version bigint")
    got = {(r["k"], r["version"]) for r in fold.due(states, 10, ["k"], taken).collect()}
    assert got == {("a", 17), ("a", 30), ("b", 10), ("b", 20)}
