import random
from collections import defaultdict

from loomlog.operators import skew


def test_profile_with_a_hot_key(spark):
    rng = random.Random(2)
    rows = [("a", bytearray(b"hot") if rng.random() < 0.6 else bytearray([rng.randrange(9)]), i, rng.randrange(10**6)) for i in range(5000)]
    rows += [("b", r[1], r[2], r[3]) for r in rows[:500]]
    got = skew.profile(spark.createDataFrame([(*r, "x", 1) for r in rows], "field string, key binary, seq bigint, ts bigint, extra string, n int"), 7)
    by = defaultdict(list)
    for f, k, s, t in rows:
        by[f, bytes(k)].append((s, t))
    want = {}
    for k, v in by.items():
        v.sort()
        want[k] = (len(v), v[0][0], v[-1][0], max([0, *(b[1] - a[1] for a, b in zip(v, v[1:]))]))
    out = {(r["field"], bytes(r["key"])): (r["n"], r["first_seq"], r["last_seq"], max(0, r["max_step"])) for r in got.collect()}
    assert out == want


def test_empty(spark):
    assert skew.profile(spark.createDataFrame([], "field string, key binary, seq bigint, ts bigint"), 3).count() == 0


def test_at_most_one_state_per_key_and_partition(spark):
    from pyspark.sql import functions as F

    n = 120_000
    rows = spark.range(n).select(F.lit("a").alias("field"), F.encode(F.lit("hot"), "UTF-8").alias("key"), F.col("id").alias("seq"), (F.col("id") * 3).alias("ts"))
    placed = rows.repartitionByRange(4, "seq").sortWithinPartitions("seq")
    states = placed.mapInArrow(skew._runs, skew._PARTIAL_DDL).collect()
    assert len(states) == 4 and sum(r["n"] for r in states) == n and {r["max_step"] for r in states} == {3}
    got = skew.profile(rows, 6).collect()
    assert [(r["n"], r["first_seq"], r["last_seq"], r["first_ts"], r["last_ts"], r["max_step"]) for r in got] == [(n, 0, n - 1, 0, 3 * (n - 1), 3)]


def test_rows_without_time_make_no_pause(spark):
    rows = [("a", bytearray(b"k"), s, t) for s, t in ((1, 100), (2, None), (3, 500), (4, 520), (None, 7))] + [("a", bytearray(b"n"), 1, None), ("a", bytearray(b"n"), 2, 9)]
    for parts in (1, 5):
        got = {bytes(r["key"]): tuple(r)[2:] for r in skew.profile(spark.createDataFrame(rows, "field string, key binary, seq bigint, ts bigint"), parts).collect()}
        assert got == {b"k": (5, None, 4, 7, 520, 93), b"n": (2, 1, 2, None, 9, 0)}
