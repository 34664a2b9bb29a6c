"""Neighbours and numbers inside each key, without one task per key.

A window over a key sorts all of its rows in one task. Each function here first asks whether any key has more rows than
``HEAVY_ROWS`` (one map-side combined count); only then rows are range-partitioned by (key, order), so a heavy key spans many
partitions, each partition is worked on alone, and the seams are closed through one row per key and partition. Orders must be
total inside a key for results to be the same on every run; nulls come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlog.session import partitions, small, written

#: Rows of one key that a single task may sort.
HEAVY_ROWS = 1_000_000


def heavy(rows: DataFrame, keys: list[str], bound: int = HEAVY_ROWS) -> bool:
    """Has any key more than ``bound`` rows?"""
    return rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > bound).limit(1).count() > 0


def placed(rows: DataFrame, keys: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """``rows`` range-partitioned by key and order, with the partition as ``_p``; written, since range bounds are sampled and
    all readers must see the same partitions."""
    return written(rows.repartitionByRange(parts or partitions(rows.sparkSession), *keys, *order).withColumn("_p", F.spark_partition_id()), "placed")


def _same(keys: list[str], a: str, b: str) -> Column:
    cond = F.col(f"{a}._p") == F.col(f"{b}._p")
    for k in keys:
        cond = cond & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return cond


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str, bound: int = HEAVY_ROWS) -> DataFrame:
    """``rows`` with ``name``: 1, 2, ... inside each key by ``order``."""
    if not heavy(rows, keys, bound):
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))
    at = placed(rows, keys, order)
    before = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    shift = at.groupBy("_p", *keys).agg(F.count("*").alias("_n")).withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    own = at.withColumn(name, F.row_number().over(Window.partitionBy("_p", *keys).orderBy(*order)))
    out = own.alias("a").join(small(shift.select("_p", *keys, "_shift")).alias("b"), _same(keys, "a", "b"))
    return out.select(*(F.col(f"a.{c}") for c in rows.columns if c != name), (F.col(f"a.{name}") + F.col("b._shift")).cast("bigint").alias(name))


def running_sum(rows: DataFrame, keys: list[str], order: list[str], name: str, of: str, bound: int = HEAVY_ROWS) -> DataFrame:
    """``rows`` with ``name``: the sum of ``of`` up to and with each row in its key; nulls add nothing."""
    upto = lambda w: F.sum(of).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    if not heavy(rows, keys, bound):
        return rows.withColumn(name, upto(Window.partitionBy(*keys)))
    at = placed(rows, keys, order)
    before = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    carried = at.groupBy("_p", *keys).agg(F.sum(of).alias("_s")).withColumn("_c", F.sum("_s").over(before))
    out = at.withColumn(name, upto(Window.partitionBy("_p", *keys))).alias("a").join(small(carried.select("_p", *keys, "_c")).alias("b"), _same(keys, "a", "b"))
    total = F.when(F.col(f"a.{name}").isNull(), F.col("b._c")).otherwise(F.col(f"a.{name}") + F.coalesce("b._c", F.lit(0)))
    return out.select(*(F.col(f"a.{c}") for c in rows.columns if c != name), total.alias(name))


def neighbours(rows: DataFrame, keys: list[str], order: list[str], before: dict[str, str] | None = None, after: dict[str, str] | None = None, bound: int = HEAVY_ROWS) -> DataFrame:
    """``rows`` with columns of the row before (``before``: new name to column) and of the row after it in its key."""
    before, after = before or {}, after or {}
    w = Window.partitionBy(*keys).orderBy(*order)
    if not heavy(rows, keys, bound):
        return rows.select("*", *(F.lag(c).over(w).alias(n) for n, c in before.items()), *(F.lead(c).over(w).alias(n) for n, c in after.items()))
    at = placed(rows, keys, order)
    inside = Window.partitionBy("_p", *keys).orderBy(*order)
    own = at.select(
        "*", F.row_number().over(inside).alias("_i"), F.lead(F.lit(1)).over(inside).alias("_more"),
        *(F.lag(c).over(inside).alias(f"_b_{n}") for n, c in before.items()), *(F.lead(c).over(inside).alias(f"_a_{n}") for n, c in after.items()),
    )
    place = F.struct(*order)
    ends = at.groupBy("_p", *keys).agg(
        F.max(F.struct(place.alias("o"), F.struct(*(F.col(c).alias(n) for n, c in before.items()), F.lit(1).alias("_x")).alias("v")))["v"].alias("_last"),
        F.min(F.struct(place.alias("o"), F.struct(*(F.col(c).alias(n) for n, c in after.items()), F.lit(1).alias("_x")).alias("v")))["v"].alias("_first"),
    )
    by = Window.partitionBy(*keys).orderBy("_p")
    seams = ends.select("_p", *keys, F.lag("_last").over(by).alias("_l"), F.lead("_first").over(by).alias("_f"))
    out = own.alias("a").join(small(seams).alias("b"), _same(keys, "a", "b"))
    return out.select(
        *(F.col(f"a.{c}") for c in rows.columns),
        *(F.when(F.col("a._i") == 1, F.col(f"b._l.{n}")).otherwise(F.col(f"a._b_{n}")).alias(n) for n in before),
        *(F.when(F.col("a._more").isNull(), F.col(f"b._f.{n}")).otherwise(F.col(f"a._a_{n}")).alias(n) for n in after),
    )


def latest(probes: DataFrame, states: DataFrame, keys: list[str], order: str, columns: list[str], bound: int = HEAVY_ROWS) -> DataFrame:
    """As-of join: each probe with the ``columns`` of the last state of its key at or before its ``order``, null where there is
    none. Probes and states are one stream sorted once; of equal orders the state comes first."""
    a = states.select(*keys, order, F.lit(0).alias("_probe"), F.struct(*columns).alias("_s"), F.lit(None).cast(probes.schema).alias("_r"))
    b = probes.select(*keys, order, F.lit(1).alias("_probe"), F.lit(None).cast(a.schema["_s"].dataType).alias("_s"), F.struct(*probes.columns).alias("_r"))
    rows = a.unionByName(b)
    w = Window.partitionBy(*keys).orderBy(order, "_probe").rowsBetween(Window.unboundedPreceding, 0)
    if not heavy(rows, keys, bound):
        out = rows.withColumn("_s", F.last("_s", ignorenulls=True).over(w))
    else:
        at = placed(rows, keys, [order, "_probe"])
        inside = Window.partitionBy("_p", *keys).orderBy(order, "_probe").rowsBetween(Window.unboundedPreceding, 0)
        by = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
        ends = at.filter("_s is not null").groupBy("_p", *keys).agg(F.max(F.struct(order, "_s"))["_s"].alias("_e"))
        seams = at.select("_p", *keys).distinct().alias("a").join(ends.alias("b"), _same(keys, "a", "b"), "left").select("a._p", *(F.col(f"a.{k}") for k in keys), "b._e").withColumn("_c", F.last("_e", ignorenulls=True).over(by))
        out = at.withColumn("_s", F.last("_s", ignorenulls=True).over(inside)).alias("a").join(small(seams.select("_p", *keys, "_c")).alias("b"), _same(keys, "a", "b"))
        out = out.select("a._probe", "a._r", F.coalesce("a._s", "b._c").alias("_s"))
    return out.filter("_probe = 1").select("_r.*", *(F.col(f"_s.{c}").alias(c) for c in columns))
