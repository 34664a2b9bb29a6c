"""Aggregate state as an ordered left fold of events.

A fold is declared field by field; the declaration decides the physical form. Rules that a running frame can express
(last value, sum, count, minimum, maximum, ever) become windows: one shuffle on the aggregate serves all of them, and
versions and lags too. Final states of such rules are plain aggregates, combined map-side. Folds whose next state needs
the whole previous state run as a higher-order function over one aggregate's sorted events, or, for opaque Python, in
``applyInPandas``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlog.functions.ids import NIL
from loomlog.operators import ordered
from loomlog.session import partitions, written

#: The id of singleton aggregates, of every type.
SINGLETON = NIL


@dataclass(frozen=True)
class Field:
    """``rule`` of ``value`` over the events where ``when`` holds; ``default`` before the first such event."""

    rule: str  # last | sum | count | min | max | ever
    value: Column | None = None
    when: Column | None = None
    default: object = None


class Fold:
    def __init__(self, key: list[str], order: str, fields: dict[str, Field]):
        self.key, self.order, self.fields = key, order, fields

    def _column(self, f: Field, over=None) -> Column:
        when = F.lit(True) if f.when is None else f.when
        wrap = (lambda c: c.over(over)) if over is not None else (lambda c: c)
        if f.rule == "count":
            return wrap(F.sum(F.when(when, 1).otherwise(0))).cast("bigint")
        if f.rule == "ever":
            return F.coalesce(wrap(F.max(when)), F.lit(False))
        if f.rule == "last":
            v = F.when(when, f.value)
            c = wrap(F.last(v, ignorenulls=True)) if over is not None else F.max_by(f.value, F.when(when & f.value.isNotNull(), F.col(self.order)))
        else:
            c = wrap(getattr(F, f.rule)(F.when(when, f.value)))
        return c if f.default is None else F.coalesce(c, F.lit(f.default))

    def running(self, events: DataFrame, keep: list[str] | None = None, heavy: int = ordered.HEAVY_ROWS) -> DataFrame:
        """The state after every event; keys of more than ``heavy`` events are split over many tasks."""
        if ordered.heavy(events, self.key, heavy):
            return self.running_split(events, keep)
        w = Window.partitionBy(*self.key).orderBy(self.order).rowsBetween(Window.unboundedPreceding, 0)
        return events.select(*(keep or [*self.key, self.order]), *(self._column(f, w).alias(n) for n, f in self.fields.items()))

    def running_split(self, events: DataFrame, keep: list[str] | None = None, parts: int | None = None) -> DataFrame:
        """``running`` for keys that hold a large share of all events: the same rows, without one task per key.

        Events are range-partitioned by (key, order), so a heavy key spans many partitions; each partition folds its part,
        the parts' states (one per key and partition) are carried forward in order, and every row combines the carried
        state with its own. One shuffle of the events more than ``running``.
        """
        spark = events.sparkSession
        placed = events.repartitionByRange(parts or partitions(spark), *self.key, self.order).withColumn("_p", F.spark_partition_id())
        placed = written(placed, "split")
        w = Window.partitionBy("_p", *self.key).orderBy(self.order).rowsBetween(Window.unboundedPreceding, 0)
        bare = {n: Field(f.rule, f.value, f.when) for n, f in self.fields.items()}  # defaults come last
        keep = keep or [*self.key, self.order]
        own = placed.select(*dict.fromkeys(["_p", *self.key, *keep]), *(self._column(f, w).alias(n) for n, f in bare.items()))
        before = Window.partitionBy(*self.key).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
        totals = placed.groupBy("_p", *self.key).agg(*(self._column(f).alias(n) for n, f in bare.items()))
        over = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max, "ever": F.max}
        carried = totals.select("_p", *self.key, *((F.last(n, ignorenulls=True) if f.rule == "last" else over[f.rule](n)).over(before).alias(f"_c_{n}") for n, f in bare.items()))
        rows = own.join(carried, ["_p", *self.key], "left")
        out = []
        for n, f in self.fields.items():
            a, c = F.col(n), F.col(f"_c_{n}")
            if f.rule == "last":
                v = F.coalesce(a, c)
            elif f.rule in ("min", "max"):
                v = (F.least if f.rule == "min" else F.greatest)(a, c)
            elif f.rule == "ever":
                v = a | F.coalesce(c, F.lit(False))
            else:
                v = F.when(a.isNull(), c).otherwise(a + F.coalesce(c, F.lit(0)))
            out.append((v if f.default is None else F.coalesce(v, F.lit(f.default))).alias(n))
        return rows.select(*keep, *out)

    def final(self, events: DataFrame) -> DataFrame:
        """The state after the last event, map-side combined."""
        return events.groupBy(*self.key).agg(*(self._column(f).alias(n) for n, f in self.fields.items()))

    def seeded(self, snapshots: DataFrame, events: DataFrame) -> DataFrame:
        """The final state from snapshots (key, ``version``, the fields) and only the events after them.

        Rules that have a neutral start combine snapshot and rest; an aggregate without snapshot folds from the start. The rest
        is folded without defaults, so an event that sets a default's value counts like any other.
        """
        snap = snapshots.select(*self.key, F.col("version").alias("_at"), *(F.col(n).alias(f"_s_{n}") for n in self.fields))
        rest = events.join(snap.select(*self.key, "_at"), self.key, "left").filter(F.col("version") > F.coalesce("_at", F.lit(0)))
        after = Fold(self.key, self.order, {n: Field(f.rule, f.value, f.when) for n, f in self.fields.items()}).final(rest)
        both = after.join(snap, self.key, "full_outer")
        out = []
        for n, f in self.fields.items():
            s, a = F.col(f"_s_{n}"), F.col(n)
            if f.rule == "last":
                c = F.coalesce(a, s)
            elif f.rule in ("sum", "count"):
                c = F.coalesce(s, F.lit(0)) + F.coalesce(a, F.lit(0))
            elif f.rule == "ever":
                c = F.coalesce(s, F.lit(False)) | F.coalesce(a, F.lit(False))
            else:
                c = (F.least if f.rule == "min" else F.greatest)(s, a)
            out.append((c if f.default is None else F.coalesce(c, F.lit(f.default))).alias(n))
        return both.select(*self.key, *out)

    def as_of(self, events: DataFrame, upto: Column) -> DataFrame:
        """The state that the events up to a point (a position or a time) give."""
        return self.final(events.filter(upto))

    def transitions(self, events: DataFrame, guard: Callable[[Callable, Callable], Column], keep: list[str], heavy: int = ordered.HEAVY_ROWS) -> DataFrame:
        """The events whose (previous, next) state the guard accepts; the previous state of a first event is the default."""
        state = self.running(events, [*dict.fromkeys([*self.key, self.order, *keep])], heavy)
        state = ordered.neighbours(state, self.key, [self.order], {f"prev_{n}": n for n in self.fields}, bound=heavy)
        for n, f in self.fields.items():
            start = {"count": 0, "ever": False}.get(f.rule, f.default)
            if start is not None:
                state = state.withColumn(f"prev_{n}", F.coalesce(f"prev_{n}", F.lit(start)))
        return state.filter(guard(lambda n: F.col(f"prev_{n}"), F.col))


def fold_sorted(events: DataFrame, key: list[str], order: str, columns: list[str], start: Column, step: Callable[[Column, Column], Column]) -> DataFrame:
    """Any fold that expressions can write, as a higher-order function over each aggregate's sorted events.

    For streams of bounded length: an aggregate's events meet in one row.
    """
    grouped = events.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("_e"))
    return grouped.select(*key, F.aggregate("_e", start, step).alias("state"))


def fold_python(events: DataFrame, key: list[str], order: str, apply: Callable[[dict, dict], dict], default: Callable[[], dict], schema: str) -> DataFrame:
    """A fold in Python, for states that expressions cannot write; one row of ``schema`` (the fields) per aggregate.

    Events stream sorted through the tasks, which hold one state and one Arrow batch, however long an aggregate is.
    """
    import pandas as pd

    types = dict(events.dtypes)
    ddl = ", ".join([*(f"{k} {types[k]}" for k in key), schema])
    same = lambda a, b: a is not None and all(x == y or x != x and y != y for x, y in zip(a, b))

    def run(pdfs):
        now, state = None, None
        for pdf in pdfs:
            out = []
            for row in pdf.to_dict("records"):
                k = tuple(row[c] for c in key)
                if not same(now, k):
                    if now is not None:
                        out.append({**dict(zip(key, now)), **state})
                    now, state = k, default()
                state = apply(state, row)
            if out:
                yield pd.DataFrame(out)
        if now is not None:
            yield pd.DataFrame([{**dict(zip(key, now)), **state}])

    return events.repartition(*key).sortWithinPartitions(*key, order).mapInPandas(run, ddl)


def due(states: DataFrame, n: int, key: list[str], taken: DataFrame | None = None) -> DataFrame:
    """The states at which an automatic policy takes a snapshot: ``n`` versions after the last one, be it the policy's own or
    one of ``taken`` (key, ``version``). Versions are contiguous, so between two of ``taken`` it is each n-th version."""
    if taken is None:
        return every(states, n)
    last = ordered.latest(states, taken.select(*key, "version", F.col("version").alias("_taken")), key, "version", ["_taken"])
    since = F.col("version") - F.coalesce("_taken", F.lit(0))
    return last.filter((since > 0) & (since % n == 0)).drop("_taken")


def every(states: DataFrame, n: int) -> DataFrame:
    """The states an automatic snapshot policy keeps: each n-th version (versions are contiguous)."""
    return states.filter(F.col("version") % n == 0)


def previous_entry(timeline: DataFrame, group: str, order: str, columns: list[str]) -> DataFrame:
    """Each timeline entry with the columns of the entry before it in its group."""
    return ordered.neighbours(timeline, [group], [order], {f"prev_{c}": c for c in columns})


def islands(events: DataFrame, of: str, order: str) -> DataFrame:
    """Runs of consecutive events (by ``order``) with the same ``of``: its first and last position, length and root (the
    first without a reactor).

    The order is global, so the log is range-partitioned by it; runs are found inside the partitions and stitched across
    their borders through one row per partition, never sorting the log in one task.
    """
    placed = events.select(of, order, "event_type", "reactor_id").repartitionByRange(order).sortWithinPartitions(order)
    placed = placed.withColumn("_p", F.spark_partition_id())
    inside = Window.partitionBy("_p").orderBy(order)
    marked = placed.withColumn("_new", F.coalesce((F.lag(of).over(inside) != F.col(of)).cast("int"), F.lit(1)))
    runs = marked.withColumn("_run", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = runs.groupBy("_p", "_run", of).agg(
        F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"),
        F.min_by("event_type", F.when(F.col("reactor_id").isNull(), F.col(order))).alias("root"),
        F.min(F.when(F.col("reactor_id").isNull(), F.col(order))).alias("root_at"),
    )
    # only the first and last run of a partition can continue another: per partition two rows meet in one place
    edge_w = Window.partitionBy("_p")
    pieces = pieces.withColumn("_edge", (F.col("_run") == F.min("_run").over(edge_w)) | (F.col("_run") == F.max("_run").over(edge_w)))
    pieces = written(pieces, "islands")  # range bounds are sampled: both readers below must see the same partitions
    edges = pieces.filter("_edge")
    w = Window.orderBy("first")
    edges = edges.withColumn("_new", F.coalesce(((F.lag(of).over(w) != F.col(of)) | (F.lag("_p").over(w) == F.col("_p"))).cast("int"), F.lit(1)))
    edges = edges.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    joined = edges.groupBy("_g", of).agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"), F.min_by("root", "root_at").alias("root")
    )
    return joined.select(of, "first", "last", "n", "root").unionByName(pieces.filter("not _edge").select(of, "first", "last", "n", "root"))
