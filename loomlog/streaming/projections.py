"""Projections over a log: full replay with stage, gate and promotion, and live tailing with Structured Streaming."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from loomlog.session import scratch_path, written
from loomlog.streaming.pointer import Pointer

log_ = logging.getLogger(__name__)


def replay(log: DataFrame, pointer: Pointer, apply: Callable[[DataFrame, int, int], None], gate: Callable[[], bool] | None = None, interval: int | None = None) -> int:
    """Rebuild a projection from the start of the log up to its position now, then promote it.

    ``apply`` gets the events of (after, upto]; with an ``interval`` the log goes through it in steps of so many
    positions, each staged. An error ends the replay and promotes nothing; so does a gate that says no. For several steps the
    log is first written once by step, so each reads its own files only.
    """
    target = log.agg(F.coalesce(F.max("position"), F.lit(0))).first()[0]
    at = 0
    if interval and interval < target:
        path = scratch_path(log.sparkSession, "steps")
        step = F.floor((F.col("position") - 1) / interval).cast("bigint")
        log.filter(F.col("position").between(1, target)).withColumn("_step", step).repartitionByRange("position").write.partitionBy("_step").parquet(path)
        steps = log.sparkSession.read.schema(StructType([*log.schema.fields, StructField("_step", LongType())])).parquet(path)
    while at < target:
        upto = min(target, at + interval) if interval else target
        if interval and interval < target:
            part = steps.filter(F.col("_step") == at // interval).select(*log.columns)
        else:
            part = log.filter((F.col("position") > at) & (F.col("position") <= upto))
        apply(part, at, upto)
        pointer.stage(upto)
        at = upto
    if target == 0:
        pointer.stage(0)
    if gate is not None and not gate():
        raise RuntimeError("the gate rejected the replay")
    pointer.promote()
    return target


def tail(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """The log's files as a stream; ``files_per_batch`` bounds a batch."""
    r = spark.readStream.schema(schema)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.parquet(path)


class Part(int):
    """The number of a batch; its text tells the part of it, so that each part can have a place of its own."""

    part = ""

    def __new__(cls, n: int, part: str = ""):
        out = super().__new__(cls, n)
        out.part = part
        return out

    def __str__(self) -> str:
        return f"{int(self)}{self.part}"

    def __format__(self, spec: str) -> str:
        return format(str(self), spec)


def _apply_or_halve(batch: DataFrame, label: Part, apply: Callable, skip: Callable[[DataFrame, Part, str], None]) -> None:
    """Apply a batch; where that fails, its halves by position, down to the events that fail alone, which are skipped."""
    try:
        apply(batch, label)
        return
    except Exception as x:  # noqa: BLE001
        error = f"{type(x).__name__}: {x}"
    low, high, middle = batch.agg(F.min("position"), F.max("position"), F.percentile_approx("position", 0.5)).first()
    if low == high:
        log_.warning("projection skipped the event at position %s: %s", low, error)
        skip(batch, label, error)
        return
    middle = min(middle, high - 1)
    for name, half in (("a", F.col("position") <= middle), ("b", F.col("position") > middle)):
        _apply_or_halve(batch.filter(half), Part(label, label.part + name), apply, skip)


def live(
    stream: DataFrame, pointer: Pointer, apply: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None,
    skipped: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Feed a projection from a stream, from the pointer's position on; the position is saved after each batch.

    An event that fails is logged, given to ``skipped`` (with ``error``) and passed, and all others are applied: a batch that
    fails is applied by halves until the events that fail stand alone. A batch may come twice after a failure, so ``apply`` gets
    the batch's number to be idempotent by, of which the text differs for each part of a batch (see ``Part``)."""
    start = pointer.position() or 0

    def each(batch: DataFrame, n: int) -> None:
        batch = batch.persist()
        try:
            top = batch.agg(F.max("position")).first()[0]
            if top is None:
                return
            skip = lambda rows, label, error: skipped(rows.withColumn("error", F.lit(error[:1000])), label) if skipped is not None else None
            _apply_or_halve(batch, Part(n), apply, skip)
            pointer.save(max(top, pointer.position() or 0))
        finally:
            batch.unpersist()

    w = stream.filter(F.col("position") > start).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()


def sink(path: str) -> Callable[[DataFrame, int], None]:
    """An idempotent file sink for ``foreachBatch``: a repeated batch overwrites its own folder."""

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return write


class PollTail:
    """A tail source that looks for new files of the log every so often."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, interval_s: float = 1.0, files_per_batch: int | None = None):
        self.spark, self.path, self.schema, self.interval_s, self.files = spark, path, schema, interval_s, files_per_batch

    def stream(self) -> DataFrame:
        return tail(self.spark, self.path, self.schema, self.files)

    def trigger(self) -> dict:
        return {"processingTime": f"{int(self.interval_s * 1000)} milliseconds"}


class CatchUpTail(PollTail):
    """A tail source that takes what is there now and ends."""

    def trigger(self) -> dict:
        return {"availableNow": True}


class NotifyTail(CatchUpTail):
    """A tail source driven by notifications: a stream of positions (``position``), each fetched from the stored log.

    Notifications say only that something came; the log says what. Positions that the log does not hold give nothing, and
    repeated ones come once within a batch.
    """

    def __init__(self, notifications: DataFrame, log: DataFrame):
        self.notifications, self.log = notifications, log

    def stream(self) -> DataFrame:
        return self.notifications.select("position").join(self.log, "position").select(*self.log.columns)


def fan_out(subscribers: dict[str, Callable[[DataFrame, int], None]], failed: Callable[[str, int, str], None] | None = None) -> Callable[[DataFrame, int], None]:
    """One batch to every subscriber, read once; a subscriber that fails is named to ``failed`` and does not stop the others."""

    def each(batch: DataFrame, n: int) -> None:
        batch = batch.persist()
        try:
            for name, take in subscribers.items():
                try:
                    take(batch, n)
                except Exception as x:  # noqa: BLE001
                    log_.exception("subscriber %s failed on batch %s", name, n)
                    if failed is not None:
                        failed(name, n, f"{type(x).__name__}: {x}")
        finally:
            batch.unpersist()

    return each


def synchronised(store, invalidate: Callable[[DataFrame, int], None] | None = None, order: str = "created_at") -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: a node takes over what other nodes wrote. Events are appended once by id (see
    ``StoredLog.append``), and the aggregates of the new ones (``aggregate_type, aggregate_id``) are given to ``invalidate``, so
    that cached states of them are read anew."""

    def each(batch: DataFrame, n: int) -> None:
        batch = batch.persist()
        try:
            fresh = batch.join(store.table().select("event_id"), "event_id", "left_anti")
            touched = written(fresh.select("aggregate_type", "aggregate_id").filter("aggregate_id is not null").distinct(), "touched")
            store.append(batch, order)
            if invalidate is not None:
                invalidate(touched, n)
        finally:
            batch.unpersist()

    return each


def batched(stream: DataFrame, key: str, order: str, n: int, age_ms: int, columns: list[str]) -> DataFrame:
    """Count-or-age batches over a stream: rows of a key wait until there are ``n`` of them or ``age_ms`` have passed since the
    first, and then come out together as ``key, batch_no, rows`` (an array of ``columns``, by ``order``). A waiting batch is at
    most ``n`` rows of state."""
    types = dict(stream.dtypes)
    row = ", ".join(f"{c}: {types[c]}" for c in columns)
    ddl = f"{key} {types[key]}, batch_no bigint, rows array<struct<{row}>>"
    state_ddl = f"batch_no bigint, rows array<struct<{row}>>"

    def run(k: tuple, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        number, held = state.get if state.exists else (0, [])
        held = [tuple(r) for r in held]
        out = []
        if not state.hasTimedOut:
            come = pd.concat(list(pdfs)).sort_values(order, kind="stable")
            held += list(come[columns].itertuples(index=False, name=None))
        while len(held) >= n or held and state.hasTimedOut:
            out.append((k[0], number, [dict(zip(columns, r)) for r in held[:n]]))
            number, held = number + 1, held[n:]
        state.update((number, held))
        if held:
            state.setTimeoutDuration(age_ms)
        if out:
            yield pd.DataFrame(out, columns=[key, "batch_no", "rows"])

    return stream.groupBy(key).applyInPandasWithState(run, ddl, state_ddl, "append", "ProcessingTimeTimeout")


def deduplicated(stream: DataFrame, key: str, time: str, horizon: str) -> DataFrame:
    """Several nodes' copies of one log as one: each key once within the horizon of late copies."""
    return stream.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", horizon).dropDuplicatesWithinWatermark([key]).drop("_at")


def subscription(log: DataFrame, stream: DataFrame, last: int, limit: int = 500) -> tuple[DataFrame, DataFrame]:
    """(missed events after ``last``, one page; the live events after those), so that none comes twice. Where more than a page
    were missed, the stream goes on right behind the page: it must reach back that far."""
    missed = log.filter(F.col("position") > last).orderBy("position").limit(limit)
    high = missed.agg(F.coalesce(F.max("position"), F.lit(last))).first()[0]
    return missed, stream.filter(F.col("position") > high)


def filtered(stream: DataFrame, correlation_id: str | None = None, search: str | None = None) -> DataFrame:
    """A live feed of one correlation, or of events that contain a text."""
    from loomlog.sources.log import matches

    q = stream if correlation_id is None else stream.filter(F.col("correlation_id") == correlation_id)
    return q.filter(matches(search, "event_type", "payload", "correlation_id")) if search else q


def stateful_fold(stream: DataFrame, key: list[str], order: str, apply: Callable[[dict, dict], dict], default: dict, schema: str) -> DataFrame:
    """A fold kept across micro-batches: after each batch the new state of every aggregate it touched.

    Inside a batch events are taken by ``order``; a state is a row of ``schema`` (the fields of ``default``).
    """
    types = dict(stream.dtypes)
    names = list(default)
    ddl = ", ".join([*(f"{k} {types[k]}" for k in key), schema])

    def run(k: tuple, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = dict(zip(names, state.get)) if state.exists else dict(default)
        rows = pd.concat(list(pdfs)).sort_values(order, kind="stable")
        for row in rows.to_dict("records"):
            now = apply(now, row)
        state.update(tuple(now[n] for n in names))
        yield pd.DataFrame([{**dict(zip(key, k)), **now}])

    return stream.groupBy(*key).applyInPandasWithState(run, ddl, schema, "update", "NoTimeout")


def run_to_table(spark: SparkSession, result: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Drive a stream over all that is there now and read what it wrote; ``batch`` numbers the micro-batches."""
    path = scratch_path(spark, name)
    q = result.writeStream.outputMode(mode).foreachBatch(sink(f"{path}/rows")).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{path}/rows")
