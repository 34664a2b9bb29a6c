"""Routing events to reactors, the gates before them, emission, settling, retries and dead letters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomlog.functions.ids import uuid5
from loomlog.operators import ordered
from loomlog.session import small, written

#: Hops after which an event is parked, attempts after which it is, defaults of queued work.
MAX_HOPS, MAX_EVENT_ATTEMPTS = 50, 3
DEFAULT_PRIORITY, DEFAULT_TIMEOUT_S, DEFAULT_CANCEL_TTL_S = 10, 900, 3600
#: Fixed value: the namespace of derived ids (the standard's namespace of domain names).
#: How ids begin that a declaration without one gets.
AUTO_ID = "auto_"
NAMESPACE = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"


@dataclass(frozen=True)
class Reactor:
    """``on``: event types ('prefix:variant'), prefixes ('prefix'), or none for every event."""

    id: str
    on: tuple[str, ...] = ()
    where: Column | None = None
    priority: int | None = None
    delay_s: int = 0
    timeout_s: int = DEFAULT_TIMEOUT_S
    max_attempts: int = 1
    background: bool = False


@dataclass
class Registry:
    reactors: list[Reactor] = field(default_factory=list)

    def add(self, r: Reactor) -> Registry:
        """Ids are unique and not blank, projections and reactors share them, and what runs in the background needs a stable
        one, not one made up at start."""
        if not r.id.strip():
            raise ValueError("a reactor needs an id")
        if r.background and r.id.startswith(AUTO_ID):
            raise ValueError(f"background reactor {r.id} needs an id of its own")
        if any(x.id == r.id for x in self.reactors):
            raise ValueError(f"reactor id {r.id} is registered twice")
        self.reactors.append(r)
        return self

    def table(self, spark: SparkSession) -> DataFrame:
        """One row per registration with its own priority, null where it has none."""
        return spark.createDataFrame([(r.id, r.priority, i) for i, r in enumerate(self.reactors)], "reactor string, priority int, registered int")

    def routes(self, spark: SparkSession) -> DataFrame:
        """One row per reactor and route; a reactor on everything has a null route."""
        rows = [(r.id, t, r.priority if r.priority is not None else DEFAULT_PRIORITY, r.delay_s, r.timeout_s, r.max_attempts, i) for i, r in enumerate(self.reactors) for t in (r.on or (None,))]
        ddl = "reactor string, route string, priority int, delay_s int, timeout_s int, max_attempts int, registered int"
        return spark.createDataFrame(rows, ddl)


def prefix(event_type: Column | str) -> Column:
    """The text before the first colon."""
    return F.substring_index(event_type, ":", 1)


def short_name(event_type: Column | str) -> Column:
    """The last segment of a path of names."""
    return F.substring_index(event_type, "::", -1)


def route(events: DataFrame, routes: DataFrame) -> DataFrame:
    """Events with each reactor that takes their type, by full type, by prefix, or any. One row per event and reactor.

    The registry becomes one row per event type that occurs, with all reactors that take it; it is broadcast when its counted
    size allows, so events don't move. Events of types that nobody takes, or without a type, give the rows of the reactors on
    everything.
    """
    columns = [c for c in routes.columns if c != "route"]
    types = events.select("event_type").distinct()
    keys = types.select("event_type", F.explode(F.array_distinct(F.array(F.coalesce("event_type", F.lit("")), F.coalesce(prefix("event_type"), F.lit("")), F.lit("*")))).alias("route"))
    takes = keys.join(small(routes.withColumn("route", F.coalesce("route", F.lit("*")))), "route").select("event_type", *columns).distinct()
    takes = takes.groupBy(F.col("event_type").alias("_type")).agg(F.collect_list(F.struct(*columns)).alias("_takes"))
    routed = events.join(small(written(takes, "routes")), F.col("event_type").eqNullSafe(F.col("_type")))
    return routed.select(*events.columns, F.explode("_takes").alias("_t")).select(*events.columns, "_t.*")


def fired(routed: DataFrame, registry: Registry) -> DataFrame:
    """Every routed row with ``fired``: does the reactor's own filter accept the event? A rejected event still has its
    execution."""
    ok = F.lit(True)
    for r in registry.reactors:
        if r.where is not None:
            ok = F.when(F.col("reactor") == r.id, F.coalesce(r.where, F.lit(False))).otherwise(ok)
    return routed.withColumn("fired", ok)


def hop_gate(events: DataFrame, hops: str = "hops", limit: int = MAX_HOPS) -> tuple[DataFrame, DataFrame]:
    """(events that go on, events to park): from ``limit`` hops on. Unknown hops count as none."""
    n = F.coalesce(hops, F.lit(0))
    return events.filter(n < limit), events.filter(n >= limit)


def attempt_gate(events: DataFrame, attempts: str = "attempts") -> tuple[DataFrame, DataFrame]:
    """(events to process, events to park): an event that keeps failing is parked after its attempts."""
    tries = F.coalesce(attempts, F.lit(0))
    return events.filter(tries <= MAX_EVENT_ATTEMPTS), events.filter(tries > MAX_EVENT_ATTEMPTS)


def ephemeral_gate(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events to route, events to fold, snapshot and project): ephemeral events are routed like any other, and no more."""
    return events, events.filter(F.coalesce("persistent", F.lit(True)))


def extract(events: DataFrame, value: Column, name: str, keep: list[str]) -> DataFrame:
    """Map and filter in one: ``value`` of each event under ``name``; events for which it is null are left out."""
    return events.select(*keep, value.alias(name)).filter(F.col(name).isNotNull())


def extract_fields(events: DataFrame, variants: dict[str, dict[str, tuple[str, str]]], keep: list[str]) -> DataFrame:
    """Payload fields of event variants as columns: event type to name to (JSON path, type). A variant's row has its own
    fields, those of others are null; types that are not named, and values that do not fit, give none."""
    columns: dict[str, list] = {}
    for kind, fields in variants.items():
        for name, (path, to) in fields.items():
            columns.setdefault(name, []).append(F.when(F.col("event_type") == kind, F.get_json_object("payload", path).try_cast(to)))
    return events.filter(F.col("event_type").isin(*variants)).select(*keep, "event_type", *(F.coalesce(*c).alias(n) for n, c in columns.items()))


def by_priority(rows: DataFrame, priority: str = "priority", registered: str = "registered") -> DataFrame:
    """Registrations in running order with ``nth``: lower priority first, those without one last, then as registered."""
    w = Window.orderBy(F.coalesce(priority, F.lit(2**31 - 1)), registered)  # a registry is a list of the driver
    return rows.withColumn("nth", F.row_number().over(w).cast("bigint"))


def first_of(events: DataFrame, group: str, order: str, types: list[str]) -> DataFrame:
    """Waiting for a terminal event: per group the first event of one of ``types``, and how many events came before it.
    Groups that have none yet give no row."""
    done = events.filter(F.col("event_type").isin(*types)).groupBy(group).agg(F.min(order).alias("_at"), F.min_by("event_type", order).alias("terminal_type"))
    seen = events.join(done, group).groupBy(group, "_at", "terminal_type").agg(F.count_if(F.col(order) < F.col("_at")).alias("events_before"))
    return seen.withColumnRenamed("_at", "terminal_position")


def _flushed(n: int, age_us: int):
    def run(batches):
        key, number, size, start, now = None, 0, 0, 0, 0
        for b in batches:
            out = []
            for k, us in zip(b.column("_key").to_pylist(), b.column("_us").to_pylist()):
                us = now if us is None and k == key else us or 0 if k != key else max(us, now)
                now = us
                if k != key:
                    key, number, size, start = k, 0, 0, us
                elif size >= n or us - start >= age_us:
                    number, size, start = number + 1, 0, us
                size += 1
                out.append(number)
            columns = [c for c in b.schema.names if not c.startswith("_")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(out, pa.int64())], names=[*columns, "batch_no"])

    return run


def batches(rows: DataFrame, key: str, order: str, time: str, n: int, age_s: float) -> DataFrame:
    """Count-or-age batches of each key: ``rows`` with ``batch_no`` (from 0). A batch is flushed when it holds ``n`` rows or
    ``age_s`` seconds have passed since its first one, so the next row opens another. Rows are taken by ``order``; a row
    without a time belongs to the batch that is open.

    Where a batch ends decides where the next begins, so one key is one sequence: it streams through one task, which holds no
    more than an Arrow batch.
    """
    us = F.unix_micros(F.col(time).cast("timestamp"))
    held = rows.select("*", F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_key"), us.alias("_us"))
    ddl = ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes), "batch_no bigint"])
    return held.repartition(key).sortWithinPartitions("_key", order).mapInArrow(_flushed(n, int(age_s * 1e6)), ddl)


def cancelled(rows: DataFrame, cancellations: DataFrame, now: Column, ttl_s: int = DEFAULT_CANCEL_TTL_S) -> DataFrame:
    """The cancellations in force: not older than their time to live."""
    live = cancellations.filter(F.col("cancelled_at") >= now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(ttl_s)))
    return rows.join(live.select("correlation_id").distinct(), "correlation_id", "left_semi")


def not_cancelled(rows: DataFrame, cancellations: DataFrame, now: Column, ttl_s: int = DEFAULT_CANCEL_TTL_S) -> DataFrame:
    live = cancellations.filter(F.col("cancelled_at") >= now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(ttl_s)))
    return rows.join(live.select("correlation_id").distinct(), "correlation_id", "left_anti")


def intents(routed: DataFrame, hops: Column | None = None) -> DataFrame:
    """Queue rows of routed events: when to run, and with what limits."""
    return routed.select(
        "event_id", F.col("reactor").alias("reactor_id"), "correlation_id", "priority", "max_attempts", F.greatest("timeout_s", F.lit(1)).alias("timeout_s"),
        (F.col("created_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("delay_s"))).alias("execute_at"),
        (hops if hops is not None else F.lit(0)).alias("hops"), "position", "registered",
    )


def dequeue_order(queue: DataFrame, now: Column) -> DataFrame:
    """The eligible rows by priority, first in first out. ``nth`` numbers them per correlation, where order matters; a
    global order is the caller's ``orderBy``."""
    return ordered.numbered(queue.filter(F.col("execute_at") <= now), ["correlation_id"], ["priority", "position", "registered"], "nth")


def idempotency_key(event_id: Column | str, reactor_id: Column | str) -> Column:
    e = F.col(event_id) if isinstance(event_id, str) else event_id
    return uuid5(NAMESPACE, F.concat_ws("-", e.cast("string"), reactor_id))


def emit(parents: DataFrame, children: Column) -> DataFrame:
    """Child events of executed rows: ``children`` is an array of (event_type, payload) structs, empty for none.

    Ids are derived from parent, reactor and index, so a repeated run emits the same ids.
    """
    out = parents.select("event_id", "reactor_id", "correlation_id", "hops", F.posexplode(children).alias("i", "c"))
    name = F.concat_ws("-", F.col("event_id").cast("string"), "reactor_id", "c.event_type", F.col("i").cast("string"))
    return out.select(
        uuid5(NAMESPACE, name).alias("event_id"), F.col("event_id").cast("string").alias("parent_id"), "correlation_id", "c.event_type", "c.payload",
        F.create_map(F.lit("_hops"), (F.col("hops") + 1).cast("string"), F.lit("_reactor_id"), F.col("reactor_id"), F.lit("reactor_id"), F.col("reactor_id")).alias("metadata"),
        F.col("reactor_id"), (F.col("hops") + 1).alias("hops"),
    )


def stamp(events: DataFrame, extra: dict[str, str]) -> DataFrame:
    """Events with the engine's metadata added; the events' own entries win."""
    base = F.create_map(*(F.lit(x) for kv in extra.items() for x in kv)) if extra else F.create_map().cast("map<string,string>")
    own = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    return events.withColumn("metadata", F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(own, k)), own))


def settle(seed: DataFrame, react: Callable[[DataFrame], DataFrame], max_hops: int = MAX_HOPS, late: Callable[[], bool] | None = None) -> tuple[DataFrame, DataFrame]:
    """Run generations until no event is left: (all events, parked events).

    ``react`` maps a generation (``event_id`` string, ``parent_id``, ``correlation_id``, ``event_type``, ``payload``,
    ``hops``) to its children. Each generation is written to the shared folder, so the lineage stays one step long; events
    at the hop limit are kept but react no more. Children whose id is known already are dropped. ``late`` is asked after each
    generation; once it says yes the run ends with a ``TimeoutError``.
    """
    columns = ["event_id", "parent_id", "correlation_id", "event_type", "payload", "hops"]
    done = now = written(seed.select(*columns), "generation")
    parked = now.limit(0)
    for _ in range(max_hops + 1):
        go, stop = hop_gate(now)
        parked = parked.unionByName(stop)
        children = react(go).select(*columns).dropDuplicates(["event_id"]).join(done.select("event_id"), "event_id", "left_anti")
        now = written(children.select(*columns), "generation")
        if now.limit(1).count() == 0:
            break
        done = done.unionByName(now)
        if late is not None and late():
            raise TimeoutError("the emission has not settled in time")
    return done, parked


def backoff_multiplier(attempt: Column) -> Column:
    """1, 1, 2, 4, 8, ... for attempts 0, 1, 2, 3, 4."""
    return F.pow(F.lit(2), F.greatest(attempt, F.lit(1)) - 1).cast("bigint")


def retry_schedule(executions: DataFrame, max_attempts: int, base_s: int) -> DataFrame:
    """The runs of executions that always fail: ``max_attempts`` retries after the first run, with exponential backoff."""
    rows = executions.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(max_attempts))))
    gap = F.when(F.col("attempt") == 0, F.lit(0)).otherwise(F.lit(base_s) * backoff_multiplier(F.col("attempt") - 1))
    # the sum of the gaps before an attempt, in closed form: base * (1 + (1 + 2 + ... + 2^(a-2)))
    total = F.when(F.col("attempt") == 0, F.lit(0)).otherwise(F.lit(base_s) * F.pow(F.lit(2), F.col("attempt") - 1)).cast("bigint")
    return rows.select(
        "event_id", "reactor_id", F.col("attempt").cast("int").alias("attempt"), gap.cast("bigint").alias("wait_s"), total.alias("offset_s"),
        (F.col("started_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), total)).alias("run_at"), (F.col("attempt") == max_attempts).alias("dead_after"),
    )


def timed_out(executions: DataFrame, timeout_s: int, now: Column) -> DataFrame:
    """Executions that ran, or have been running, longer than their timeout (at least one second)."""
    limit = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(max(1, timeout_s)))
    return executions.filter(F.coalesce("completed_at", now) - F.col("started_at") > limit)


def dead_letters(executions: DataFrame, handlers: dict[str, str], on_dlq: str) -> DataFrame:
    """The terminal event of each failed execution: the reactor's own failure event, else the global one."""
    own = F.create_map(*(F.lit(x) for kv in handlers.items() for x in kv)) if handlers else None
    kind = F.coalesce(F.try_element_at(own, F.col("reactor_id")), F.lit(on_dlq)) if own is not None else F.lit(on_dlq)
    name = F.concat_ws("-", F.col("event_id").cast("string"), "reactor_id", F.lit("dlq"))
    return executions.filter("status = 'error'").select(
        uuid5(NAMESPACE, name).alias("event_id"), F.col("event_id").alias("parent_id"), "correlation_id", kind.alias("event_type"), "reactor_id", "error",
        (F.col("attempts") + 1).alias("attempts"), F.when(F.col("error").contains("timeout"), "timeout").otherwise("failed").alias("reason"),
    )


def requeue(dlq: DataFrame, now: Column) -> DataFrame:
    """Dead letters as pending work again, with attempts reset."""
    return dlq.select("parent_id", "reactor_id", "correlation_id", F.lit(0).alias("attempts"), now.alias("execute_at"), F.lit("pending").alias("status"))


def last_status(transitions: DataFrame, key: list[str], order: str, columns: list[str]) -> DataFrame:
    """The current row of each key of an append-only table of transitions."""
    return transitions.groupBy(*key).agg(F.max(F.struct(order, *columns)).alias("t")).select(*key, "t.*")


def complete_batches(rows: DataFrame, batch: list[str], index: str, size: str, columns: list[str]) -> DataFrame:
    """Same-batch fan-in: batches of which every index has arrived, with their rows in order. A batch is what one execution
    emitted at once and says how many that are, so its list has a known length; it is the answer's own form."""
    got = rows.groupBy(*batch).agg(
        F.count_distinct(index).alias("_got"), F.max(size).alias("_size"), F.array_sort(F.collect_list(F.struct(index, *columns))).alias("rows")
    )
    return got.filter("_got = _size").drop("_got").withColumnRenamed("_size", "batch_size")


def gate(events: DataFrame, group: str, order: str, of: Column, required: list[str]) -> DataFrame:
    """Where each group first has all required values: the position of its last first occurrence."""
    firsts = events.filter(of.isin(required)).groupBy(group, of.alias("_v")).agg(F.min(order).alias("_at"))
    got = firsts.groupBy(group).agg(F.count("*").alias("_n"), F.max("_at").alias("opened_at"))
    return got.filter(F.col("_n") == len(set(required))).select(group, "opened_at")


def demultiplex(requests: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Each request with its batch result; a key the batch did not answer is an error."""
    answered = results.withColumn("_ok", F.lit(True))
    return requests.join(answered, key, "left").withColumn("error", F.when(F.col("_ok").isNull(), F.concat(F.lit("missing result for "), F.col(key).cast("string")))).drop("_ok")


def batched(rows: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """Run a batch function on Arrow batches (pandas in, pandas out); an error of the function marks its whole batch."""
    import pandas as pd

    def run(pdfs):
        for pdf in pdfs:
            try:
                yield fn(pdf).assign(error=None)
            except Exception as e:  # noqa: BLE001
                yield pd.DataFrame({pdf.columns[0]: pdf.iloc[:, 0], "error": str(e)})

    columns = [c.strip().split()[0] for c in schema.split(",")]
    return rows.mapInPandas(lambda it: (p.reindex(columns=[*columns, "error"]) for p in run(it)), f"{schema}, error string")
