"""The inspector's read model: analytic queries over the log, the executions, their logs, descriptions and states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.operators import graph
from loomlog.sources import log as L
from loomlog.sources.log import matches


def display(log: DataFrame) -> DataFrame:
    """Events as shown: the payload's ``type`` or the event type as name, a compact summary, the raw payload."""
    name = F.coalesce(F.get_json_object("payload", "$.type"), F.col("event_type"))
    return log.select("position", "created_at", "event_type", name.alias("name"), "event_id", "parent_id", "correlation_id", "reactor_id", compact_payload("payload", 200).alias("summary"), "payload")


def compact_payload(payload: str, limit: int) -> Column:
    """``{ key: value, ... }`` of a JSON object without ``type``, in its key order; strings of more than 60 characters are cut
    to 57, as they read and not as they are escaped, and pairs that would pass ``limit`` characters give way to ``...``. Other
    payloads are cut to ``limit``."""

    def shown_value(v: Column) -> Column:
        text, raw = F.coalesce(F.to_json(v), F.lit("null")), v.try_cast("string")
        cut = F.when(F.length(raw) > 60, F.concat(F.substring(raw, 1, 57), F.lit("..."))).otherwise(raw)
        return F.when(text.startswith('"'), F.concat(F.lit('"'), cut, F.lit('"'))).otherwise(text)

    fields = F.map_filter(F.from_json(payload, "map<string,variant>"), lambda k, v: k != "type")
    parts = F.transform(F.map_entries(fields), lambda e: F.concat(e["key"], F.lit(": "), shown_value(e["value"])))
    start = F.struct(F.lit(2).alias("n"), F.lit(False).alias("full"), F.array().cast("array<string>").alias("kept"))

    def add(s: Column, p: Column) -> Column:
        over = s["n"] + F.length(p) + 2 > limit
        kept = F.concat(s["kept"], F.array(F.when(over, F.lit("...")).otherwise(p)))
        nxt = F.struct((s["n"] + F.length(p) + 2).alias("n"), over.alias("full"), kept.alias("kept"))
        return F.when(s["full"], s).otherwise(nxt)

    shown = F.concat(F.lit("{ "), F.array_join(F.aggregate(parts, start, add)["kept"], ", "), F.lit(" }"))
    return F.when(fields.isNull(), F.substring(payload, 1, limit)).when(F.size(parts) == 0, F.lit("{}")).otherwise(shown)


def list_correlations(log: DataFrame, executions: DataFrame, search: str | None = None, limit: int | None = None) -> DataFrame:
    """Per correlation: events, first and last time, root type (of the first parentless event, '' if none), errors.

    Sorted by last time, newest first (ties: by id), when a limit is given.
    """
    root = F.when(F.col("parent_id").isNull(), F.col("position"))
    c = log.filter("correlation_id is not null").groupBy("correlation_id").agg(
        F.count("*").alias("event_count"), F.min("created_at").alias("first_ts"), F.max("created_at").alias("last_ts"),
        F.coalesce(F.min_by("event_type", root), F.lit("")).alias("root_event_type"),
    )
    failed = executions.filter("status = 'error'").select("correlation_id", F.lit(True).alias("has_errors")).distinct()
    c = c.join(failed, "correlation_id", "left").withColumn("has_errors", F.coalesce("has_errors", F.lit(False)))
    if search:
        c = c.filter(matches(search, "correlation_id", "root_event_type"))
    return c.orderBy(F.desc("last_ts"), "correlation_id").limit(limit) if limit else c


def reactor_outcomes(executions: DataFrame, correlation_id: str | None = None) -> DataFrame:
    """Per correlation and reactor: the worst status, distinct errors, attempts, start, end (of completed runs), and the number
    of events; which ones is in ``outcome_events``, row by row, since a reactor may have taken any number. Of one given
    correlation, as a page shows it, the events are listed too."""
    if correlation_id is not None:
        one = executions.filter(F.col("correlation_id") == correlation_id)
        ids = one.groupBy("reactor_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("event_id")), lambda x: x.cast("string")), ",").alias("event_ids"))
        return reactor_outcomes(one).join(ids, "reactor_id")
    is_ = lambda s: F.bool_or(F.col("status") == s)
    status = F.when(is_("error"), "error").when(is_("running"), "running").when(is_("pending"), "pending").when(is_("completed"), "completed").otherwise("unknown")
    return executions.groupBy("correlation_id", "reactor_id").agg(
        status.alias("status"), F.array_join(F.array_sort(F.collect_set("error")), "; ").alias("errors"), F.sum("attempts").alias("attempts"),
        F.min("started_at").alias("started_at"), F.max(F.when(F.col("status") == "completed", F.col("completed_at"))).alias("completed_at"),
        F.count_distinct("event_id").alias("n_events"),
    )


def outcome_events(executions: DataFrame) -> DataFrame:
    """The events behind each outcome, once each."""
    return executions.select("correlation_id", "reactor_id", "event_id").distinct()


def reactor_dependencies(log: DataFrame, executions: DataFrame) -> DataFrame:
    """Per reactor the sorted event types it takes and those it emits; either may be missing."""
    types = log.select("event_id", "event_type")
    # one row per reactor and type before the sets are collected
    takes = executions.select("event_id", "reactor_id").join(types, "event_id").select("reactor_id", "event_type").distinct()
    emits = log.filter("reactor_id is not null").select("reactor_id", "event_type").distinct()
    into = takes.groupBy("reactor_id").agg(F.array_sort(F.collect_set("event_type")).alias("input_event_types"))
    out = emits.groupBy("reactor_id").agg(F.array_sort(F.collect_set("event_type")).alias("output_event_types"))
    none = F.array().cast("array<string>")
    return into.join(out, "reactor_id", "full_outer").select("reactor_id", F.coalesce("input_event_types", none).alias("input_event_types"), F.coalesce("output_event_types", none).alias("output_event_types"))


def logs_of(logs: DataFrame, event_id=None, reactor_id: str | None = None, levels: list[str] | None = None, text: str | None = None) -> DataFrame:
    """Log rows by event, reactor, levels (lower case) and a text in message or reactor."""
    q = logs.withColumn("level", F.lower("level"))
    if event_id is not None:
        q = q.filter(F.col("event_id") == event_id)
    if reactor_id is not None:
        q = q.filter(F.col("reactor_id") == reactor_id)
    if levels:
        q = q.filter(F.col("level").isin([x.lower() for x in levels]))
    return q.filter(matches(text, "message", "reactor_id")) if text else q


def logs_of_correlation(logs: DataFrame, log: DataFrame, correlation_id: str) -> DataFrame:
    """The log rows of a correlation's events."""
    ids = log.filter(F.col("correlation_id") == correlation_id).select("event_id")
    return logs.join(ids, "event_id", "left_semi")


def latest_descriptions(descriptions: DataFrame) -> DataFrame:
    """Per correlation and reactor the newest description."""
    return descriptions.groupBy("correlation_id", "reactor_id").agg(F.max_by("description", "position").alias("description"))


def state_timeline(states: DataFrame, log: DataFrame) -> DataFrame:
    """State snapshots in log order with their event's type ('' where the event is unknown)."""
    types = log.select("event_id", "event_type")
    return states.join(types, "event_id", "left").withColumn("event_type", F.coalesce("event_type", F.lit("")))


def lifecycle(states: DataFrame, log: DataFrame, aggregate_key: str, limit: int = 100) -> DataFrame:
    """One aggregate's states with type and time of their events, oldest first."""
    at = log.select("event_id", "event_type", "created_at")
    return states.filter(F.col("aggregate_key") == aggregate_key).join(at, "event_id").orderBy("position").limit(min(limit, 500))


def aggregate_key(kind: Column | str, of: Column | str) -> Column:
    return F.concat(F.col(kind) if isinstance(kind, str) else kind, F.lit(":"), (F.col(of) if isinstance(of, str) else of).cast("string"))


def waterfall(executions: DataFrame, now: Column) -> DataFrame:
    """Bars of a correlation's executions against its extent; an open end is now."""
    bars = executions.filter("started_at is not null").withColumn("end_at", F.coalesce("completed_at", now))
    extent = bars.groupBy("correlation_id").agg(F.min("started_at").alias("t0"), F.max("end_at").alias("t1"))
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return bars.join(extent, "correlation_id").select(
        "correlation_id", "event_id", "reactor_id", "status", (us("started_at") - us("t0")).alias("offset_us"), (us("end_at") - us("started_at")).alias("width_us"), (us("t1") - us("t0")).alias("extent_us")
    )


def observability_stream(log: DataFrame, executions: DataFrame) -> DataFrame:
    """One stream of what happened: events dispatched, effects started, effects ended."""
    dispatched = log.select(F.lit("event_dispatched").alias("stream_type"), "correlation_id", "event_id", F.lit(None).cast("string").alias("reactor_id"), F.col("created_at").alias("at"))
    started = executions.filter("started_at is not null").select(F.lit("effect_started").alias("stream_type"), "correlation_id", "event_id", "reactor_id", F.col("started_at").alias("at"))
    ended = executions.filter("status in ('completed', 'error')").select(
        F.when(F.col("status") == "error", "effect_failed").otherwise("effect_completed").alias("stream_type"), "correlation_id", "event_id", "reactor_id", F.col("completed_at").alias("at")
    )
    return dispatched.unionByName(started).unionByName(ended)


def flow_selection(log: DataFrame, event_type: str | None = None, reactor_id: str | None = None) -> DataFrame:
    """The events of a selected node of the flow graph."""
    q = log if event_type is None else log.filter(F.col("event_type") == event_type)
    return q if reactor_id is None else q.filter(F.col("reactor_id") == reactor_id)


def describe_all(states: DataFrame, described: dict[str, Column], keep: list[str]) -> DataFrame:
    """Every described reactor evaluated against the state at each event, whichever reactor ran: one row per event and
    reactor. A null description says nothing and gives no row."""
    each = F.array(*(F.struct(F.lit(r).alias("reactor_id"), c.cast("string").alias("description")) for r, c in described.items()))
    return states.select(*keep, F.explode(each).alias("_x")).select(*keep, "_x.*").filter("description is not null")


def capture_states(states: DataFrame, fields: list[str], kind: str = "aggregate_type", of: str = "aggregate_id") -> DataFrame:
    """The state that each event left its aggregate in, as JSON under the aggregate's key."""
    return states.select("position", "event_id", "correlation_id", aggregate_key(kind, of).alias("aggregate_key"), F.to_json(F.struct(*fields)).alias("state"))


class ReadModel:
    """The inspector's questions over one set of tables (see ``sources.spi.InspectorReadModel``)."""

    def __init__(self, log: DataFrame, executions: DataFrame, logs: DataFrame, descriptions: DataFrame, states: DataFrame):
        self.log, self.executions, self.logs, self.described, self.states = log, executions, logs, descriptions, states

    def list_events(self, limit: int, **filters) -> DataFrame:
        return L.list_events(self.log, limit, **filters)

    def get_event(self, position: int) -> DataFrame:
        return L.get_event(self.log, position)

    def lineage_tree(self, position: int) -> DataFrame:
        return graph.lineage_tree(self.log, position)

    def lineage_flow(self, correlation_id: str) -> DataFrame:
        return graph.lineage_flow(self.log, correlation_id)

    def events_from(self, start: int, limit: int) -> DataFrame:
        return L.events_from(self.log, start, limit)

    def reactor_logs(self, event_id, reactor_id: str) -> DataFrame:
        return logs_of(self.logs, event_id, reactor_id)

    def reactor_logs_by_correlation(self, correlation_id: str) -> DataFrame:
        return logs_of_correlation(self.logs, self.log, correlation_id)

    def reactor_outcomes(self, correlation_id: str) -> DataFrame:
        return reactor_outcomes(self.executions, correlation_id)

    def reactor_descriptions(self, correlation_id: str) -> DataFrame:
        return latest_descriptions(self.described.filter(F.col("correlation_id") == correlation_id))

    def reactor_description_snapshots(self, correlation_id: str) -> DataFrame:
        return self.described.filter(F.col("correlation_id") == correlation_id)

    def aggregate_state_timeline(self, correlation_id: str) -> DataFrame:
        return state_timeline(self.states.filter(F.col("correlation_id") == correlation_id), self.log)

    def list_correlations(self, search: str | None, limit: int) -> DataFrame:
        return list_correlations(self.log, self.executions, search, limit)

    def reactor_dependencies(self) -> DataFrame:
        return reactor_dependencies(self.log, self.executions)

    def aggregate_lifecycle(self, key: str, limit: int = 100) -> DataFrame:
        return lifecycle(self.states, self.log, key, limit)

    def list_aggregate_keys(self) -> DataFrame:
        return self.states.select("aggregate_key").distinct()
