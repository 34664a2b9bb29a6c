"""Streaming queries: each drives a stream over the whole log and returns what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlog.plans.reference import FLOW, query
from loomlog.plans.reference_sql import _HALF, _LAST_STATE, _STATES, _q, ORACLES
from loomlog.session import scratch_path
from loomlog.sources.fixtures import events_log
from loomlog.sources.store import StoredLog
from loomlog.streaming import projections
from loomlog.streaming.pointer import Pointer


def _tail(s, d):
    log = events_log(s, d)
    return projections.tail(s, log.loomlog_path, log.schema, 2)


def _apply(state: dict, e: dict) -> dict:
    return {
        "n_events": state["n_events"] + 1, "n_errors": state["n_errors"] + (e["event_type"] == "activity:error"), "upto": max(state["upto"], e["position"]),
    }


@query
def stream_fold(s, d):
    """The user fold kept across micro-batches; the last state of each user equals the batch fold."""
    events = _tail(s, d).filter("persistent").select("aggregate_id", "position", "event_type")
    start = {"n_events": 0, "n_errors": 0, "upto": 0}
    states = projections.stateful_fold(events, ["aggregate_id"], "position", _apply, start, "n_events bigint, n_errors bigint, upto bigint")
    out = projections.run_to_table(s, states, "stream_fold", "update")
    return out.groupBy("aggregate_id").agg(F.max_by("n_events", "batch").alias("n_events"), F.max_by("n_errors", "batch").alias("n_errors"))


@query
def stream_counts(s, d):
    """A live projection: events per type, added up over batches, with the pointer at the log's end."""
    path = scratch_path(s, "stream_counts")
    pointer = Pointer(s, f"{path}/pointer")
    each = projections.sink(f"{path}/rows")
    q = projections.live(_tail(s, d), pointer, lambda b, n: each(b.groupBy("event_type").agg(F.count("*").alias("n")), n), f"{path}/checkpoint")
    q.awaitTermination()
    counts = s.read.parquet(f"{path}/rows").groupBy("event_type").agg(F.sum("n").alias("n"))
    return counts.withColumn("upto", F.lit(pointer.position()).cast("bigint"))


@query
def stream_deduplicated(s, d):
    """Two nodes' copies of the log as one stream."""
    stream = _tail(s, d).select("event_id", "event_type", "created_at")
    once = projections.deduplicated(stream.union(stream), "event_id", "created_at", "60 days")
    return projections.run_to_table(s, once, "stream_dedup").groupBy("event_type").agg(F.count("*").alias("n"))


@query
def projection_replay(s, d):
    """A full replay in steps, gated and promoted."""
    log = events_log(s, d)
    path = scratch_path(s, "replay")
    pointer = Pointer(s, f"{path}/pointer")
    top = log.agg(F.max("position")).first()[0]

    def apply(events, after, upto):
        events.groupBy("event_type").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/rows/step={upto}")

    projections.replay(log, pointer, apply, gate=lambda: pointer.status()["staged"] == top, interval=max(1, top // 4))
    counts = s.read.parquet(f"{path}/rows").groupBy("event_type").agg(F.sum("n").alias("n"))
    return counts.withColumn("upto", F.lit(pointer.position()).cast("bigint"))


@query
def live_feed_filtered(s, d):
    """The live feed of events that contain a text."""
    events = projections.filtered(_tail(s, d), search="PURCH").select("position", "event_type", "correlation_id")
    return projections.run_to_table(s, events, "feed").select("position", "event_type", "correlation_id")


@query
def live_feed_of_correlation(s, d):
    events = projections.filtered(_tail(s, d), correlation_id=FLOW).select("position", "event_type")
    return projections.run_to_table(s, events, "feed").select("position", "event_type")


@query
def subscription_catch_up(s, d):
    """A subscriber that saw the first half of the log: what it missed, then the live events behind that, each once."""
    log = events_log(s, d)
    last = log.agg(F.coalesce(F.max("position"), F.lit(0))).first()[0] // 2
    missed, then = projections.subscription(log, _tail(s, d), last)
    after = projections.run_to_table(s, then.select("position", "event_type"), "subscription")
    return missed.select("position", "event_type").unionByName(after.select("position", "event_type"))


@query
def notified_events(s, d):
    """Notifications name the positions of errors; each is fetched from the log and fanned out to two subscribers, one of
    which fails."""
    log = events_log(s, d)
    at = scratch_path(s, "notified")
    log.filter("event_type = 'activity:error'").select("position").write.parquet(f"{at}/notes")
    source = projections.NotifyTail(projections.tail(s, f"{at}/notes", log.select("position").schema), log)

    def broken(batch, n):
        raise RuntimeError("gone")

    each = projections.fan_out({"broken": broken, "table": projections.sink(f"{at}/rows")})
    q = source.stream().writeStream.foreachBatch(each).option("checkpointLocation", f"{at}/checkpoint").trigger(**source.trigger()).start()
    q.awaitTermination()
    return s.read.schema(log.schema).parquet(f"{at}/rows").select("position", "event_id", "event_type")


@query
def synchronised_nodes(s, d):
    """Two nodes' copies of the log become one stored log; what each batch added is named for invalidation."""
    log = events_log(s, d)
    at = scratch_path(s, "nodes")
    store, touched = StoredLog(s, f"{at}/log"), projections.sink(f"{at}/touched")
    text = {c: F.col(c).cast("string") for c in ("event_id", "parent_id", "aggregate_id")}
    stream = log.withColumns(text)
    stream.select(*filled_columns()).write.parquet(f"{at}/a")
    stream.select(*filled_columns()).write.parquet(f"{at}/b")
    nodes = projections.tail(s, f"{at}/[ab]", s.read.parquet(f"{at}/a").schema)
    each = projections.synchronised(store, lambda t, n: touched(t, n), "event_id")
    q = nodes.writeStream.foreachBatch(each).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    changed = s.read.schema("aggregate_type string, aggregate_id string").parquet(f"{at}/touched").distinct().count()
    return store.table().groupBy("event_type").agg(F.count("*").alias("n")).withColumn("n_invalidated", F.lit(changed).cast("bigint"))


def filled_columns() -> list:
    """The stored schema from a log that lacks metadata; positions and versions are given anew."""
    return [
        F.lit(None).cast("bigint").alias("position"), "event_id", "parent_id", "correlation_id", "event_type", "payload", "created_at", "aggregate_type", "aggregate_id",
        F.create_map().cast("map<string,string>").alias("metadata"), "persistent", F.lit(None).cast("bigint").alias("version"), F.to_date("created_at").alias("day"),
    ]


@query
def live_skips(s, d):
    """A live projection that fails on two events: they are recorded, all others are applied."""
    path = scratch_path(s, "live_skips")
    pointer, out, lost = Pointer(s, f"{path}/pointer"), projections.sink(f"{path}/rows"), projections.sink(f"{path}/lost")
    k = F.get_json_object("payload", "$.k").cast("bigint")
    bad = F.col("position").isin(5, 700)

    def apply(batch, n):
        checked = F.when(bad, F.raise_error(F.lit("unfit"))).otherwise(k)
        out(batch.select("event_type", checked.cast("bigint").alias("k")), n)

    q = projections.live(_tail(s, d), pointer, apply, f"{path}/checkpoint", skipped=lost)
    q.awaitTermination()
    done = s.read.schema("event_type string, k bigint").parquet(f"{path}/rows").select("event_type", F.lit("applied").alias("outcome"), "k")
    gone = s.read.schema("event_type string, payload string").parquet(f"{path}/lost").select("event_type", F.lit("skipped").alias("outcome"), k.alias("k"))
    return done.unionByName(gone).groupBy("event_type", "outcome").agg(F.count("*").alias("n"), F.sum("k").alias("total"))


_COUNTS = _q("SELECT event_type, count(*) AS n, (SELECT max(position) FROM log) AS upto FROM log GROUP BY 1")
ORACLES |= {
    "stream_fold": _q(_LAST_STATE.format(cols="aggregate_id, n_events, n_errors"), _STATES),
    "stream_counts": _COUNTS,
    "projection_replay": _COUNTS,
    "stream_deduplicated": _q("SELECT event_type, count(*) AS n FROM log GROUP BY 1"),
    "live_feed_filtered": _q("SELECT position, event_type, correlation_id FROM log WHERE contains(lower(event_type), 'purch') OR contains(lower(payload), 'purch') OR contains(correlation_id, 'purch')"),
    "live_feed_of_correlation": _q(f"SELECT position, event_type FROM log WHERE correlation_id = '{FLOW}'"),
    "subscription_catch_up": _q(f"SELECT position, event_type FROM log WHERE position > {_HALF}"),
    "notified_events": _q("SELECT position, event_id, event_type FROM log WHERE event_type = 'activity:error'"),
    "synchronised_nodes": _q("SELECT event_type, count(*) AS n, (SELECT count(DISTINCT aggregate_id) FROM log) AS n_invalidated FROM log GROUP BY 1"),
    "live_skips": _q("""SELECT event_type, CASE WHEN position IN (5, 700) THEN 'skipped' ELSE 'applied' END AS outcome, count(*) AS n, CAST(sum(CAST(payload->>'$.k' AS BIGINT)) AS BIGINT) AS total FROM log GROUP BY ALL"""),
}
