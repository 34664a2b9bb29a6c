"""Queries of declared reactors, projections and aggregators, of stored logs, and of files in other formats."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F

from loomlog.functions import api
from loomlog.operators import dataflow
from loomlog.plans.reference import FLOW, _read_model, _user_states, query
from loomlog.plans.reference_sql import _EXEC, _STATES, ORACLES, _q
from loomlog.session import scratch_path, written
from loomlog.sources import files
from loomlog.sources.fixtures import events_log, executions
from loomlog.sources.store import StoredLog

BIG = 90


@api.event("activity")
class Activity:
    k: int


@dataclass
class TooMuch(Exception):
    k: int
    reason: str


def charge(value, ctx: api.Context):
    """Charges what is over 50, fails on what is over ``BIG``, and says so in its log."""
    ctx.info("seen", {"k": value.k})
    if value.k > BIG:
        ctx.warn("too much")
        raise TooMuch(value.k, "limit")
    return [("charge", {"k": value.k}), ("mail", {"of": ctx.event_id})]


def _over_50(value) -> bool:
    return value.k > 50


def _purchases(s, d):
    return events_log(s, d).filter("event_type = 'activity:purchase'")


def _charged(s, d):
    return written(api.run_reactor(_purchases(s, d), "charge", charge, _over_50), "charged")


@query
def reactor_closure(s, d):
    """A closure on every purchase: its outcome and what it emitted."""
    return _charged(s, d).select(F.col("event_id").cast("bigint").alias("event_id"), "status", "error", F.size("children").cast("bigint").alias("n_children"), F.get("children", F.lit(0))["payload"].alias("first_payload"))


@query
def reactor_log_rows(s, d):
    """What the closure logged, drained when it ended."""
    return api.log_rows(_charged(s, d)).select(F.col("event_id").cast("bigint").alias("event_id"), F.col("nth").cast("bigint").alias("nth"), "level", "message", "data")


@query
def typed_errors(s, d):
    """The failures of one declared kind, their fields typed."""
    return api.errors_of(_charged(s, d), TooMuch, ["event_id"]).select(F.col("event_id").cast("bigint").alias("event_id"), "k", "reason")


def _pay(value, ctx: api.Context):
    """An effect that is not repeated: its result is journaled before the failure."""
    token = ctx.run(lambda: f"{ctx.attempt}-{value.k}")
    if ctx.attempt == 0 and value.k > 50:
        raise RuntimeError("after the effect")
    return ("paid", {"token": token})


@query
def journaled_run(s, d):
    """A second attempt replays what the first one's effects gave."""
    first = written(api.run_reactor(_purchases(s, d), "pay", _pay), "first")
    failed = _purchases(s, d).join(first.filter("status = 'error'").select(F.col("event_id").cast("bigint").alias("event_id")), "event_id", "left_semi")
    again = api.run_reactor(failed, "pay", _pay, journal=api.journal_rows(first), attempt=1)
    return again.select(F.col("event_id").cast("bigint").alias("event_id"), "status", F.get_json_object(F.get("children", F.lit(0))["payload"], "$.token").alias("token"))


def _greet(value, ctx: api.Context):
    return ("greet", {"seen": ctx.aggregate(default={"n_events": 0})["n_events"], "by": ctx.deps["by"]})


@query
def context_state(s, d):
    """A closure that reads its aggregate's state as of the event, and a dependency."""
    st = _user_states(s, d).filter("event_type = 'activity:purchase'")
    states = st.select("event_id", F.concat(F.lit("User:"), F.col("aggregate_id").cast("string")).alias("aggregate_key"), F.to_json(F.struct("n_events")).alias("state"))
    done = api.run_reactor(_purchases(s, d), "greet", _greet, deps={"by": "desk"}, states=states)
    body = F.get("children", F.lit(0))["payload"]
    return done.select(F.col("event_id").cast("bigint").alias("event_id"), F.get_json_object(body, "$.seen").cast("bigint").alias("seen"), F.get_json_object(body, "$.by").alias("by"))


def _ready(deps: dict) -> None:
    deps["step"] = 10


@api.reactor("begin", on=("activity:purchase",), init=_ready)
def _begin(value, ctx: api.Context):
    return ("count:down", {"left": value.k // ctx.deps["step"]})


@api.reactor("go_on", on=("count",))
def _go_on(value, ctx: api.Context):
    return ("count:down", {"left": value["left"] - 1}) if value["left"] > 7 else None


@api.reactor("watch")
def _watch(value, ctx: api.Context):
    return None


@query
def engine_settle(s, d):
    """Declared reactors until nothing is left to react to, under a correlation of the caller's; a start-up hook sets the step."""
    engine = api.Engine(s, {}).add(_begin, _go_on, _watch)
    handle = engine.emit(_purchases(s, d), correlation_id="run-1", timeout_s=600)
    events, _ = handle.settled()
    left = F.get_json_object("payload", "$.left").cast("bigint")
    return events.groupBy("correlation_id", "event_type", F.col("hops").cast("bigint").alias("hops"), left.alias("left_over")).agg(F.count("*").alias("n"))


@api.aggregator("Mark", on=(Activity,), key="k", default={"n": 0, "top": 0})
def _mark(state: dict, event: Activity) -> dict:
    return {"n": state["n"] + 1, "top": max(state["top"], event.k)}


@query
def engine_fold(s, d):
    """A declared aggregator over all persistent events, keyed by a field of the payload."""
    out = api.Engine(s).add(_mark).fold(events_log(s, d))
    return out.select("aggregate_key", F.get_json_object("state", "$.n").cast("bigint").alias("n"), F.get_json_object("state", "$.top").cast("bigint").alias("top"))


@api.projection("second", on=("activity:error", "activity:click"))
def _fragile(value, ctx: api.Context):
    if value.k % 2:
        raise ValueError("odd")
    return {"k": value.k}


@api.projection("first", priority=1)
def _every(value, ctx: api.Context):
    return {"k": value.k}


@query
def projection_observers(s, d):
    """Projections that observe every persistent event in their order; failures are recorded and stop nothing."""
    out = api.run_projections(events_log(s, d), [_fragile, _every])
    return out.groupBy("projection", F.col("nth").cast("bigint").alias("nth"), "error").agg(F.count("*").alias("n"), F.sum(F.get_json_object("row", "$.k").cast("bigint")).alias("total"))


@query
def stamped_metadata(s, d):
    """Emitted events with the engine's metadata; their own entries win."""
    x = executions(s, d).withColumn("hops", F.lit(2))
    kids = dataflow.emit(x, F.array(F.struct(F.lit("child").alias("event_type"), F.lit("{}").alias("payload"))))
    m = F.col("metadata")
    return dataflow.stamp(kids, {"service": "loom", "reactor_id": "engine", "zone": "z1"}).groupBy(
        m["reactor_id"].alias("reactor_id"), m["service"].alias("service"), m["zone"].alias("zone"), m["_hops"].alias("hops")
    ).agg(F.count("*").alias("n"))


@query
def batch_flushes(s, d):
    """Executions of each reactor in batches of at most five, or of six hours."""
    out = dataflow.batches(executions(s, d).select("reactor_id", "position", "started_at"), "reactor_id", "position", "started_at", 5, 6 * 3600)
    return out.select("reactor_id", "position", "batch_no")


def _as_stored(s, d):
    log = events_log(s, d)
    return log.select(*(F.col(c).cast("string").alias(c) for c in ("event_id", "parent_id")), "correlation_id", "event_type", "payload", "created_at", "persistent", F.col("aggregate_id").alias("user"), "position")


@query
def stored_streams(s, d):
    """Events appended to the streams of an aggregate type, in two overlapping deliveries: last position and version of each."""
    store = StoredLog(s, scratch_path(s, "stored"))
    rows = _as_stored(s, d)
    half = rows.agg(F.max("position")).first()[0] // 2
    store.persist(rows.filter(F.col("position") <= half + 100), "Account", "user", "created_at")
    store.persist(rows.filter(F.col("position") > half), "Account", "user", "created_at")
    return store.table().groupBy("aggregate_type", F.col("aggregate_id").cast("bigint").alias("aggregate_id")).agg(F.count("*").alias("n"), F.max("version").alias("version"))


@query
def emitted_outputs(s, d):
    """Prepared rows of any type appended as they are; given again, none is new."""
    store = StoredLog(s, scratch_path(s, "stored"))
    rows = _as_stored(s, d).select("event_id", "event_type", "payload", "created_at", "position")
    first, again = store.emit_output(rows, "position"), store.emit_output(rows, "position")
    return store.table().groupBy("event_type", "persistent").agg(F.count("*").alias("n")).withColumns({"first_new": F.lit(first).cast("bigint"), "then_new": F.lit(again).cast("bigint")})


@query
def read_model(s, d):
    """Every question of the read model over the log, by its number of rows."""
    m = _read_model(s, d)
    key = "User:8"
    asked = {
        "list_events": m.list_events(100, search="purch"), "get_event": m.get_event(500), "lineage_tree": m.lineage_tree(500), "lineage_flow": m.lineage_flow(FLOW),
        "events_from": m.events_from(500, 1000), "reactor_logs_by_correlation": m.reactor_logs_by_correlation(FLOW), "reactor_outcomes": m.reactor_outcomes(FLOW),
        "reactor_descriptions": m.reactor_descriptions(FLOW), "reactor_description_snapshots": m.reactor_description_snapshots(FLOW),
        "aggregate_state_timeline": m.aggregate_state_timeline(FLOW), "list_correlations": m.list_correlations("purchase", 50), "reactor_dependencies": m.reactor_dependencies(),
        "aggregate_lifecycle": m.aggregate_lifecycle(key), "list_aggregate_keys": m.list_aggregate_keys(), "reactor_logs": m.reactor_logs(7, "on_view_0"),
    }
    out = None
    for name, df in asked.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("question"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query
def file_formats(s, d):
    """The log written as CSV, JSON lines and Parquet, and read back: rows, and a sum that tells changed values."""
    log = _as_stored(s, d).drop("user")
    out = None
    for kind in files.KINDS:
        at = scratch_path(s, kind)
        files.write(log, at, kind)
        one = files.read(s, at, kind, log.schema)
        one = one.agg(F.count("*").alias("n"), F.sum(F.length("payload")).alias("characters"), F.count("parent_id").alias("n_parents"), F.max("created_at").alias("last_at"), F.count_if("persistent").alias("n_persistent"))
        one = one.select(F.lit(kind).alias("kind"), "*")
        out = one if out is None else out.unionByName(one)
    return out


_K = "CAST(payload->>'$.k' AS BIGINT)"
_PURCHASES = f"purchases AS (SELECT *, {_K} AS k FROM log WHERE event_type = 'activity:purchase')"
ORACLES |= {
    "reactor_closure": _q("""SELECT event_id, CASE WHEN k > 90 THEN 'error' ELSE 'completed' END AS status, CASE WHEN k > 90 THEN 'TooMuch: (' || k || ', ''limit'')' END AS error,
        CAST(CASE WHEN k > 50 AND k <= 90 THEN 2 ELSE 0 END AS BIGINT) AS n_children, CASE WHEN k > 50 AND k <= 90 THEN '{"k": ' || k || '}' END AS first_payload FROM purchases""", _PURCHASES),
    "reactor_log_rows": _q("""SELECT event_id, CAST(0 AS BIGINT) AS nth, 'info' AS level, 'seen' AS message, '{"k": ' || k || '}' AS data FROM purchases WHERE k > 50
        UNION ALL SELECT event_id, 1, 'warn', 'too much', NULL FROM purchases WHERE k > 90""", _PURCHASES),
    "typed_errors": _q("SELECT event_id, k, 'limit' AS reason FROM purchases WHERE k > 90", _PURCHASES),
    "journaled_run": _q("SELECT event_id, 'completed' AS status, '0-' || k AS token FROM purchases WHERE k > 50", _PURCHASES),
    "context_state": _q("SELECT event_id, n_events AS seen, 'desk' AS by FROM states WHERE last_type = 'activity:purchase'", _STATES),
    "engine_settle": _q("""SELECT 'run-1' AS correlation_id, CASE WHEN g = 0 THEN 'activity:purchase' ELSE 'count:down' END AS event_type, CAST(g AS BIGINT) AS hops, CAST(CASE WHEN g > 0 THEN k // 10 - g + 1 END AS BIGINT) AS left_over, count(*) AS n
        FROM purchases, range(5) t(g) WHERE g <= 1 + greatest(0, k // 10 - 7) GROUP BY ALL""", _PURCHASES),
    "engine_fold": _q(f"SELECT 'Mark:' || k AS aggregate_key, count(*) AS n, max(k) AS top FROM (SELECT {_K} AS k FROM log WHERE persistent) GROUP BY k"),
    "projection_observers": _q(f"""SELECT 'first' AS projection, CAST(0 AS BIGINT) AS nth, CAST(NULL AS VARCHAR) AS error, count(*) AS n, CAST(sum(k) AS BIGINT) AS total FROM (SELECT {_K} AS k FROM log WHERE persistent)
        UNION ALL SELECT 'second', 1, CASE WHEN k % 2 = 1 THEN 'ValueError: odd' END, count(*), CAST(sum(CASE WHEN k % 2 = 0 THEN k END) AS BIGINT) FROM (SELECT {_K} AS k FROM log WHERE event_type IN ('activity:error', 'activity:click')) GROUP BY 3"""),
    "stamped_metadata": _q("SELECT reactor_id, 'loom' AS service, 'z1' AS zone, '3' AS hops, count(*) AS n FROM executions GROUP BY 1", _EXEC),
    "batch_flushes": _q("""SELECT reactor_id, position, no AS batch_no FROM b""", _EXEC, """x AS (SELECT reactor_id, position, row_number() OVER w AS rn, max(epoch_us(started_at)) OVER (w ROWS UNBOUNDED PRECEDING) AS us FROM executions
          WINDOW w AS (PARTITION BY reactor_id ORDER BY position)),
        b(reactor_id, position, rn, no, size, start) AS (SELECT reactor_id, position, rn, CAST(0 AS BIGINT), 1, us FROM x WHERE rn = 1 UNION ALL
          SELECT x.reactor_id, x.position, x.rn, CASE WHEN size >= 5 OR us - start >= 21600000000 THEN no + 1 ELSE no END, CASE WHEN size >= 5 OR us - start >= 21600000000 THEN 1 ELSE size + 1 END,
            CASE WHEN size >= 5 OR us - start >= 21600000000 THEN us ELSE start END FROM b JOIN x ON x.reactor_id = b.reactor_id AND x.rn = b.rn + 1)""", recursive=True),
    "stored_streams": _q("SELECT 'Account' AS aggregate_type, aggregate_id, count(*) AS n, count(*) AS version FROM log GROUP BY aggregate_id"),
    "emitted_outputs": _q("SELECT event_type, true AS persistent, count(*) AS n, (SELECT count(*) FROM log) AS first_new, CAST(0 AS BIGINT) AS then_new FROM log GROUP BY 1"),
    "read_model": _q(f"""SELECT * FROM (SELECT 'list_events' AS question, (SELECT least(100, count(*)) FROM log WHERE contains(lower(event_type), 'purch')) AS n
        UNION ALL SELECT 'get_event', (SELECT count(*) FROM log WHERE position = 500) UNION ALL SELECT 'lineage_tree', (SELECT count(*) FROM log WHERE correlation_id = (SELECT correlation_id FROM log WHERE position = 500))
        UNION ALL SELECT 'lineage_flow', (SELECT count(*) FROM log WHERE correlation_id = '{FLOW}') UNION ALL SELECT 'events_from', (SELECT least(500, count(*)) FROM log WHERE position >= 500)
        UNION ALL SELECT 'reactor_logs_by_correlation', (SELECT count(*) FROM executions WHERE event_id IN (SELECT event_id FROM log WHERE correlation_id = '{FLOW}'))
        UNION ALL SELECT 'reactor_outcomes', (SELECT count(DISTINCT reactor_id) FROM executions WHERE correlation_id = '{FLOW}')
        UNION ALL SELECT 'reactor_descriptions', (SELECT count(DISTINCT reactor_id) FROM executions WHERE correlation_id = '{FLOW}')
        UNION ALL SELECT 'reactor_description_snapshots', (SELECT count(*) FROM executions WHERE correlation_id = '{FLOW}')
        UNION ALL SELECT 'aggregate_state_timeline', (SELECT count(*) FROM log WHERE correlation_id = '{FLOW}' AND persistent)
        UNION ALL SELECT 'list_correlations', (SELECT least(50, count(*)) FROM (SELECT arg_min(event_type, position) FILTER (parent_id IS NULL) AS root FROM log GROUP BY correlation_id) WHERE contains(root, 'purchase'))
        UNION ALL SELECT 'reactor_dependencies', (SELECT count(DISTINCT reactor_id) FROM log) UNION ALL SELECT 'aggregate_lifecycle', (SELECT least(100, count(*)) FROM log WHERE aggregate_id = 8 AND persistent)
        UNION ALL SELECT 'list_aggregate_keys', (SELECT count(DISTINCT aggregate_id) FROM log WHERE persistent)
        UNION ALL SELECT 'reactor_logs', (SELECT count(*) FROM executions WHERE event_id = 7 AND reactor_id = 'on_view_0'))""", _EXEC),
    "file_formats": _q("""SELECT kind, count(*) AS n, CAST(sum(length(payload)) AS BIGINT) AS characters, count(parent_id) AS n_parents, max(created_at) AS last_at, count(*) FILTER (persistent) AS n_persistent
        FROM log, (VALUES ('csv'), ('json'), ('parquet')) t(kind) GROUP BY kind"""),
}
