"""The engine's own queries over the log that ``sources.fixtures`` derives from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomlog.functions import api, text
from loomlog.functions.ids import id_key
from loomlog.operators import dataflow, fold, graph, hierarchy, inspect, monitor, ordered
from loomlog.operators.dataflow import Reactor, Registry
from loomlog.plans import data_problems
from loomlog.session import scratch_path, table
from loomlog.sources import log as L
from loomlog.sources import queue as Q
from loomlog.sources.fixtures import events_log, executions, order_stream, reactor_logs
from loomlog.sources.store import SCHEMA, StoredLog

QUERIES = {}


@api.event("claim:settled")
class ClaimSettled:
    claim_no: int
    handler: str


#: Parameters of the queries: an event that every scale has, pages, and a stream.
AT, PAGE, STREAM, FLOW = 500, 50, 8, "u8-1"
SHOWN = ["position", "event_id", "event_type", "correlation_id", "created_at"]


def query(f):
    QUERIES[f.__name__] = f
    return f


def _now(log: DataFrame):
    """The log's own present: its latest time."""
    return F.lit(log.agg(F.max("created_at")).first()[0]).cast("timestamp_ntz")


def _user() -> fold.Fold:
    """The user aggregate: events seen, errors, sum of values, last type, whether it ever bought."""
    return fold.Fold(
        ["aggregate_type", "aggregate_id"], "position",
        {
            "n_events": fold.Field("count"),
            "n_errors": fold.Field("count", when=F.col("event_type") == "activity:error"),
            "total": fold.Field("sum", value=F.col("value").cast("decimal(18,2)")),
            "last_type": fold.Field("last", value=F.col("event_type"), default="none"),
            "bought": fold.Field("ever", when=F.col("event_type") == "activity:purchase"),
        },
    )


def _order() -> fold.Fold:
    return fold.Fold(
        ["aggregate_id"], "version",
        {
            "status": fold.Field("last", value=F.col("event_type")),
            "total": fold.Field("last", value=F.col("amt"), when=F.col("event_type") == "order_placed", default=0.0),
            "returned": fold.Field("count", when=F.col("event_type") == "line:returned"),
        },
    )


FIELDS = ["n_events", "n_errors", "total", "last_type", "bought"]


def _persistent(s: SparkSession, d: str) -> DataFrame:
    return events_log(s, d).filter("persistent")


def _user_out(df: DataFrame) -> DataFrame:
    return df.withColumn("total", F.round(F.col("total").cast("double"), 2))


# --- scans ---------------------------------------------------------------------------------------------------------


@query
def load_from_page(s, d):
    return L.load_from(events_log(s, d), AT, PAGE).select(*SHOWN)


@query
def load_stream_after(s, d):
    return L.load_stream(events_log(s, d), "User", STREAM, 3).select("position", "aggregate_id", "version", "event_type")


@query
def latest_position(s, d):
    return L.latest_position(events_log(s, d))


@query
def get_event(s, d):
    return inspect.display(L.get_event(events_log(s, d), AT)).select("position", "name", "summary", "payload")


@query
def events_from_seq(s, d):
    return L.events_from(events_log(s, d), AT, 1000).select(*SHOWN)


@query
def list_events_page(s, d):
    return L.list_events(events_log(s, d), 1000, cursor=900, since="2024-01-02 00:00:00", until="2024-02-01 00:00:00").select(*SHOWN)


@query
def list_events_search(s, d):
    return L.list_events(events_log(s, d), 100, search="PURCH").select(*SHOWN)


@query
def event_cache_recent(s, d):
    return L.most_recent(events_log(s, d), 300).select(*SHOWN)


@query
def search_count(s, d):
    """Events that contain a text in type, payload or correlation, over the whole log."""
    hit = L.matches("k\": 7", "event_type", "payload", "correlation_id")
    return events_log(s, d).filter(hit).groupBy("event_type").agg(F.count("*").alias("n"))


@query
def pointer_positions(s, d):
    """Active and staged position of each pointer and partition, from its newest rows."""
    p = table(s, d, "pointer_status")
    return p.groupBy("pointer_name", "log_partition").agg(
        F.max_by("active", F.when(F.col("staged").isNull(), F.struct("updated_at", "active"))).alias("active"),
        F.max("updated_at").alias("updated_at"), F.count_if(F.col("staged").isNotNull()).alias("n_staged_runs"),
    )


# --- append, snapshots ---------------------------------------------------------------------------------------------


def _half(log: DataFrame) -> int:
    return L.latest_position(log).first()["position"] // 2


@query
def append_idempotent(s, d):
    """The first half of the log, and a delivery of its last three quarters with every row twice: the rows that are appended."""
    log = events_log(s, d)
    half = _half(log)
    new = log.filter(F.col("position") > half // 2).select("event_id", "event_type", "aggregate_type", "aggregate_id", "created_at")
    return L.append(log.filter(F.col("position") <= half), new.unionByName(new), "event_id").select("position", "event_id", "aggregate_id", "version")


@query
def append_conflicts(s, d):
    """Optimistic appends to every stream by writers that had read the first half of the log, against the versions that the
    whole log stands at now: those whose stream has not moved since."""
    log = events_log(s, d)
    seen = F.max(F.when(F.col("position") <= _half(log), F.col("version")))
    expected = log.groupBy("aggregate_type", "aggregate_id").agg(F.coalesce(seen, F.lit(0)).alias("expected_version"))
    new = expected.select("aggregate_type", "aggregate_id", F.lit("activity:view").alias("event_type"))
    return L.append_expected(log, new, expected).select("aggregate_id", "event_type")


@query
def append_conflicts_recent(s, d):
    """The same for writers that had read all of the log but its last twentieth."""
    log = events_log(s, d)
    upto = L.latest_position(log).first()["position"] * 19 // 20
    expected = log.groupBy("aggregate_type", "aggregate_id").agg(F.coalesce(F.max(F.when(F.col("position") <= upto, F.col("version"))), F.lit(0)).alias("expected_version"))
    new = expected.select("aggregate_type", "aggregate_id", F.lit("activity:view").alias("event_type"))
    return L.append_expected(log, new, expected).select("aggregate_id", "event_type")


def _user_states(s, d) -> DataFrame:
    return _user().running(_persistent(s, d), keep=["aggregate_type", "aggregate_id", "position", "event_id", "version", "created_at", "correlation_id"])


@query
def snapshot_every_10(s, d):
    return _user_out(fold.every(_user_states(s, d), 10)).select("aggregate_id", "version", "n_events", "n_errors", "total", "last_type", "bought")


@query
def load_snapshot(s, d):
    snaps = fold.every(_user_states(s, d), 10).select("aggregate_type", "aggregate_id", "version", "n_events", "last_type")
    return L.latest_snapshot(snaps).select("aggregate_id", "version", "n_events", "last_type")


@query
def hydrate_from_snapshot(s, d):
    """Cold reads: the newest snapshot of each user and the events after it."""
    snaps = L.latest_snapshot(fold.every(_user_states(s, d), 10).select("aggregate_type", "aggregate_id", "version", *FIELDS))
    return _user_out(_user().seeded(snaps, _persistent(s, d))).select("aggregate_id", *FIELDS)


@query
def hydrate_default_value(s, d):
    """Cold reads where an event can set the very value that the field has before any event."""
    f = _user()
    f.fields["last_type"] = fold.Field("last", value=F.col("event_type"), default="activity:error")
    snaps = L.latest_snapshot(fold.every(_user_states(s, d), 10).select("aggregate_type", "aggregate_id", "version", *FIELDS))
    return _user_out(f.seeded(snaps, _persistent(s, d))).select("aggregate_id", *FIELDS)


@query
def snapshot_policy(s, d):
    """Snapshots ten versions after the last one, where one was also taken by hand at version 7."""
    states = _user_states(s, d)
    by_hand = states.filter("version = 7").select("aggregate_type", "aggregate_id", "version")
    return fold.due(states, 10, ["aggregate_type", "aggregate_id"], by_hand).select("aggregate_id", "version", "n_events", "last_type")


# --- folds and windows ---------------------------------------------------------------------------------------------


@query
def aggregate_fold_user(s, d):
    return _user_out(_user().final(_persistent(s, d))).select("aggregate_id", *FIELDS)


@query
def aggregate_fold_user_running(s, d):
    return _user_out(_user_states(s, d)).select("position", "aggregate_id", "n_events", "n_errors", "total", "last_type", "bought")


@query
def aggregate_fold_user_split(s, d):
    """The running fold without one task per user, as for users that hold a large share of the log."""
    keep = ["position", "aggregate_id"]
    return _user_out(_user().running_split(_persistent(s, d), keep)).select("position", "aggregate_id", *FIELDS)


@query
def aggregate_fold_order(s, d):
    return _order().running(order_stream(s, d), keep=["aggregate_id", "version"])


@query
def aggregate_fold_order_final(s, d):
    return _order().final(order_stream(s, d))


@query
def fold_longest_streak(s, d):
    """A fold whose next state needs the whole previous one: the longest run of errors of each user."""
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(st, e):
        run = F.when(e["event_type"] == "activity:error", st["run"] + 1).otherwise(0)
        return F.struct(run.alias("run"), F.greatest(st["best"], run).alias("best"))

    out = fold.fold_sorted(_persistent(s, d), ["aggregate_id"], "position", ["event_type"], start, step)
    return out.select("aggregate_id", F.col("state.best").alias("longest_streak"))


@query
def state_as_of(s, d):
    return _user_out(_user().as_of(_persistent(s, d), F.col("created_at") <= F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"))).select("aggregate_id", *FIELDS)


@query
def transition_guard(s, d):
    """Events at which a user's state went to error from something else."""
    t = _user().transitions(_persistent(s, d), lambda prev, nxt: (nxt("last_type") == "activity:error") & (prev("last_type") != "activity:error"), ["version"])
    return t.select("position", "aggregate_id", F.col("prev_last_type").alias("from_type"), "n_errors")


@query
def timeline_islands(s, d):
    r = fold.islands(events_log(s, d), "correlation_id", "position")
    return r.select("correlation_id", F.col("first").alias("first_position"), F.col("last").alias("last_position"), F.col("n").alias("n_events"), F.col("root").alias("root_type"))


@query
def timeline_previous(s, d):
    """Each entry of a correlation's state timeline with the entry before it."""
    p = fold.previous_entry(_user_states(s, d), "correlation_id", "position", ["position", "n_events"])
    return p.select("correlation_id", "position", "n_events", "prev_position", "prev_n_events")


@query
def scrubber_steps(s, d):
    log = events_log(s, d).select("correlation_id", "position")
    return ordered.neighbours(log, ["correlation_id"], ["position"], {"previous": "position"}, {"next": "position"})


# --- inspector -----------------------------------------------------------------------------------------------------


@query
def list_correlations(s, d):
    return inspect.list_correlations(events_log(s, d), executions(s, d))


@query
def list_correlations_page(s, d):
    return inspect.list_correlations(events_log(s, d), executions(s, d), search="PURCHASE", limit=PAGE)


@query
def reactor_outcomes(s, d):
    return inspect.reactor_outcomes(executions(s, d))


@query
def reactor_outcome_events(s, d):
    return inspect.outcome_events(executions(s, d))


@query
def reactor_outcomes_page(s, d):
    """The outcomes of one correlation with their events, as a page shows them."""
    return _read_model(s, d).reactor_outcomes(FLOW).select("reactor_id", "status", "errors", "attempts", "started_at", "completed_at", "event_ids")


def _read_model(s, d) -> inspect.ReadModel:
    return inspect.ReadModel(events_log(s, d), executions(s, d), reactor_logs(s, d), _descriptions(s, d), _keyed_states(s, d))


@query
def reactor_dependencies(s, d):
    r = inspect.reactor_dependencies(events_log(s, d), executions(s, d))
    return r.select("reactor_id", F.array_join("input_event_types", ",").alias("input_event_types"), F.array_join("output_event_types", ",").alias("output_event_types"))


@query
def reactor_logs_filtered(s, d):
    return inspect.logs_of(reactor_logs(s, d), levels=["info", "warn"], text="ERROR").select("event_id", "reactor_id", "level", "message", "position")


@query
def reactor_logs_by_correlation(s, d):
    return inspect.logs_of_correlation(reactor_logs(s, d), events_log(s, d), FLOW).select("event_id", "reactor_id", F.lower("level").alias("level"), "message", "position")


def _descriptions(s, d) -> DataFrame:
    return executions(s, d).select("correlation_id", "reactor_id", "event_id", "position", F.concat(F.lit("saw "), "child_type").alias("description"))


@query
def reactor_descriptions(s, d):
    return inspect.latest_descriptions(_descriptions(s, d))


@query
def reactor_description_snapshots(s, d):
    return _descriptions(s, d).filter(F.col("correlation_id") == FLOW)


def _keyed_states(s, d) -> DataFrame:
    return _user_states(s, d).select("position", "event_id", inspect.aggregate_key("aggregate_type", "aggregate_id").alias("aggregate_key"), "n_events", "last_type", "correlation_id")


@query
def aggregate_timeline(s, d):
    return inspect.state_timeline(_keyed_states(s, d), events_log(s, d)).select("position", "aggregate_key", "n_events", "last_type", "event_type")


@query
def aggregate_lifecycle(s, d):
    return inspect.lifecycle(_keyed_states(s, d), events_log(s, d), f"User:{STREAM}", 100).select("position", "event_type", "created_at", "n_events")


@query
def aggregate_keys(s, d):
    return _persistent(s, d).select(inspect.aggregate_key("aggregate_type", "aggregate_id").alias("aggregate_key")).distinct()


@query
def waterfall(s, d):
    log = events_log(s, d)
    return inspect.waterfall(executions(s, d), _now(log))


@query
def observability_stream(s, d):
    return inspect.observability_stream(events_log(s, d), executions(s, d))


@query
def display_projection(s, d):
    return inspect.display(events_log(s, d)).select("position", "name", "summary", "reactor_id")


# --- graph ---------------------------------------------------------------------------------------------------------


@query
def lineage_tree(s, d):
    return graph.lineage_tree(events_log(s, d), AT).select("position", "event_id", "parent_id", "root_position")


@query
def lineage_flow(s, d):
    return graph.lineage_flow(events_log(s, d), FLOW).select("position", "event_id", "parent_id", "event_type")


@query
def tree_roots(s, d):
    return graph.roots(events_log(s, d)).select("position", "event_id", "correlation_id")


@query
def tree_edges(s, d):
    return graph.edges(events_log(s, d)).select("event_id", "parent_id", "parent_position", "parent_type", "reactor_id")


@query
def lineage_depth(s, d):
    return graph.depths(events_log(s, d))


@query
def subtree(s, d):
    """The largest tree's root and all below it."""
    log = events_log(s, d)
    big = log.groupBy("correlation_id").agg(F.count("*").alias("n"), F.min("position").alias("p")).orderBy(F.desc("n"), "p").first()
    return graph.subtree(log, big["p"]).select("event_id", "parent_id", "level")


@query
def children_by_reactor(s, d):
    return graph.children_by_reactor(events_log(s, d))


@query
def critical_path(s, d):
    return graph.critical_paths(events_log(s, d))


@query
def flow_nodes(s, d):
    return graph.flow_nodes(events_log(s, d), executions(s, d))


@query
def flow_edges(s, d):
    return graph.flow_edges(events_log(s, d))


@query
def flow_edges_hidden(s, d):
    return graph.flow_edges(events_log(s, d), [f"on_{t}_{i}" for t in ("view", "click", "error", "purchase") for i in (0, 1)])


@query
def visible_at_seq(s, d):
    """The flow graph as it stood when half of the log was written."""
    log = events_log(s, d)
    return graph.flow_edges(log.filter(F.col("position") <= _half(log)))


# --- dataflow ------------------------------------------------------------------------------------------------------


def registry() -> Registry:
    """Routes by type, by prefix, by several types, and on everything."""
    r = Registry()
    r.add(Reactor("bill", ("activity:purchase",), where=F.col("value") > 20, priority=1, max_attempts=3))
    r.add(Reactor("alert", ("activity:error", "activity:signup"), delay_s=60))
    r.add(Reactor("enrich", ("activity",), priority=20))
    return r.add(Reactor("audit"))


@query
def route_reactors(s, d):
    r = registry()
    out = dataflow.fired(dataflow.route(events_log(s, d), r.routes(s)), r)
    return out.select("event_id", "reactor", "priority", "fired")


@query
def dequeue_order(s, d):
    log = events_log(s, d)
    q = dataflow.intents(dataflow.route(log, registry().routes(s)))
    return dataflow.dequeue_order(q, _now(log)).select("event_id", "reactor_id", "priority", "execute_at", F.col("nth").cast("bigint").alias("nth"))


@query
def earliest_pending(s, d):
    """Per reactor when its next queued work can run."""
    q = Q.Queue(s, scratch_path(s, "queue"))
    q.commit("all", intents=_queued(dataflow.intents(dataflow.route(events_log(s, d), registry().routes(s)))))
    return q.earliest_pending("reactor_id")


@query
def projections_by_priority(s, d):
    """Registrations in running order; those without a priority run last."""
    return dataflow.by_priority(registry().table(s)).select("reactor", "priority", "nth")


@query
def extract_values(s, d):
    """Filter and map: the numeric field of the payload where it is there and above 50."""
    k = F.get_json_object("payload", "$.k").cast("bigint")
    return dataflow.extract(events_log(s, d), F.when(k > 50, k), "k", ["event_id"])


@query
def extract_fields(s, d):
    """Fields of payload variants: a claim's number and amount, a refund's amount only."""
    e = table(s, d, "stored_events")
    amount = ("$.amount", "double")
    return dataflow.extract_fields(e, {"claim:settled": {"claim_no": ("$.claim_no", "bigint"), "amount": amount}, "refund:paid": {"amount": amount}}, ["seq"])


@query
def ephemeral_gate(s, d):
    """Ephemeral events are routed but not folded: per type, how many are routed and how many folded."""
    routed, folded = dataflow.ephemeral_gate(events_log(s, d))
    n = folded.groupBy("event_type").agg(F.count("*").alias("n_folded"))
    out = routed.groupBy("event_type").agg(F.count("*").alias("n_routed")).join(n, "event_type", "left")
    return out.select("event_type", "n_routed", F.coalesce("n_folded", F.lit(0)).cast("bigint").alias("n_folded"))


@query
def hop_gate(s, d):
    log = events_log(s, d).join(graph.depths(events_log(s, d)).select("event_id", F.col("depth").alias("hops")), "event_id")
    go, stop = dataflow.hop_gate(log, limit=3)
    kinds = go.select(F.lit("run").alias("outcome"), "hops").unionByName(stop.select(F.lit("park").alias("outcome"), "hops"))
    return kinds.groupBy("outcome", "hops").agg(F.count("*").alias("n"))


@query
def hop_gate_stored(s, d):
    """The stored log under the engine's own limit of hops: events that run and that are parked."""
    found = hierarchy.resolve(data_problems._nodes(s, d)).filter("not cyclic").select(F.col("depth").alias("hops"))
    go, stop = dataflow.hop_gate(found)
    rows = go.select(F.lit("run").alias("outcome"), "hops").unionByName(stop.select(F.lit("park").alias("outcome"), "hops"))
    return rows.groupBy("outcome").agg(F.count("*").alias("n"), F.max("hops").alias("most_hops"))


@query
def attempt_gate(s, d):
    """Stored outcomes under the limit of attempts: what is processed again and what is parked."""
    go, stop = dataflow.attempt_gate(table(s, d, "reactor_outcomes").dropDuplicates(["outcome_no"]))
    rows = go.select(F.lit("process").alias("outcome"), "attempts").unionByName(stop.select(F.lit("park").alias("outcome"), "attempts"))
    return rows.groupBy("outcome", "attempts").agg(F.count("*").alias("n"))


def _cancellations(s, d) -> DataFrame:
    log = events_log(s, d)
    return log.filter("event_type = 'activity:error' and parent_id is null").select("correlation_id", F.col("created_at").alias("cancelled_at"))


@query
def cancel_gate(s, d):
    """Events whose correlation was cancelled in the last three days of the log are skipped."""
    log = events_log(s, d)
    return dataflow.not_cancelled(log, _cancellations(s, d), _now(log), 3 * 86_400).select("event_id", "correlation_id")


@query
def cancelled_executions(s, d):
    log = events_log(s, d)
    out = dataflow.cancelled(executions(s, d), _cancellations(s, d), _now(log), 3 * 86_400)
    return out.select("event_id", "reactor_id", F.lit("cancelled").alias("reason"))


@query
def emitted_event_ids(s, d):
    """Every execution emits one child per attempt: ids, hops and routing metadata."""
    x = executions(s, d).withColumn("hops", F.lit(2))
    kids = F.transform(F.sequence(F.lit(0), F.col("attempts")), lambda i: F.struct(F.lit("child").alias("event_type"), F.concat(F.lit("n"), i.cast("string")).alias("payload")))
    out = dataflow.emit(x, kids)
    return out.select("event_id", "parent_id", "payload", F.col("hops").cast("bigint").alias("hops"), F.col("metadata")["_reactor_id"].alias("by_reactor"))


@query
def idempotency_keys(s, d):
    return executions(s, d).select("event_id", "reactor_id", dataflow.idempotency_key("event_id", "reactor_id").alias("idempotency_key"))


@query
def settle_generations(s, d):
    """Chains that settle: each purchase starts one that emits a shorter chain until its count is used up."""
    seed = events_log(s, d).filter("event_type = 'activity:purchase'").select(
        F.col("event_id").cast("string").alias("event_id"), F.lit(None).cast("string").alias("parent_id"), "correlation_id", F.lit("chain").alias("event_type"),
        F.pmod("event_id", F.lit(4)).cast("string").alias("payload"), F.lit(0).alias("hops"),
    )

    def react(generation):
        go = generation.filter("payload > '0'").withColumn("reactor_id", F.lit("step"))
        kids = F.array(F.struct(F.lit("chain").alias("event_type"), (F.col("payload").cast("int") - 1).cast("string").alias("payload")))
        return dataflow.emit(go, kids)

    done, _ = dataflow.settle(seed, react)
    return done.groupBy(F.col("hops").cast("bigint").alias("hops"), F.col("payload").alias("left_over")).agg(F.count("*").alias("n"))


@query
def retry_schedule(s, d):
    return dataflow.retry_schedule(executions(s, d).filter("status = 'error'"), 3, 10)


@query
def timed_out(s, d):
    log = events_log(s, d)
    return dataflow.timed_out(executions(s, d), dataflow.DEFAULT_TIMEOUT_S, _now(log)).select("event_id", "reactor_id", "status", "position")


@query
def dlq_terminal_events(s, d):
    out = dataflow.dead_letters(executions(s, d), {"on_click_0": "click_failed"}, "reactor_dlq")
    return out.select("event_id", "parent_id", "event_type", "reactor_id", "error", F.col("attempts").cast("bigint").alias("attempts"), "reason")


def _dlq(s, d) -> DataFrame:
    return executions(s, d).filter("status = 'error'").withColumn("reason", F.lit("failed"))


@query
def dlq_by_error(s, d):
    return monitor.by_error(_dlq(s, d))


@query
def dlq_by_reason(s, d):
    return monitor.by_reason(_dlq(s, d))


@query
def dlq_requeue(s, d):
    log = events_log(s, d)
    dead = dataflow.dead_letters(executions(s, d), {}, "reactor_dlq").filter("error = 'boom-3'")
    return dataflow.requeue(dead, _now(log)).select("parent_id", "reactor_id", F.col("attempts").cast("bigint").alias("attempts"), "status")


@query
def resolve_last_status(s, d):
    """The current status of each queued execution from its append-only transitions."""
    x = executions(s, d)
    q = Q.Queue(s, scratch_path(s, "queue"))
    q.commit("all", intents=_queued(x.withColumn("execute_at", F.col("started_at"))))
    moves = x.select(F.col("event_id").cast("string").alias("event_id"), "reactor_id", F.col("position").alias("at"), "status", "attempts", "error")
    q.resolve("first", moves.withColumn("status", F.lit("retry")))
    q.resolve("last", moves.withColumn("at", F.col("at") + 1_000_000_000_000))
    q.resolve("last", moves.withColumn("status", F.lit("again")))  # a batch that is committed already changes nothing
    return q.statuses().select(F.col("event_id").cast("bigint").alias("event_id"), "reactor_id", "status")


@query
def journal_replay(s, d):
    """Journal entries of executions that have not completed, in order; completed ones are cleared."""
    return _journaled(s, d).journal().select(F.col("event_id").cast("bigint").alias("event_id"), "reactor_id", "seq", F.col("value").alias("entry"))


@query
def journal_cleared(s, d):
    """The same after the journals of failed executions were cleared."""
    q = _journaled(s, d)
    failed = q.statuses().filter("status = 'error'").select("event_id", "reactor_id")
    q.clear_journal("failed", failed)
    return q.journal().groupBy("reactor_id").agg(F.count("*").alias("n"))


def _journaled(s, d) -> Q.Queue:
    """A queue of the executions with one journal entry for each time they ran."""
    x = ordered.numbered(executions(s, d), ["event_id", "reactor_id"], ["position"], "seq").withColumn("event_id", F.col("event_id").cast("string"))
    q = Q.Queue(s, scratch_path(s, "queue"))
    done = F.when(F.col("status") == "completed", F.lit("complete")).otherwise(F.col("status"))
    q.commit(
        "all", intents=_queued(x.withColumn("execute_at", F.col("started_at"))), journal=x.withColumn("value", F.col("child_type")),
        transitions=x.filter("status in ('completed', 'error')").withColumns({"at": F.col("position"), "status": done}),
    )
    return q


def _queued(x: DataFrame) -> DataFrame:
    """Rows as queued work, with the defaults for what they lack."""
    defaults = {"timeout_seconds": "timeout_s", "max_attempts": "max_attempts", "priority": "priority", "hops": "hops"}
    own = {n: F.col(c).cast("int") if c in x.columns else F.lit(v) for (n, c), v in zip(defaults.items(), (900, 1, 10, 0))}
    return x.withColumns({"event_id": F.col("event_id").cast("string"), **own})


@query
def same_batch_join(s, d):
    """Orders all of whose lines are final, with the lines' parts in order."""
    w = Window.partitionBy("l_orderkey")
    order = w.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    li = table(s, d, "lineitem").select(
        F.col("l_orderkey").alias("batch_id"), (F.row_number().over(order) - 1).alias("batch_index"), F.count("*").over(w).alias("batch_size"), "l_linestatus", "l_partkey",
    ).filter("l_linestatus = 'F'")
    out = dataflow.complete_batches(li, ["batch_id"], "batch_index", "batch_size", ["l_partkey"])
    return out.select("batch_id", "batch_size", F.array_join(F.transform("rows", lambda r: r["l_partkey"].cast("string")), ",").alias("parts"))


@query
def convergence_gate(s, d):
    need = ["activity:view", "activity:click", "activity:purchase"]
    return dataflow.gate(events_log(s, d), "correlation_id", "position", F.col("event_type"), need)


@query
def wait_terminal(s, d):
    """Per workflow the first terminal event (a purchase or an error) and how many events came before it."""
    return dataflow.first_of(events_log(s, d), "correlation_id", "position", ["activity:purchase", "activity:error"])


@query
def batch_demultiplex(s, d):
    """A batch lookup answers some keys; the others are errors."""
    req = events_log(s, d).select("event_id", F.col("aggregate_id").alias("user_id"))
    res = events_log(s, d).filter("aggregate_id % 2 = 0").groupBy(F.col("aggregate_id").alias("user_id")).agg(F.count("*").alias("answer"))
    return dataflow.demultiplex(req, res, "user_id").select("event_id", "user_id", "answer", "error")


@query
def describe_all(s, d):
    """At each persistent event every described reactor is evaluated against the state as of that event."""
    described = {"bill": F.concat(F.lit("events: "), F.col("n_events").cast("string")), "alert": F.concat(F.lit("errors: "), F.col("n_errors").cast("string"))}
    return inspect.describe_all(_user_states(s, d), described, ["event_id"])


@query
def captured_states(s, d):
    """The state that each event left its aggregate in."""
    return inspect.capture_states(_user_states(s, d), ["n_events", "n_errors", "last_type"]).select("position", "aggregate_key", "state")


@query
def concat_logs(s, d):
    """The union of two logs (events and stored events) by type."""
    a = events_log(s, d).select("event_type", F.col("event_id").cast("string").alias("id"))
    b = table(s, d, "stored_events").select("event_type", "id")
    return a.unionByName(b).groupBy("event_type").agg(F.count("*").alias("n"))


# --- scalar functions ----------------------------------------------------------------------------------------------


@query
def type_names(s, d):
    """Prefix, short and display names of all event types."""
    t = events_log(s, d).select("event_type").distinct().withColumn("path", F.concat(F.lit("crate::mod::"), F.substring_index("event_type", ":", -1)))
    return t.select("event_type", dataflow.prefix("event_type").alias("prefix"), dataflow.short_name("path").alias("short_name"), text.title(dataflow.short_name("path")).alias("title"))


@query
def durable_names(s, d):
    """Customer segments under the rename rules of variants."""
    seg = table(s, d, "customer").select(F.concat(F.lit("Http"), F.initcap("c_mktsegment"), F.lit("DoneV")).alias("name")).distinct()
    rules = {"snake": "snake_case", "camel": "camelCase", "pascal": "PascalCase", "screaming": "SCREAMING_SNAKE_CASE", "kebab": "kebab-case"}
    return seg.select("name", *(text.rename_all(F.col("name"), r).alias(n) for n, r in rules.items()))


@query
def duration_labels(s, d):
    ms = (F.unix_micros(F.col("completed_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1000
    x = executions(s, d).filter("completed_at is not null").withColumn("ms", F.floor(ms).cast("bigint"))
    return x.select("position", "ms", *(text.duration(F.col("ms"), form).alias(form) for form in ("bar", "node", "range")))


@query
def display_labels(s, d):
    """Threshold labels, percents and cut texts of events."""
    share = F.col("position") % 101 / 100.0
    return events_log(s, d).select(
        "position", text.threshold_label(share, 0.4, 0.6).alias("label"), text.percent(F.lit(1.0) - share, "% original").alias("percent"), text.truncate(F.col("payload"), 5).alias("cut")
    )


@query
def progress_fraction(s, d):
    c = executions(s, d).groupBy("correlation_id").agg(F.count_if(F.col("status") == "completed").alias("done"), F.count("*").alias("all"))
    return c.select("correlation_id", F.round(text.fraction(F.col("done"), F.col("all")), 6).alias("fraction"))


@query
def state_json_diff(s, d):
    """What changed between each user's successive states, as JSON documents."""
    st = _user_states(s, d).withColumn("doc", F.to_json(F.struct("n_errors", "last_type", F.when(F.col("bought"), F.lit(1)).alias("bought"))))
    w = Window.partitionBy("aggregate_id").orderBy("position")
    diff = text.json_diff(F.lag("doc").over(w), F.col("doc"))
    return st.select("position", F.array_join(diff, ",").alias("diff"))


@query
def upcast_chain(s, d):
    """Archived payloads brought to the newest schema by the declared steps: per type, how many have which field then."""
    new = text.upcast(F.col("event_type"), F.col("schema_version"), F.col("payload"), text.declared_steps(table(s, d, "upcasters")))
    fields = {"channel": "$.channel", "meta_channel": "$.meta.channel", "temp": "$.temp", "temperature": "$.temperature", "batch": "$.batchNo", "batch_no": "$.batch_no", "tags": "$.tags", "labels": "$.labels", "enabled": "$.enabled", "remark": "$.remark", "score": "$.score"}
    e = table(s, d, "archive_lines").select("event_type", F.when(text.is_object(F.col("payload")), new).alias("new"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), *(F.count_if(F.get_json_object("new", p).isNotNull()).alias(n) for n, p in fields.items()))


@query
def typed_events(s, d):
    """Type test and downcast: settled claims with their typed number and handler; a payload of another shape has nulls."""
    e = api.downcast(table(s, d, "stored_events"), ClaimSettled, ["seq"])
    return e.groupBy("handler").agg(F.count("*").alias("n"), F.max("claim_no").alias("max_claim"))


# --- monitoring ----------------------------------------------------------------------------------------------------


@query
def pending_depth(s, d):
    return monitor.pending_depth(executions(s, d))


@query
def failure_rate(s, d):
    return monitor.failure_rate(executions(s, d), _now(events_log(s, d)), 24 * 60)


@query
def active_workflows(s, d):
    log = events_log(s, d)
    return monitor.active_workflows(log, _now(log), 24 * 60)


@query
def latency_percentiles(s, d):
    return monitor.latency_percentiles(executions(s, d))


@query
def payload_size_alert(s, d):
    e = table(s, d, "stored_events").select(F.col("seq").alias("event_id"), "event_type", "payload")
    return monitor.oversized_payloads(e, 400)


@query
def stale_executions(s, d):
    return monitor.stale(executions(s, d), _now(events_log(s, d))).select("event_id", "reactor_id", "position")


@query
def queue_status(s, d):
    return monitor.queue_status(executions(s, d))


@query
def retention_archive(s, d):
    """Days before a date leave the stored log for the archive; what is on each side afterwards, beside the run's own counts."""
    log = events_log(s, d).withColumns({"event_id": F.col("event_id").cast("string"), "aggregate_id": F.col("aggregate_id").cast("string"), "parent_id": F.col("parent_id").cast("string")})
    store = StoredLog(s, scratch_path(s, "stored"))
    store.emit_output(log, "position")
    store.next_partition("2031-01-01")
    counts = store.archive("2024-01-15", to := scratch_path(s, "archive"))
    old = s.read.schema(SCHEMA + ", day date").parquet(to) if counts["archived"] else store.table().limit(0)
    rows = store.table().select(F.lit("keep").alias("side"), "event_type").unionByName(old.select(F.lit("archive").alias("side"), "event_type"))
    total = F.when(F.col("side") == "keep", F.lit(counts["kept"])).otherwise(F.lit(counts["archived"])).cast("bigint")
    return rows.groupBy("side", "event_type").agg(F.count("*").alias("n")).withColumn("n_side", total)


@query
def stored_correlations(s, d):
    """The correlation list over the stored log itself: rows, first and last time, by canonical correlation."""
    from loomlog.functions.ids import id_text

    e = table(s, d, "stored_events").select(id_key("correlation_id").alias("k"), "ts", "seq", "event_type").filter("k is not null")
    c = e.groupBy("k").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return c.select(id_text("k").alias("correlation_id"), "n", "first_ts", "last_ts")


# --- the stored queue ----------------------------------------------------------------------------------------------


def _commits(s, d) -> DataFrame:
    """The stored commits; repeated rows count once."""
    return table(s, d, "intent_commits").dropDuplicates(["event_id"])


@query
def commit_intents(s, d):
    """Queued work per reactor and priority."""
    return Q.intents(_commits(s, d)).groupBy("reactor_id", "priority").agg(
        F.count("*").alias("n"), F.min("execute_at").alias("earliest_at"), F.max("hops").alias("max_hops"), F.max("timeout_seconds").alias("longest_timeout")
    )


@query
def commit_descriptions(s, d):
    """The newest description of each correlation and reactor; of commits at one checkpoint the greater text."""
    x = Q.descriptions(_commits(s, d))
    return dataflow.last_status(x.groupBy("correlation_id", "reactor_id", "at").agg(F.max("description").alias("description")), ["correlation_id", "reactor_id"], "at", ["description"])


@query
def commit_parked(s, d):
    return _commits(s, d).groupBy(F.coalesce("park_reason", F.lit("none")).alias("park_reason")).agg(F.count("*").alias("n"))


@query
def commit_projection_failures(s, d):
    """Failures of projections, recorded and not fatal."""
    f = _commits(s, d).select(F.explode("projection_failures").alias("failure"))
    return f.groupBy(F.substring_index("failure", ":", 1).alias("projection")).agg(F.count("*").alias("n"))


@query
def commit_checkpoint(s, d):
    """Where the queue stands after it took the commits."""
    q = Q.Queue(s, scratch_path(s, "queue"))
    q.enqueue("all", table(s, d, "intent_commits"))
    return s.createDataFrame([(q.checkpoint(),)], "checkpoint bigint")


def _taken(s, d) -> Q.Queue:
    """A queue that took the stored commits; intents of priority 1 completed, those of five attempts and more than five hops
    are dead, others of five attempts are to be retried."""
    q = Q.Queue(s, scratch_path(s, "queue"))
    q.enqueue("all", table(s, d, "intent_commits"))
    i = q.read("intents").dropDuplicates(["event_id", "reactor_id"])
    status = F.when(F.col("priority") == 1, "complete").when((F.col("max_attempts") == 5) & (F.col("hops") > 5), "dead_letter").when(F.col("max_attempts") == 5, "retry")
    moves = i.select("event_id", "reactor_id", F.lit(1).cast("bigint").alias("at"), status.alias("status"), F.col("max_attempts").alias("attempts"), F.lit("gave up").alias("error"))
    q.resolve("done", moves.filter("status is not null"))
    return q


@query
def queue_statuses(s, d):
    """Stored executions by status after a round of results."""
    return _taken(s, d).statuses().groupBy("reactor_id", "status").agg(F.count("*").alias("n"), F.max("attempts").alias("most_attempts"))


@query
def queue_pending(s, d):
    """What is left to run, and what is dead, per reactor."""
    q = _taken(s, d)
    left = q.pending().groupBy("reactor_id").agg(F.count("*").alias("n_pending"), F.min("execute_at").alias("earliest_at"))
    dead = q.dead_letters().groupBy("reactor_id").agg(F.count("*").alias("n_dead"))
    return left.join(dead, "reactor_id", "full_outer").select("reactor_id", F.coalesce("n_pending", F.lit(0)).cast("bigint").alias("n_pending"), "earliest_at", F.coalesce("n_dead", F.lit(0)).cast("bigint").alias("n_dead"))


@query
def queue_reclaim(s, d):
    """Pending work whose timeout had passed when the last commit's work could run."""
    q = _taken(s, d)
    now = q.read("intents").agg(F.max("execute_at")).first()[0]
    return q.reclaim(now).select("event_id", "reactor_id", "execute_at") if now is not None else q.pending().select("event_id", "reactor_id", "execute_at")


@query
def stateful_filter(s, d):
    """Events a reactor accepts by the state as of the event: purchases of users with three errors or more so far."""
    st = _user_states(s, d).select("aggregate_id", "position", "n_errors")
    probes = events_log(s, d).filter("event_type = 'activity:purchase'").select("event_id", "correlation_id", "aggregate_id", "position")
    return ordered.latest(probes, st, ["aggregate_id"], "position", ["n_errors"]).filter("n_errors >= 3").select("event_id", "correlation_id", "n_errors")


@query
def state_at_ephemeral(s, d):
    """The state that ephemeral events see: that of the last folded event of their user, none before the first."""
    st = _user_states(s, d).select("aggregate_id", "position", "n_events", "last_type")
    probes = events_log(s, d).filter("not persistent").select("position", "aggregate_id")
    return ordered.latest(probes, st, ["aggregate_id"], "position", ["n_events", "last_type"])


@query
def flow_selection(s, d):
    return inspect.flow_selection(events_log(s, d), reactor_id="on_error_1").select("position", "event_id", "event_type")


@query
def stored_outcomes(s, d):
    """Outcomes of the stored executions per reactor; repeated rows count once."""
    o = table(s, d, "reactor_outcomes").dropDuplicates(["outcome_no"])
    return o.groupBy("reactor_id").agg(
        F.count("*").alias("n"), F.sum("attempts").alias("attempts"), F.count_if(F.col("status") == "error").alias("n_errors"),
        F.min("started_at").alias("first_start"), F.max(F.when(F.col("status") == "completed", F.col("completed_at"))).alias("last_end"),
    )
