"""Behaviour of log, folds, dataflow, graph and inspector on small cases."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomlog.functions import text
from loomlog.operators import dataflow, fold, graph, inspect, monitor
from loomlog.operators.dataflow import Reactor, Registry
from loomlog.sources import log as L

T = datetime(2031, 1, 1)
LOG = (
    "position bigint, event_id bigint, parent_id bigint, correlation_id string, event_type string, payload string, created_at timestamp_ntz, "
    "value double, aggregate_type string, aggregate_id bigint, version bigint, reactor_id string, persistent boolean"
)


def make(spark, n=60, seed=1):
    rng, versions, rows = random.Random(seed), {}, []
    for i in range(n):
        a = rng.randrange(4)
        versions[a] = versions.get(a, 0) + 1
        parent = rng.randrange(i) if i and rng.random() < 0.7 else None
        kind = rng.choice(["order:placed", "order:shipped", "note"])
        rows.append((3 * i + 1, i, parent, f"c{a}", kind, json.dumps({"k": i}), T + timedelta(minutes=i), float(i % 7), "Order", a, versions[a], "r" if parent is not None else None, True))
    return spark.createDataFrame(rows, LOG), rows


def test_reads(spark):
    log, rows = make(spark)
    assert [r["position"] for r in L.load_from(log, 10, 3).collect()] == [13, 16, 19]
    assert L.latest_position(log.limit(0)).first()[0] == 0
    assert L.load_from(log, 10**9, 5).count() == 0
    page = L.list_events(log, 10**6, cursor=100, search="PLACED%").count()
    assert page == 0  # the term is taken literally
    got = L.list_events(log, 5, since=str(T + timedelta(minutes=10)), until=str(T + timedelta(minutes=20))).collect()
    assert [r["event_id"] for r in got] == [20, 19, 18, 17, 16]


def test_append_is_idempotent_and_contiguous(spark):
    log, rows = make(spark)
    have = log.filter("position <= 100")
    new = log.select("event_id", "event_type", "aggregate_type", "aggregate_id", "created_at")
    got = L.append(have, new.unionByName(new), "event_id").collect()
    known = {r[1] for r in rows if r[0] <= 100}
    assert {r["event_id"] for r in got} == {r[1] for r in rows} - known
    assert sorted(r["position"] for r in got) == list(range(101, 101 + len(got)))
    assert {(r["event_id"], r["version"]) for r in got} == {(r[1], r[10]) for r in rows if r[1] not in known}
    assert L.append(log, new, "event_id").count() == 0


FOLD = lambda: fold.Fold(["aggregate_id"], "position", {
    "n": fold.Field("count"), "total": fold.Field("sum", value=F.col("value"), when=F.col("event_type") == "order:placed"),
    "status": fold.Field("last", value=F.col("event_type"), default="none"), "shipped": fold.Field("ever", when=F.col("event_type") == "order:shipped"),
    "top": fold.Field("max", value=F.col("value")),
})


def test_tiers_of_folds_agree(spark):
    log, rows = make(spark)
    final = {r["aggregate_id"]: (r["n"], r["total"], r["status"]) for r in FOLD().final(log).collect()}
    running = FOLD().running(log, ["aggregate_id", "position", "version"])
    last = {r["aggregate_id"]: (r["n"], r["total"], r["status"]) for r in running.groupBy("aggregate_id").agg(*(F.max_by(c, "version").alias(c) for c in ("n", "total", "status"))).collect()}

    def step(s, e):
        return F.struct((s["n"] + 1).alias("n"), (s["total"] + F.when(e["event_type"] == "order:placed", e["value"]).otherwise(0.0)).alias("total"), e["event_type"].alias("status"))

    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("total"), F.lit("none").alias("status"))
    hof = {r["aggregate_id"]: (r["state"]["n"], r["state"]["total"], r["state"]["status"]) for r in fold.fold_sorted(log, ["aggregate_id"], "position", ["event_type", "value"], start, step).collect()}

    def apply(s, e):
        return {"n": s["n"] + 1, "total": s["total"] + (e["value"] if e["event_type"] == "order:placed" else 0.0), "status": e["event_type"]}

    py = {r["aggregate_id"]: (r["n"], r["total"], r["status"]) for r in fold.fold_python(log, ["aggregate_id"], "position", apply, lambda: {"n": 0, "total": 0.0, "status": "none"}, "n bigint, total double, status string").collect()}
    assert final == last == hof == py


@pytest.mark.parametrize("n", [1, 3, 7, 100])
def test_a_snapshot_at_any_version_changes_nothing(spark, n):
    log, _ = make(spark)
    snaps = fold.every(FOLD().running(log, ["aggregate_id", "position", "version"]), n)
    snaps = snaps.groupBy("aggregate_id").agg(F.max(F.struct("version", "n", "total", "status", "shipped", "top")).alias("s")).select("aggregate_id", "s.*")
    key = lambda df: {tuple(r) for r in df.select("aggregate_id", "n", "total", "status", "shipped", "top").collect()}
    assert key(FOLD().seeded(snaps, log)) == key(FOLD().final(log))


def test_split_folds_equal_running_ones(spark):
    log, _ = make(spark, 400, 9)
    log = log.withColumn("aggregate_id", F.when(F.col("event_id") % 3 > 0, 7).otherwise(F.col("aggregate_id")))  # one key has two thirds
    f = FOLD()
    f.fields["none"] = fold.Field("last", value=F.when(F.col("event_id") < 0, F.lit("x")))
    key = lambda df: sorted(map(str, df.collect()))
    assert key(f.running(log)) == key(f.running_split(log, parts=7))
    assert f.running_split(log.limit(0), parts=3).count() == 0


def test_percentiles(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.7 else rng.choice("ab"), rng.choice([None, *range(20)])) for _ in range(900)] + [("one", 5), (None, 1), ("nulls", None)]
    df = spark.createDataFrame(rows, "g string, v int")
    ps = {"p0": 0.0, "p33": 0.33, "p50": 0.5, "p100": 1.0}
    want = {r["g"]: [r["p"][i] for i in range(4)] for r in df.filter("g is not null and v is not null").groupBy("g").agg(F.percentile("v", list(ps.values())).alias("p")).collect()}
    got = {r["g"]: [r[n] for n in ps] for r in monitor.percentiles(df, "g", "v", ps, 5).collect()}
    assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g]) for g in want)


def test_transition_fires_once(spark):
    rows = [(i, 1, k) for i, k in enumerate(["draft", "placed", "placed", "shipped", "placed"])]
    df = spark.createDataFrame(rows, "position bigint, aggregate_id bigint, event_type string")
    f = fold.Fold(["aggregate_id"], "position", {"status": fold.Field("last", value=F.col("event_type"), default="draft")})
    got = f.transitions(df, lambda prev, nxt: (prev("status") != "placed") & (nxt("status") == "placed"), [])
    assert [r["position"] for r in got.orderBy("position").collect()] == [1, 4]


def test_islands(spark):
    log, rows = make(spark, 200, 4)
    want, at = [], None
    for r in rows:
        if r[3] != at:
            want.append([r[3], r[0], r[0], 0, None])
            at = r[3]
        want[-1][2], want[-1][3] = r[0], want[-1][3] + 1
        if r[11] is None and want[-1][4] is None:
            want[-1][4] = r[4]
    got = fold.islands(log.repartition(3), "correlation_id", "position").collect()
    assert sorted(tuple(r) for r in got) == sorted(map(tuple, want))


def test_registry(spark):
    r = Registry().add(Reactor("a", ("order",))).add(Reactor("b", ("note", "order:placed"))).add(Reactor("c"))
    for bad in (Reactor("a"), Reactor("")):
        with pytest.raises(ValueError):
            r.add(bad)
    log, rows = make(spark, 30)
    got = {(x["event_id"], x["reactor"]) for x in dataflow.route(log, r.routes(spark)).collect()}
    want = {(e[1], "c") for e in rows} | {(e[1], "a") for e in rows if e[4] != "note"} | {(e[1], "b") for e in rows if e[4] in ("note", "order:placed")}
    assert got == want


def test_retries(spark):
    x = spark.createDataFrame([(1, "r", T)], "event_id bigint, reactor_id string, started_at timestamp_ntz")
    got = dataflow.retry_schedule(x, 3, 10).orderBy("attempt").collect()
    assert [r["wait_s"] for r in got] == [0, 10, 10, 20] and [r["offset_s"] for r in got] == [0, 10, 20, 40] and got[-1]["dead_after"]
    again = dataflow.retry_schedule(x, 5, 3).orderBy("attempt").collect()
    waits = [r["wait_s"] for r in again]
    assert [r["offset_s"] for r in again] == [sum(waits[: i + 1]) for i in range(6)]


SEED = "event_id string, parent_id string, correlation_id string, event_type string, payload string, hops int"


def test_settle_stops_a_loop_at_the_hop_limit(spark):
    def react(g):
        return dataflow.emit(g.withColumn("reactor_id", F.lit("self")), F.array(F.struct(F.lit("again").alias("event_type"), F.lit("{}").alias("payload"))))

    done, parked = dataflow.settle(spark.createDataFrame([("e", None, "c", "again", "{}", 0)], SEED), react, max_hops=52)
    assert done.count() == dataflow.MAX_HOPS + 1 and parked.count() == 1


def test_emission_is_deterministic(spark):
    x = spark.createDataFrame([("e", "r", "c", 4)], "event_id string, reactor_id string, correlation_id string, hops int")
    kids = F.array(*(F.struct(F.lit(t).alias("event_type"), F.lit("{}").alias("payload")) for t in ("a", "b")))
    one, two = dataflow.emit(x, kids).collect(), dataflow.emit(x, kids).collect()
    assert one == two and len({r["event_id"] for r in one}) == 2 and {r["hops"] for r in one} == {5} and one[0]["metadata"]["_hops"] == "5"
    assert dataflow.emit(x, F.array().cast("array<struct<event_type:string,payload:string>>")).count() == 0
    stamped = dataflow.stamp(dataflow.emit(x, kids), {"run": "7", "reactor_id": "z"}).first()["metadata"]
    assert stamped["run"] == "7" and stamped["reactor_id"] == "r"


def test_cancellation_lasts_its_time(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "correlation_id string, n int")
    c = spark.createDataFrame([("a", T), ("b", T - timedelta(hours=2))], "correlation_id string, cancelled_at timestamp_ntz")
    now = F.lit(T).cast("timestamp_ntz")
    assert {r["n"] for r in dataflow.not_cancelled(rows, c, now).collect()} == {2, 3}
    assert {r["n"] for r in dataflow.cancelled(rows, c, now).collect()} == {1}


def test_batch_function(spark):
    df = spark.createDataFrame([(1,), (2,)], "k int")
    ok = dataflow.batched(df, lambda p: p.assign(v=p.k * 2), "k int, v int").collect()
    assert {(r["k"], r["v"], r["error"]) for r in ok} == {(1, 2, None), (2, 4, None)}

    def boom(p):
        raise ValueError("no")

    assert {r["error"] for r in dataflow.batched(df, boom, "k int, v int").collect()} == {"no"}


def test_subtree_and_tree(spark):
    rows = [(i + 1, i, p, "c" if i < 5 else None, "t", "{}", T, 0.0, "A", 1, i + 1, None, True) for i, p in enumerate([None, 0, 1, 0, 99, None])]
    log = spark.createDataFrame(rows, LOG)
    assert {(r["event_id"], r["level"]) for r in graph.subtree(log, 1).collect()} == {(0, 0), (1, 1), (3, 1), (2, 2)}
    assert {r["event_id"] for r in graph.roots(log).collect()} == {0, 4, 5}
    assert graph.lineage_tree(log, 77).count() == 0 and graph.lineage_tree(log, 6).count() == 0
    assert {r["root_position"] for r in graph.lineage_tree(log, 3).collect()} == {1}


def test_empty_log(spark):
    log, _ = make(spark)
    none = log.limit(0)
    x = spark.createDataFrame([], "event_id bigint, reactor_id string, correlation_id string, started_at timestamp_ntz, status string, completed_at timestamp_ntz, error string, attempts int")
    for df in (inspect.list_correlations(none, x), inspect.reactor_outcomes(x), inspect.reactor_dependencies(none, x), graph.flow_edges(none), graph.critical_paths(none), fold.islands(none, "correlation_id", "position"), monitor.queue_status(x)):
        assert df.count() == 0
    assert monitor.failure_rate(x, F.lit(T).cast("timestamp_ntz")).first()["failure_rate"] is None


def test_texts(spark):
    one = spark.range(1)
    v = lambda c: one.select(c.alias("v")).first()["v"]
    assert v(text.snake_case(F.lit("HTTPServerV"))) == "http_server_v" == text.durable_name("HTTPServerV")
    assert [v(text.duration(F.lit(x).cast("double"))) for x in (0.2, 12, 1500, 90_000)] == ["<1ms", "12ms", "1.5s", "1.5m"]
    diff = text.json_diff(F.lit('{"a":1,"b":[1],"d":0}'), F.lit('{"b":[2],"c":null,"d":0}'))
    assert v(diff) == ["-a", "~b", "+c"]
    assert v(text.json_diff(F.lit(None), F.lit('{"a":1}'))) == ["+a"] and v(text.json_diff(F.lit("{"), F.lit(None))) == []
    assert v(text.fraction(F.lit(5), F.lit(2))) == 1.0 and v(text.fraction(F.lit(1), F.lit(0))) == 0.0
    p = one.select(F.lit(json.dumps({"type": "x", "b": "y" * 70, "a": 1})).alias("p"))
    assert p.select(inspect.compact_payload("p", 200).alias("v")).first()["v"] == '{ b: "' + "y" * 57 + '...", a: 1 }'
    assert p.select(inspect.compact_payload("p", 20).alias("v")).first()["v"] == "{ ... }"


def test_upcasters(spark):
    steps = [("order", 1, '{"op": "set", "field": "currency", "value": "USD"}'), ("order", 2, '{"op": "rename", "from": "total", "to": "sum.amount"}'),
             ("order", 0, '{"op": "drop", "field": "old"}'), ("note", 0, '{"op": "cast", "field": "n", "to": "string"}')]
    up = text.upcaster(steps)
    rows = [("order:placed", None, '{"total":5,"currency":"EUR","old":1}'), ("order:placed", 2, '{"total":5,"currency":"EUR"}'), ("note", 0, '{"n":7}'), ("order:placed", 0, "{broken"), (None, 0, None), ("x", 0, '{"a": 1}')]
    got = [r["p"] for r in spark.createDataFrame(rows, "t string, v int, p string").coalesce(1).select(up("t", "v", "p").alias("p")).collect()]
    assert got == ['{"currency":"USD","sum":{"amount":5}}', '{"currency":"EUR","sum":{"amount":5}}', '{"n":"7"}', "{broken", None, '{"a": 1}']
