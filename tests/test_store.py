from datetime import datetime, timedelta

from pyspark.sql import functions as F

from loomlog.operators import dataflow
from loomlog.session import scratch_path
from loomlog.sources import log as L
from loomlog.sources.queue import Queue
from loomlog.sources.store import StoredLog
from loomlog.streaming import projections

T = datetime(2031, 1, 1)
NEW = "event_id string, parent_id string, correlation_id string, event_type string, payload string, created_at timestamp_ntz, aggregate_type string, aggregate_id string, metadata map<string,string>, persistent boolean"


def batch(spark, ids):
    return spark.createDataFrame([(f"e{i:03}", None, "c", "t", "{}", T + timedelta(hours=i), "A" if i % 2 else None, str(i % 4) if i % 2 else None, None, True) for i in ids], NEW)


def test_stored_log(spark):
    log = StoredLog(spark, scratch_path(spark, "log"))
    assert log.latest_position() == 0
    assert log.append(batch(spark, range(30)), "event_id") == 30
    assert log.append(batch(spark, range(20, 40)), "event_id") == 10
    assert log.append(batch(spark, range(40)), "event_id") == 0
    rows = log.table().orderBy("position").collect()
    assert [r["position"] for r in rows] == list(range(1, 41)) and [r["event_id"] for r in rows] == [f"e{i:03}" for i in range(40)]
    assert [r["version"] for r in log.load_stream("A", "1").orderBy("position").collect()] == list(range(1, 11))
    assert all(r["version"] is None for r in rows if r["aggregate_id"] is None)
    assert [r["position"] for r in log.load_from(38, 5).collect()] == [39, 40]
    page, cursor = L.page(log.table(), 15)
    assert cursor == 26 and L.page(log.table(), 15, cursor=11)[1] is None and len(page) == 15
    assert projections.run_to_table(spark, log.stream(1).select("position"), "tail").count() == 40
    assert "day" in log.table().columns and log.table().select("day").distinct().count() == 2


COMMITS = "event_id string, correlation_id string, intents array<struct<reactor_id:string,execute_at:timestamp_ntz,timeout_seconds:int,max_attempts:int,priority:int,hops:int>>, reactor_descriptions string, aggregate_snapshots string, checkpoint bigint"


def test_queue(spark):
    q = Queue(spark, scratch_path(spark, "queue"))
    assert q.checkpoint() == 0 and q.pending().count() == 0
    rows = [
        ("e1", "c1", [("r1", T, None, None, 1, None), ("r2", T + timedelta(hours=1), 5, 3, None, 2)], '{"r1": [1], "r2": []}', '{"A:1": {"n": 1}}', 7),
        ("e2", "c1", [("r1", T + timedelta(hours=2), 60, 2, None, None), None], "{broken", None, 9), ("e3", None, None, None, '{"A:1": {"n": 2', None), ("e4", "c2", [], None, "null", 8),
    ]
    commits = spark.createDataFrame(rows + rows[:1], COMMITS)
    q.enqueue("b1", commits)
    q.enqueue("b1", commits)  # made again after a failure
    assert q.checkpoint() == 9 and q.pending().count() == 3 and q.read("descriptions").count() == 2 and q.read("states").count() == 1
    assert q.earliest_pending() == T and {r["reactor_id"] for r in q.reclaim(T + timedelta(hours=1, seconds=30)).collect()} == {"r1", "r2"}
    moves = [("e1", "r1", 1, "complete", 1, None), ("e1", "r2", 1, "retry", 1, "x"), ("e2", "r1", 1, "retry", 1, "x"), ("e2", "r1", 2, "dead_letter", 2, "boom"), ("zz", "r1", 1, "retry", 1, None)]
    assert q.resolve("b2", spark.createDataFrame(moves, "event_id string, reactor_id string, at bigint, status string, attempts int, error string")) == 1
    left = q.pending().collect()
    assert [(r["event_id"], r["reactor_id"], r["attempts"]) for r in left] == [("e1", "r2", 1)]
    assert [(r["event_id"], r["error"]) for r in q.dead_letters().collect()] == [("e2", "boom")]
    notes = spark.createDataFrame([("e1", "r1", 0, "1"), ("e1", "r2", 0, "2"), ("e1", "r2", 0, "3"), ("e1", "r2", 1, "4")], "event_id string, reactor_id string, seq bigint, value string")
    q.commit("b3", journal=notes)
    assert sorted((r["seq"], r["value"]) for r in q.journal().collect()) == [(0, "2"), (1, "4")]


def test_attempt_gate(spark):
    df = spark.createDataFrame([(None,), (3,), (4,)], "attempts int")
    go, park = dataflow.attempt_gate(df)
    assert go.count() == 2 and park.agg(F.max("attempts")).first()[0] == 4
