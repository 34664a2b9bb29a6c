import time

import pytest
from pyspark.sql import functions as F

from loomlog.functions import api
from loomlog.session import scratch_path
from loomlog.streaming import projections, windows
from loomlog.streaming.pointer import Pointer

SCHEMA = "position bigint, event_id bigint, event_type string, created_at timestamp_ntz, aggregate_id bigint"


@pytest.fixture
def log(spark):
    return spark.range(1, 51).select(
        F.col("id").alias("position"), F.col("id").alias("event_id"), F.concat(F.lit("t"), F.col("id") % 3).alias("event_type"),
        (F.lit("2031-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("id").cast("int"))).alias("created_at"), (F.col("id") % 4).alias("aggregate_id"),
    )


@pytest.fixture
def pointer(spark):
    return Pointer(spark, scratch_path(spark, "pointer"))


def test_replay_promotes(log, pointer):
    seen = []
    assert projections.replay(log, pointer, lambda df, a, b: seen.append((a, b, df.count())), interval=20) == 50
    assert seen == [(0, 20, 20), (20, 40, 20), (40, 50, 10)] and pointer.status()["active"] == 50 and pointer.status()["staged"] is None


def test_replay_fails_fast_and_gates(log, pointer):
    pointer.save(7)

    def apply(df, after, upto):
        if after >= 20:
            raise ValueError("three")

    with pytest.raises(ValueError):
        projections.replay(log, pointer, apply, interval=20)
    assert pointer.status()["active"] == 7 and pointer.status()["staged"] == 20
    with pytest.raises(RuntimeError):
        projections.replay(log, pointer, lambda *a: None, gate=lambda: False)
    assert pointer.position() == 7
    assert projections.replay(log.limit(0), pointer, lambda *a: None) == 0 and pointer.position() == 0


def test_pointer(pointer):
    assert pointer.position() is None
    with pytest.raises(ValueError):
        pointer.promote()
    pointer.stage(5)
    pointer.save(3)
    assert (pointer.status()["active"], pointer.status()["staged"]) == (3, 5)
    pointer.promote()
    assert pointer.position() == 5 and pointer.status()["updated_at"] <= time.time()
    pointer.set(1)
    assert pointer.position() == 1


def test_live_skips_a_failing_batch(spark, log, pointer):
    at = scratch_path(spark, "live")
    for i in range(3):
        log.filter(f"position % 3 = {i}").coalesce(1).write.parquet(f"{at}/log/{i}.parquet")
    pointer.save(10)
    seen = []

    def apply(batch, n):
        if n == 1:
            raise ValueError("skip me")
        seen.extend(r["position"] for r in batch.collect())

    q = projections.live(projections.tail(spark, f"{at}/log/*", log.schema, 1), pointer, apply, f"{at}/checkpoint")
    q.awaitTermination()
    assert pointer.position() == 50 and 0 < len(seen) < 40 and min(seen) > 10


def test_subscription_has_no_gap_and_no_repeat(spark, log):
    missed, live = projections.subscription(log, log, 40, limit=4)
    assert [r["position"] for r in missed.collect()] == [41, 42, 43, 44] and {r["position"] for r in live.collect()} == set(range(45, 51))


def test_windows(spark, log):
    assert windows.counts(log, "created_at", "10 minutes").agg(F.sum("n")).first()[0] == 50
    assert windows.counts(log, "created_at", "10 minutes", "5 minutes").agg(F.sum("n")).first()[0] == 100
    assert windows.sessions(log, "aggregate_id", "created_at", "5 minutes").count() == 4


@api.event("order:placed")
class Placed:
    order_id: str
    total: int = 0


@api.event()
class OrderShipped:
    order_id: str


def test_reactor_closures(spark):
    assert OrderShipped.event_type == "order_shipped" and api.decode("order:placed", '{"order_id":"1","x":2}') == Placed("1") and api.decode("zzz", "[1]") == [1]
    rows = [("1", "c", "order:placed", '{"order_id":"a","total":5}'), ("2", "c", "order:placed", '{"order_id":"b","total":0}'), ("3", "c", "order:placed", "{broken"), ("4", None, "order:placed", '{"order_id":"c","total":-1}'), ("5", "c", "order:placed", None)]

    def react(e, ctx):
        ctx.log("INFO", "got", e.total)
        if e.total < 0:
            raise ValueError("negative")
        return [OrderShipped(e.order_id)] * 2

    got = {r["event_id"]: r for r in api.run_reactor(spark.createDataFrame(rows, "event_id string, correlation_id string, event_type string, payload string"), "ship", react, lambda e: e.total != 0).collect()}
    assert [len(got[i]["children"]) for i in "12345"] == [2, 0, 0, 0, 0] and got["4"]["status"] == "error" and got["4"]["error"] == "ValueError: negative"
    assert got["1"]["logs"][0]["level"] == "info" and got["1"]["children"][0]["event_type"] == "order_shipped"


def test_journal_and_blocks():
    calls = []
    first = api.Context("e", "r", "c")
    assert first.run(lambda: calls.append(1) or 5) == 5
    again = api.Context("e", "r", "c", journal=first.journal)
    assert again.run(lambda: calls.append(1) or 6) == 5 and again.run(lambda: 7) == 7 and len(calls) == 1
    assert api.block("progress", label="x", fraction=3.0)["fraction"] == 1.0
    with pytest.raises(ValueError):
        api.block("nope", a=1)
    h = api.Handle("c", lambda: 9)
    assert h.status() == "pending" and h.settled() == 9 and h.status() == "settled"
    assert api.emitted(None) == [] and api.emitted(1) == [1] and api.emitted((1, 2)) == [1, 2]
