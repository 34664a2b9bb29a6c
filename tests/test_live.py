"""Live projections skip single events; batches by count or age; nodes that take over each other's events; tail sources."""

import time

from loomlog.sources.store import SCHEMA, StoredLog
from loomlog.streaming import projections as P
from loomlog.streaming.pointer import Pointer
from pyspark.sql import functions as F

LOG = "position bigint, event_id string, payload string"


def test_one_bad_event_of_a_hundred(spark, tmp_path):
    rows = [(i, f"e{i}", "bad" if i in (37, 38, 99) else "1") for i in range(1, 101)]
    spark.createDataFrame(rows, LOG).repartition(1).write.parquet(f"{tmp_path}/log")
    pointer, out, lost = Pointer(spark, f"{tmp_path}/p"), P.sink(f"{tmp_path}/rows"), P.sink(f"{tmp_path}/lost")

    def apply(batch, label):
        out(batch.select("position", F.col("payload").cast("int").alias("v")), label)  # ANSI: a bad payload fails the write

    q = P.live(P.tail(spark, f"{tmp_path}/log", spark.read.parquet(f"{tmp_path}/log").schema), pointer, apply, f"{tmp_path}/c", skipped=lost)
    q.awaitTermination()
    got = sorted(r["position"] for r in spark.read.parquet(f"{tmp_path}/rows").collect())
    skipped = spark.read.parquet(f"{tmp_path}/lost").select("position", "error").collect()
    assert got == [i for i in range(1, 101) if i not in (37, 38, 99)] and pointer.position() == 100
    assert sorted(r["position"] for r in skipped) == [37, 38, 99] and all(r["error"] for r in skipped)


def test_batches_by_count_or_age(spark, tmp_path):
    first = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 9)], "k string, at bigint")
    first.repartition(1).write.mode("append").parquet(f"{tmp_path}/in")
    s = P.batched(P.tail(spark, f"{tmp_path}/in", first.schema), "k", "at", 2, 1000, ["at"])
    q = s.writeStream.outputMode("append").foreachBatch(P.sink(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="300 milliseconds").start()
    end, got = time.time() + 60, {}
    while time.time() < end and len(got) < 4:
        time.sleep(0.5)
        try:
            got = {(r["k"], r["batch_no"]): [x["at"] for x in r["rows"]] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
        except Exception:  # noqa: BLE001 (nothing written yet)
            pass
    q.stop()
    assert got == {("a", 0): [0, 1], ("a", 1): [2, 3], ("a", 2): [4], ("b", 0): [9]}  # the last two by age


def test_nodes_take_over_events_once(spark, tmp_path):
    rows = [(None, f"e{i}", None, "c", "t", "{}", None, "User", str(i % 3), {}, True, None) for i in range(9)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("created_at", F.expr("timestamp_ntz'2031-01-01 00:00:00'")).withColumn("day", F.to_date("created_at"))
    store, touched = StoredLog(spark, f"{tmp_path}/log"), []
    each = P.synchronised(store, lambda t, n: touched.append(sorted(r["aggregate_id"] for r in t.collect())), "event_id")
    each(df.filter("event_id < 'e5'"), 0)
    each(df, 1)
    each(df.filter("event_id = 'e1'"), 2)
    got = store.table().orderBy("position").collect()
    assert [r["event_id"] for r in got] == [f"e{i}" for i in range(9)] and [r["position"] for r in got] == list(range(1, 10))
    assert sorted((r["aggregate_id"], r["version"]) for r in got) == [(str(a), v) for a in range(3) for v in (1, 2, 3)] and touched == [["0", "1", "2"], ["0", "1", "2"], []]


def test_tail_sources(spark, tmp_path):
    log = spark.createDataFrame([(i, f"e{i}", "x") for i in range(1, 11)], LOG)
    log.write.parquet(f"{tmp_path}/log")
    spark.createDataFrame([(3,), (7,), (99,)], "position bigint").write.parquet(f"{tmp_path}/notes")
    notes = P.tail(spark, f"{tmp_path}/notes", spark.read.parquet(f"{tmp_path}/notes").schema)
    source = P.NotifyTail(notes, spark.read.parquet(f"{tmp_path}/log"))
    seen, lost = {"a": []}, []
    take = {"b": lambda b, n: 1 / 0, "a": lambda b, n: seen["a"].extend(r["position"] for r in b.collect())}
    q = source.stream().writeStream.foreachBatch(P.fan_out(take, lambda *x: lost.append(x[0]))).option("checkpointLocation", f"{tmp_path}/c").trigger(**source.trigger()).start()
    q.awaitTermination()
    assert sorted(seen["a"]) == [3, 7] and lost == ["b"]
    assert P.PollTail(spark, f"{tmp_path}/log", log.schema, 0.5).trigger() == {"processingTime": "500 milliseconds"}


def test_replay_in_steps_reads_each_event_once(spark, tmp_path):
    log = spark.createDataFrame([(i, f"e{i}", "x") for i in range(1, 102)], LOG)
    got, p = [], Pointer(spark, f"{tmp_path}/p")
    P.replay(log, p, lambda rows, a, b: got.append((a, b, sorted(r["position"] for r in rows.collect()))), interval=25)
    assert [(a, b) for a, b, _ in got] == [(0, 25), (25, 50), (50, 75), (75, 100), (100, 101)] and all(r == list(range(a + 1, b + 1)) for a, b, r in got) and p.position() == 101
