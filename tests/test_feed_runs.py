from datetime import timedelta

import pytest
from test_incremental import EVENTS, POINTERS, T, ev

import __spark_entry__ as entry
from loomlog.operators import incremental

DATA = "/root/testdata/sf0.001"


def test_a_low_row_between_plan_and_promotion_comes_next(spark):
    pointers = spark.createDataFrame([("p", 0, 2, None, T)], POINTERS)
    events = spark.createDataFrame([ev(1, "a", "a", late=-9), ev(5, "e", "e"), ev(9, "i", "i")], EVENTS)
    feed = incremental.ChangeFeed(spark)
    feed.plan(0, pointers, events)
    grown = events.unionByName(spark.createDataFrame([ev(4, "d", "d", late=6), ev(1, "z", "z", late=20)], EVENTS))  # readable at T + 10 h and T + 21 h
    feed.deliver(0, feed.captured(0, pointers, grown))
    pointers = pointers.unionByName(feed.positions(0, T + timedelta(hours=200)))
    feed.deliver(1, feed.captured(1, pointers, grown))
    assert sorted((r["seq"], bytes(r["key"])[:1]) for r in feed.sink().collect()) == [(1, b"z"), (4, b"d"), (5, b"e"), (9, b"i")]
    last = feed.captured(2, pointers.unionByName(feed.positions(1, T + timedelta(hours=300))), grown)
    assert last.count() == 0


def test_two_runs_deliver_what_one_would(spark):
    rows = lambda name: sorted((r["pointer_name"], r["seq"]) for r in entry.queries()[name](spark, DATA).collect())
    assert rows("p5_runs") == rows("p5_found") != []


@pytest.mark.parametrize("bound", [1000, 0])
def test_rows_without_ingested_at(spark, bound):
    pointers = spark.createDataFrame([("p", 0, 2, None, T), ("p", 1, 2, None, T)], POINTERS)
    events = [ev(5, "e", "e"), (6, "f", "f", None, 0, ""), (1, "b", "b", None, 0, ""), (7, "g", "g", None, 1, ""), (2, "h", "h", None, 1, "")]
    events = spark.createDataFrame(events, EVENTS)
    feed = incremental.ChangeFeed(spark)
    rows = incremental.capture(feed.plan(0, pointers, events), events, bound)
    assert sorted(r["seq"] for r in rows.collect()) == [5, 6, 7]
    feed.deliver(0, rows)
    moved = pointers.unionByName(feed.positions(0, T + timedelta(hours=200)))
    assert feed.captured(1, moved, events).count() == 0
