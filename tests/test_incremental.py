from datetime import datetime, timedelta

import pytest

from loomlog.operators import incremental

T = datetime(2031, 1, 1)
EVENTS = "seq bigint, id string, payload string, ingested_at timestamp_ntz, log_partition int, active string"
POINTERS = "pointer_name string, log_partition int, active bigint, staged bigint, updated_at timestamp_ntz"


def ev(seq, id, payload, late=0, part=0):
    return (seq, id, payload, T + timedelta(hours=seq + late), part, "clash")


@pytest.fixture
def tables(spark):
    u = "018efaf0-d925-4826-8aa1-efe73bcedff0"
    events = [
        ev(1, u, "a"), ev(2, "{" + u.upper() + "}", "a"), ev(3, u, "b"), ev(4, None, "a"), ev(5, None, "a"), ev(6, "x", None), ev(7, "x", None),
        ev(8, u, "a"), ev(2, "late", "z", late=100), ev(9, "y", "q", part=1), ev(10, "y", "q", part=0), ev(11, "", "e"),
    ]
    pointers = [
        ("p", 0, 1, None, T), ("p", 0, 3, None, T + timedelta(hours=50)), ("p", 0, 3, None, T + timedelta(hours=50)), ("p", 0, 99, 99, T + timedelta(hours=60)),
        ("p", 1, 9, None, T + timedelta(hours=50)), ("q", 0, 0, None, T), ("r", 5, 0, None, None),
    ]
    return spark.createDataFrame(pointers, POINTERS), spark.createDataFrame(events, EVENTS)


WANT = {("p", 4), ("p", 5), ("p", 6), ("p", 2), ("p", 11), ("q", 1), ("q", 2), ("q", 3), ("q", 4), ("q", 5), ("q", 6), ("q", 11)}


@pytest.mark.parametrize("bound", [1000, 0])
def test_capture(spark, tables, bound):
    pointers, events = tables
    feed = incremental.ChangeFeed(spark)
    rows = incremental.capture(feed.plan(0, pointers, events), events, bound).collect()
    assert len(rows) == len(WANT) and {(r["pointer_name"], r["seq"]) for r in rows} == WANT


def test_a_failed_run_is_repeated_as_planned(spark, tables):
    pointers, events = tables
    feed = incremental.ChangeFeed(spark)
    first = feed.captured(0, pointers, events)
    feed.deliver(0, first.limit(4))  # part of it arrived before the failure
    grown = events.unionByName(spark.createDataFrame([ev(50, "new", "n")], EVENTS))
    feed.deliver(0, feed.captured(0, pointers, grown))  # the plan is the written one: the new row waits
    got = feed.sink().collect()
    assert len(got) == len(WANT) and {(r["pointer_name"], r["seq"]) for r in got} == WANT and feed.committed(0)
    moved = pointers.unionByName(feed.positions(0, T + timedelta(hours=200)))
    nxt = feed.captured(1, moved, grown).collect()
    assert {(r["pointer_name"], r["seq"]) for r in nxt} == {("p", 50), ("q", 50)} and not feed.committed(1)


def test_empty(spark, tables):
    pointers, events = tables
    feed = incremental.ChangeFeed(spark)
    assert feed.captured(0, pointers.limit(0), events).count() == 0
    assert feed.captured(1, pointers, events.limit(0)).count() == 0
