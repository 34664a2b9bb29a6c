"""The engine's declarations: ids, start-up hooks, handles, states and errors."""

import pytest
from loomlog.functions import api
from loomlog.sources import spi
from loomlog.operators.inspect import ReadModel
from loomlog.streaming.projections import CatchUpTail, PollTail
from pyspark.sql import functions as F

EVENTS = "event_id string, correlation_id string, event_type string, payload string"


def made(id="a", **k):
    @api.reactor(id, **k)
    def fn(value, ctx):
        return None

    return fn


def test_ids_are_checked_over_reactors_and_projections(spark):
    @api.projection("a")
    def p(value, ctx):
        return None

    for second in (made("a"), p, made(" "), made(None, background=True)):
        with pytest.raises(ValueError):
            api.Engine(spark).add(made("a"), second)
    assert [r.id for r in api.Engine(spark).add(made(None), made("b", background=True), made("c")).registry.reactors] == ["auto_fn", "b", "c"]


def test_hooks_run_once_in_order_and_stop_the_start(spark):
    seen = []
    engine = api.Engine(spark, {"x": 1}).add(made("a", init=lambda d: seen.append(("a", d["x"]))), made("b"), made("c", init=lambda d: seen.append(("c", d["x"]))))
    engine.start()
    engine.start()
    assert seen == [("a", 1), ("c", 1)]

    def fails(deps):
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        api.Engine(spark).add(made("a", init=fails)).emit(spark.createDataFrame([("1", "c", "t", "{}")], EVENTS)).settled()


def test_a_handle_in_time_and_out_of_time(spark):
    @api.reactor("loop", on=("t",))
    def loop(value, ctx):
        return ("t", {"n": value["n"] + 1}) if value["n"] < 3 else None

    engine = api.Engine(spark).add(loop)
    seed = spark.createDataFrame([("1", "c", "t", '{"n": 0}')], EVENTS)
    h = engine.emit(seed, correlation_id="mine")
    with pytest.raises(TimeoutError):
        h.settled(timeout_s=0)
    assert h.status() == "pending"
    events, parked = h.settled(timeout_s=600)
    assert h.status() == "settled" and events.count() == 4 and {r["correlation_id"] for r in events.collect()} == {"mine"} and parked.count() == 0
    stopped = engine.emit(seed)
    stopped.cancel()
    assert stopped.settled() is None and stopped.status() == "cancelled"


def test_states_logs_and_errors(spark):
    def fn(value, ctx):
        ctx.debug("a", [1])
        if ctx.aggregate()["n"] == 2:
            raise KeyError("gone")
        return ("x", {"own": ctx.aggregate()["n"], "other": ctx.aggregate("B:9", {"n": -1})["n"]})

    events = spark.createDataFrame([("1", "c", "t", "{}"), ("2", "c", "t", "{}"), ("3", "c", "t", None)], EVENTS)
    states = spark.createDataFrame([("1", "A:1", '{"n": 1}'), ("1", "B:9", '{"n": 5}'), ("2", "A:1", '{"n": 2}')], "event_id string, aggregate_key string, state string")
    got = api.run_reactor(events, "r", fn, states=states)
    rows = {r["event_id"]: r for r in got.collect()}
    assert rows["1"]["children"][0]["payload"] == '{"own": 1, "other": 5}' and rows["2"]["error_type"] == "KeyError" and rows["3"]["status"] == "completed"
    assert [(r["event_id"], r["level"], r["data"]) for r in api.log_rows(got).orderBy("event_id").collect()] == [("1", "debug", "[1]"), ("2", "debug", "[1]")]
    assert [r["event_id"] for r in api.errors_of(got, KeyError, ["event_id"]).collect()] == ["2"]


def test_backends_fit_their_protocols():
    for protocol, cls in ((spi.InspectorReadModel, ReadModel), (spi.TailSource, PollTail), (spi.TailSource, CatchUpTail)):
        assert all(callable(getattr(cls, n)) for n in vars(protocol) if not n.startswith("_"))


def test_downcast(spark):
    @api.event("thing:made")
    class Made:
        n: int
        on: bool
        text: str

    df = spark.createDataFrame([("1", "c", "thing:made", '{"n": 1, "on": true, "text": "x", "more": 2}'), ("2", "c", "thing:made", "[]"), ("3", "c", "thing:other", "{}")], EVENTS)
    got = {r["event_id"]: tuple(r)[1:] for r in api.downcast(df, Made, ["event_id"]).collect()}
    assert got == {"1": (1, True, "x"), "2": (None, None, None)} and df.filter(api.is_event(Made)).select(F.count("*")).first()[0] == 2
