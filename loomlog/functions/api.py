"""The extension surface: events, reactors, aggregators, projections and their context, declared in Python.

A declaration is a row mapping; the engine runs it on Arrow batches, one Python call per event only where a closure is all
there is. Where columns can say it, use ``dataflow.Reactor`` and ``fold.Fold`` instead.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field, is_dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.functions.text import durable_name
from loomlog.operators import dataflow
from loomlog.operators.dataflow import AUTO_ID, Reactor, Registry
from loomlog.operators.fold import fold_python

_types: dict[str, type] = {}


def event(prefix: str | None = None):
    """Register a dataclass as an event; its stored name is the prefix, or its class name in snake case."""

    def wrap(cls):
        cls = cls if is_dataclass(cls) else dataclass(cls)
        cls.event_type = durable_name(cls.__name__, prefix)
        if _types.get(cls.event_type, cls).__qualname__ != cls.__qualname__:
            raise ValueError(f"event type {cls.event_type} is declared twice")
        _types[cls.event_type] = cls
        return cls

    return wrap


def is_type(event_type: str, cls) -> bool:
    return event_type == cls.event_type or event_type.split(":", 1)[0] == cls.event_type


def decode(event_type: str, payload: str, types: dict[str, type] | None = None):
    """The typed event, the raw JSON value where the type is unknown, None where the payload does not fit."""
    types = _types if types is None else types
    cls = types.get(event_type) or types.get(event_type.split(":", 1)[0])
    try:
        value = json.loads(payload)
        if cls is None:
            return value
        known = cls.__dataclass_fields__
        return cls(**{k: v for k, v in value.items() if k in known})
    except (TypeError, ValueError, AttributeError):
        return None


#: Column types of the annotations that events and errors declare; anything else is read as its JSON text.
_SQL = {"int": "bigint", "float": "double", "str": "string", "bool": "boolean"}


def _ddl(cls) -> str:
    name = lambda t: t if isinstance(t, str) else getattr(t, "__name__", "")
    return ", ".join(f"`{n}` {_SQL.get(name(f.type), 'string')}" for n, f in cls.__dataclass_fields__.items())


def is_event(cls, event_type: str = "event_type") -> Column:
    """``is_type`` as a column."""
    return (F.col(event_type) == cls.event_type) | (F.substring_index(event_type, ":", 1) == cls.event_type)


def downcast(events: DataFrame, cls, keep: list[str]) -> DataFrame:
    """The events of a declared class as typed columns; a payload that does not fit has nulls."""
    return events.filter(is_event(cls)).select(*keep, F.from_json("payload", _ddl(cls)).alias("_e")).select(*keep, "_e.*")


def errors_of(executions: DataFrame, cls: type, keep: list[str]) -> DataFrame:
    """The failed executions whose error was raised as ``cls``; a dataclass's fields become typed columns."""
    found = executions.filter(F.col("error_type") == cls.__name__)
    if not is_dataclass(cls):
        return found.select(*keep, "error")
    return found.select(*keep, F.from_json("error_data", _ddl(cls)).alias("_e")).select(*keep, "_e.*")


@dataclass
class Context:
    """What a reactor sees besides its event: ids, dependencies, the states of aggregates at the event, a journal of its
    effects, and a log."""

    event_id: str
    reactor_id: str
    correlation_id: str
    attempt: int = 0
    deps: dict = field(default_factory=dict)
    journal: list = field(default_factory=list)
    logs: list = field(default_factory=list)
    states: dict = field(default_factory=dict)
    own: str | None = None
    _at: int = 0

    @property
    def idempotency_key(self) -> str:
        import uuid

        return str(uuid.uuid5(uuid.NAMESPACE_DNS, f"{self.event_id}-{self.reactor_id}"))

    def aggregate(self, key: str | None = None, default: dict | None = None) -> dict:
        """The state of an aggregate ('type:id') as of the event, of the event's own one without a key; the default where
        nothing was folded yet."""
        text = self.states.get(key or self.own)
        return json.loads(text) if text is not None else dict(default or {})

    def run(self, effect: Callable[[], object]):
        """An effect whose result is journaled: a repeated run replays it by its place in the sequence."""
        at, self._at = self._at, self._at + 1
        if at < len(self.journal):
            return json.loads(self.journal[at])
        value = effect()
        self.journal.append(json.dumps(value))
        return value

    def log(self, level: str, message: str, data=None) -> None:
        self.logs.append((level.lower(), message, None if data is None else json.dumps(data)))

    def debug(self, message: str, data=None) -> None:
        self.log("debug", message, data)

    def info(self, message: str, data=None) -> None:
        self.log("info", message, data)

    def warn(self, message: str, data=None) -> None:
        self.log("warn", message, data)


def emitted(result) -> list:
    """What a reactor returned as a list of events: none, one (an event, or a type name with its payload), or a batch."""
    if result is None:
        return []
    if isinstance(result, tuple) and len(result) == 2 and isinstance(result[0], str) and isinstance(result[1], dict):
        return [result]
    return list(result) if isinstance(result, (list, tuple)) else [result]


_RUN_DDL = (
    "event_id string, reactor_id string, correlation_id string, status string, error string, "
    "children array<struct<event_type:string,payload:string>>, logs array<struct<level:string,message:string,data:string>>, "
    "error_type string, error_data string, journal array<string>"
)


def run_reactor(
    events: DataFrame, reactor_id: str, fn: Callable[[object, Context], object], where: Callable[[object], bool] | None = None,
    deps: dict | None = None, states: DataFrame | None = None, journal: DataFrame | None = None, attempt: int = 0,
) -> DataFrame:
    """Run a closure over events (``event_id, correlation_id, event_type, payload``): one row per execution with its status,
    error, children as an array of (event_type, payload), logs and journal.

    Rows whose payload does not decode, or that the filter rejects, complete without children. ``states``: the states of
    aggregates at events (``event_id, aggregate_key, state`` JSON; the first key of an event is its own aggregate).
    ``journal``: what earlier runs have journaled (``event_id, reactor_id, seq, value``). Both hold few rows per event.
    """
    types = dict(_types)  # workers have not run the declarations
    deps = deps or {}
    key = F.col("event_id").cast("string")
    rows = events.select(key.alias("event_id"), "correlation_id", "event_type", "payload")
    extra = []
    if states is not None:
        of = states.groupBy(key.alias("event_id")).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_set(F.struct("aggregate_key", "state"))))).alias("_states"))
        rows = rows.join(of, "event_id", "left")
        extra.append("_states")
    if journal is not None:
        of = journal.filter(F.col("reactor_id") == reactor_id).groupBy(key.alias("event_id")).agg(F.to_json(F.transform(F.array_sort(F.collect_set(F.struct("seq", "value"))), lambda x: x["value"])).alias("_journal"))
        rows = rows.join(of, "event_id", "left")
        extra.append("_journal")

    def run(pdfs):
        import pandas as pd

        loaded = lambda e, c, none: json.loads(e[c]) if isinstance(e.get(c), str) else none
        for pdf in pdfs:
            out = []
            for e in pdf.to_dict("records"):
                held = loaded(e, "_states", {})
                ctx = Context(str(e["event_id"]), reactor_id, e["correlation_id"], attempt, deps, loaded(e, "_journal", []), states=held, own=next(iter(held), None))
                status, error, kids, kind, data = "completed", None, [], None, None
                value = decode(e["event_type"], e["payload"] or "null", types)
                if value is not None and (where is None or where(value)):
                    try:
                        for c in emitted(fn(value, ctx)):
                            body = asdict(c) if is_dataclass(c) else c[1]
                            kids.append({"event_type": c.event_type if is_dataclass(c) else c[0], "payload": json.dumps(body)})
                    except Exception as x:  # noqa: BLE001
                        status, error, kids, kind = "error", f"{type(x).__name__}: {x}", [], type(x).__name__
                        data = json.dumps(asdict(x), default=str) if is_dataclass(x) else None
                logs = [dict(zip(("level", "message", "data"), r)) for r in ctx.logs]
                out.append((ctx.event_id, reactor_id, e["correlation_id"], status, error, kids, logs, kind, data, ctx.journal))
            yield pd.DataFrame(out, columns=["event_id", "reactor_id", "correlation_id", "status", "error", "children", "logs", "error_type", "error_data", "journal"])

    return rows.select("event_id", "correlation_id", "event_type", "payload", *extra).mapInPandas(run, _RUN_DDL)


def log_rows(executions: DataFrame) -> DataFrame:
    """The logs that executions wrote, a row each, in their order."""
    return executions.select("event_id", "reactor_id", "correlation_id", F.posexplode("logs").alias("nth", "_l")).select("event_id", "reactor_id", "correlation_id", "nth", "_l.*")


def journal_rows(executions: DataFrame) -> DataFrame:
    """What executions journaled, a row each, as the queue keeps it."""
    return executions.select("event_id", "reactor_id", F.posexplode("journal").alias("seq", "value")).withColumn("seq", F.col("seq").cast("bigint"))


# --- declarations --------------------------------------------------------------------------------------------------


def reactor(id: str | None = None, on: tuple = (), where: Callable[[object], bool] | None = None, init: Callable[[dict], None] | None = None, background: bool = False, **limits):
    """Declare a closure (event, context) as a reactor on event classes or type names, or on everything. ``init`` is called
    once with the engine's dependencies before the first event; ``limits`` are fields of ``dataflow.Reactor``."""

    def wrap(fn):
        names = tuple(t if isinstance(t, str) else t.event_type for t in on)
        fn.declared = Reactor(id if id is not None else f"{AUTO_ID}{fn.__name__}", names, background=background, **limits)
        fn.where, fn.init = where, init
        return fn

    return wrap


def projection(id: str, priority: int | None = None, on: tuple = (), init: Callable[[dict], None] | None = None):
    """Declare an observer of persistent events: (event, context) to a row (a dict) for its table, or None."""

    def wrap(fn):
        fn.declared = Reactor(id, tuple(t if isinstance(t, str) else t.event_type for t in on), priority=priority)
        fn.observes, fn.init = True, init
        return fn

    return wrap


def aggregator(kind: str, on: tuple, key: str, default: dict):
    """Declare (state, event) to state as the fold of one aggregate type; ``key`` names the event's field with its id."""

    def wrap(fn):
        fn.aggregate = {"kind": kind, "on": tuple(on), "key": key, "default": default}
        return fn

    return wrap


def run_projections(events: DataFrame, projections: list, deps: dict | None = None) -> DataFrame:
    """Every persistent event through every projection that takes its type, by priority (none last, then as declared):
    ``event_id, projection, nth, row`` (JSON, null for none) and ``error``. A failure is recorded and stops nothing."""
    types, deps = dict(_types), deps or {}
    order = sorted(enumerate(projections), key=lambda x: (x[1].declared.priority is None, x[1].declared.priority or 0, x[0]))
    ranked = [(n, p.declared.id, p.declared.on, p) for n, (_, p) in enumerate(order)]

    def run(pdfs):
        import pandas as pd

        for pdf in pdfs:
            out = []
            for e in pdf.to_dict("records"):
                value = decode(e["event_type"], e["payload"] or "null", types)
                for n, pid, on, fn in ranked:
                    if on and e["event_type"] not in on and (e["event_type"] or "").split(":", 1)[0] not in on:
                        continue
                    row, error = None, None
                    try:
                        row = fn(value, Context(str(e["event_id"]), pid, e["correlation_id"], deps=deps))
                    except Exception as x:  # noqa: BLE001
                        error = f"{type(x).__name__}: {x}"
                    out.append((str(e["event_id"]), pid, n, None if row is None else json.dumps(row), error))
            yield pd.DataFrame(out, columns=["event_id", "projection", "nth", "row", "error"])

    kept = dataflow.ephemeral_gate(events)[1] if "persistent" in events.columns else events
    return kept.select("event_id", "correlation_id", "event_type", "payload").mapInPandas(run, "event_id string, projection string, nth int, row string, error string")


class Engine:
    """Declared reactors, projections and aggregators over batches of events."""

    def __init__(self, spark: SparkSession, deps: dict | None = None):
        self.spark, self.deps, self.registry = spark, deps or {}, Registry()
        self.reactors: list = []
        self.projections: list = []
        self.aggregators: list = []
        self._started = False

    def add(self, *declared) -> Engine:
        """Take declarations; ids are checked over reactors and projections together."""
        for fn in declared:
            if hasattr(fn, "aggregate"):
                self.aggregators.append(fn)
                continue
            self.registry.add(fn.declared)
            (self.projections if getattr(fn, "observes", False) else self.reactors).append(fn)
        return self

    def start(self) -> None:
        """The start-up hooks, once, in the order of registration; an error ends the start."""
        if not self._started:
            for fn in (*self.reactors, *self.projections):
                if fn.init is not None:
                    fn.init(self.deps)
            self._started = True

    def fold(self, events: DataFrame) -> DataFrame:
        """``aggregate_key`` and ``state`` (JSON) after all persistent ``events`` (with ``position``), by every declared
        aggregator."""
        types = dict(_types)
        out = None
        for fn in self.aggregators:
            a = fn.aggregate
            rows = dataflow.ephemeral_gate(events)[1] if "persistent" in events.columns else events
            taken = F.lit(False)
            for cls in a["on"]:
                taken = taken | is_event(cls)
            rows = rows.filter(taken).select("position", "event_type", "payload", F.concat(F.lit(a["kind"] + ":"), F.get_json_object("payload", f"$.{a['key']}")).alias("aggregate_key"))

            def step(state: dict, e: dict, fn=fn) -> dict:
                value = decode(e["event_type"], e["payload"], types)
                return state if value is None else {"state": json.dumps(fn(json.loads(state["state"]), value))}

            start = {"state": json.dumps(a["default"])}
            one = fold_python(rows.filter("aggregate_key is not null"), ["aggregate_key"], "position", step, lambda start=start: dict(start), "state string")
            out = one if out is None else out.unionByName(one)
        return out if out is not None else self.spark.createDataFrame([], "aggregate_key string, state string")

    def react(self, events: DataFrame, **context) -> DataFrame:
        """The executions of one generation of events, with their ``hops``."""
        self.start()
        out = None
        for fn in self.reactors:
            mine = replace(fn.declared, where=None)
            routed = dataflow.route(events, Registry([mine]).routes(self.spark))
            done = run_reactor(routed, mine.id, fn, fn.where, self.deps, **context)
            done = done.join(events.select(F.col("event_id").cast("string").alias("event_id"), "hops"), "event_id")
            out = done if out is None else out.unionByName(done)
        return out if out is not None else self.spark.createDataFrame([], f"{_RUN_DDL}, hops int")

    def emit(self, events: DataFrame, correlation_id: str | None = None, timeout_s: float | None = None) -> Handle:
        """Emit events (``event_id, correlation_id, event_type, payload``), under another correlation if one is given. Nothing
        runs before the handle is asked to settle."""
        of = F.lit(correlation_id) if correlation_id is not None else F.col("correlation_id")
        seed = events.select(
            F.col("event_id").cast("string").alias("event_id"), F.lit(None).cast("string").alias("parent_id"), of.alias("correlation_id"), "event_type", "payload", F.lit(0).alias("hops")
        )

        def children(generation: DataFrame) -> DataFrame:
            return dataflow.emit(self.react(generation), F.col("children"))

        return Handle(correlation_id, lambda late=None: dataflow.settle(seed, children, late=late), timeout_s=timeout_s)


#: The kinds of description blocks and their fields.
BLOCKS = {
    "label": ("text",), "counter": ("label", "value", "total"), "progress": ("label", "fraction"), "checklist": ("label", "items"),
    "key_value": ("key", "value"), "status": ("label", "state"),
}


def block(kind: str, **fields) -> dict:
    """A description block; a fraction is clamped to 0..1."""
    if kind not in BLOCKS or set(fields) - set(BLOCKS[kind]):
        raise ValueError(f"no such block: {kind} with {sorted(fields)}")
    if "fraction" in fields:
        fields["fraction"] = min(max(fields["fraction"], 0.0), 1.0)
    return {"type": kind, **fields}


def describe(blocks: Iterable[dict]) -> str:
    return json.dumps(list(blocks))


@dataclass
class Handle:
    """A running emission: its correlation, status, cancellation and result."""

    correlation_id: str | None
    settle: Callable
    cancelled: bool = False
    timeout_s: float | None = None
    _result: object = None
    _done: bool = False

    def status(self) -> str:
        return "cancelled" if self.cancelled else "settled" if self._done else "pending"

    def cancel(self) -> None:
        self.cancelled = True

    def settled(self, timeout_s: float | None = None):
        """Run to the fix-point; nothing runs before it is asked for. With a time limit a ``TimeoutError`` after the
        generation in which it passes; the handle is then still pending and can be asked again."""
        if not self._done and not self.cancelled:
            limit = timeout_s if timeout_s is not None else self.timeout_s
            if limit is None:
                self._result = self.settle()
            else:
                end = time.monotonic() + limit
                self._result = self.settle(lambda: time.monotonic() > end)
            self._done = True
        return self._result
