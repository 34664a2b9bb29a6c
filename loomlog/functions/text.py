"""Names, JSON documents and display texts as column expressions."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORDS = r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"


def snake_case(name: Column) -> Column:
    """Words in lower case with underscores; a run of capitals is one word (HTTPServer: http_server)."""
    return F.lower(F.regexp_replace(name, _WORDS, "_"))


def _pascal(name: Column) -> Column:
    return F.array_join(F.transform(F.split(snake_case(name), "_"), lambda w: F.initcap(w)), "")


def rename_all(name: Column, rule: str) -> Column:
    """A variant's name under a rename rule; an unknown rule leaves it."""
    if rule == "snake_case":
        return snake_case(name)
    if rule == "SCREAMING_SNAKE_CASE":
        return F.upper(snake_case(name))
    if rule == "kebab-case":
        return F.replace(snake_case(name), F.lit("_"), F.lit("-"))
    if rule == "PascalCase":
        return _pascal(name)
    if rule == "camelCase":
        p = _pascal(name)
        return F.concat(F.lower(F.substring(p, 1, 1)), p.substr(F.lit(2), F.length(p)))
    return name


def title(name: Column) -> Column:
    """Each word with a capital first letter, the rest as it is."""
    return F.array_join(F.transform(F.split(name, "_"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))), " ")


def truncate(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def duration(ms: Column, form: str = "bar") -> Column:
    """Milliseconds in one of three forms: ``bar`` (<1ms, 123ms, 1.5s, 2.1m), ``node`` (123ms, 1.5s, 2m 6s, 2m) and ``range``
    (123ms, 1.5s, 2.1m, 1.4h)."""
    tenth = lambda per, unit: F.concat(F.format_string("%.1f", ms / per), F.lit(unit))
    whole = F.concat(ms.cast("bigint").cast("string"), F.lit("ms"))
    if form == "node":
        seconds = ms / 1000.0
        minutes, rest = F.floor(seconds / 60).cast("string"), F.floor(F.pmod(seconds, F.lit(60)) + 0.5)
        long = F.when(rest > 0, F.concat(minutes, F.lit("m "), rest.cast("string"), F.lit("s"))).otherwise(F.concat(minutes, F.lit("m")))
        return F.when(ms < 1000, whole).when(ms < 60_000, tenth(1000.0, "s")).otherwise(long)
    if form == "range":
        return F.when(ms < 1000, whole).when(ms < 60_000, tenth(1000.0, "s")).when(ms < 3_600_000, tenth(60_000.0, "m")).otherwise(tenth(3_600_000.0, "h"))
    return (
        F.when(ms < 1, F.lit("<1ms")).when(ms < 1000, F.concat(F.floor(ms + 0.5).cast("string"), F.lit("ms")))
        .when(ms < 60_000, tenth(1000.0, "s")).otherwise(tenth(60_000.0, "m"))
    )


def threshold_label(value: Column, low: float, high: float, labels: tuple[str, str, str] = ("negative", "neutral", "positive")) -> Column:
    """The label below ``low``, between, or above ``high``, with the value to two places; null for null."""
    label = F.when(value > high, labels[2]).when(value < low, labels[0]).when(value.isNotNull(), labels[1])
    return F.concat(label, F.lit(" ("), F.format_string("%.2f", value.cast("double")), F.lit(")"))


def percent(share: Column, unit: str = "%") -> Column:
    """A share of one as whole percents; null for null."""
    return F.when(share.isNotNull(), F.concat(F.format_string("%.0f", share.cast("double") * 100), F.lit(unit)))


def fraction(part: Column, whole: Column) -> Column:
    """Between 0 and 1; 0 of nothing."""
    return F.when(whole > 0, F.least(F.greatest(part / whole, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))


def json_diff(before: Column, after: Column) -> Column:
    """Sorted ``+key``, ``-key`` and ``~key`` of two JSON objects' top-level fields, compared by their texts. Null or broken
    documents have no fields."""
    empty = F.create_map().cast("map<string,string>")
    a, b = (F.coalesce(F.from_json(x, "map<string,string>"), empty) for x in (before, after))
    keys = F.array_sort(F.array_union(F.map_keys(a), F.map_keys(b)))
    mark = lambda k: (
        F.when(~F.map_contains_key(a, k), F.concat(F.lit("+"), k)).when(~F.map_contains_key(b, k), F.concat(F.lit("-"), k))
        .when(~F.try_element_at(a, k).eqNullSafe(F.try_element_at(b, k)), F.concat(F.lit("~"), k))
    )
    return F.filter(F.transform(keys, mark), lambda x: x.isNotNull())


def set_field(document: dict, path: str, value) -> dict:
    *way, last = path.split(".")
    at = document
    for k in way:
        at = at.setdefault(k, {})
        if not isinstance(at, dict):
            return document
    at[last] = value
    return document


def _take(document: dict, path: str) -> tuple[bool, object]:
    *way, last = path.split(".")
    at = document
    for k in way:
        at = at.get(k)
        if not isinstance(at, dict):
            return False, None
    return (True, at.pop(last)) if last in at else (False, None)


def upcast_step(step: dict) -> Callable[[dict], dict]:
    """A declared payload step: set, rename, drop or cast of a field."""

    def run(d: dict) -> dict:
        op = step["op"]
        if op == "set":
            return set_field(d, step["field"], step["value"])
        there, v = _take(d, step["from"] if op == "rename" else step["field"])
        if not there or op == "drop":
            return d
        if op == "rename":
            return set_field(d, step["to"], v)
        if step["to"] == "string" and v is not None and not isinstance(v, str):
            v = json.dumps(v)
        return set_field(d, step["field"], v)

    return run


#: Declared steps are code kept in a table; more than this many are refused.
MAX_STEPS = 100_000


def declared_steps(upcasters: DataFrame) -> list[tuple[str, int, str]]:
    """The steps of a table ``event_prefix, from_version, transform``."""
    rows = upcasters.select("event_prefix", "from_version", "transform").limit(MAX_STEPS + 1).collect()
    if len(rows) > MAX_STEPS:
        raise ValueError(f"more than {MAX_STEPS} declared steps")
    return [tuple(r) for r in rows]


def upcaster(steps: list[tuple[str, int, str]]) -> Callable[[Column, Column, Column], Column]:
    """A vectorised upcaster of (event prefix, from_version, step as JSON): all steps of a payload's prefix from its version
    on, in ascending order. A null version counts as 0; payloads that are no JSON object, and types without steps, stay
    as they are."""
    chains: dict[str, list[tuple[int, Callable]]] = {}
    for p, v, s in sorted(steps, key=lambda x: (x[0], x[1])):
        chains.setdefault(p, []).append((v, upcast_step(json.loads(s))))

    @F.pandas_udf("string")
    def run(event_type: pd.Series, version: pd.Series, payload: pd.Series) -> pd.Series:
        out = []
        for t, v, p in zip(event_type, version, payload):
            chain = chains.get((t or "").split(":", 1)[0])
            if not chain or p is None:
                out.append(p)
                continue
            try:
                d = json.loads(p)
            except ValueError:
                d = None
            if not isinstance(d, dict):
                out.append(p)
                continue
            at = 0 if v is None or v != v else int(v)
            for since, step in chain:
                if since >= at:
                    d = step(d)
            out.append(json.dumps(d, separators=(",", ":"), ensure_ascii=False))
        return pd.Series(out)

    return run


_ENTRIES = "array<struct<key:string,json:string>>"
_STEP = "array<struct<since:int,op:string,k1:string,k2:string,t1:string,t2:string,json:string>>"


def _quoted(text: Column) -> Column:
    """A text as a JSON string."""
    q = F.to_json(F.array(text))
    return F.substring(q, F.lit(2), F.length(q) - 2)


def _entries(json_text: Column) -> Column:
    """Key and JSON of each field of a JSON object, null for anything else; of a repeated key the last counts where it is
    looked up."""
    whole = F.from_json(F.concat(F.lit("["), json_text, F.lit("]")), "array<map<string,variant>>")  # in brackets, else text behind the object is overlooked
    fields = F.map_entries(F.when(F.size(whole) == 1, whole[0]))
    each = F.transform(fields, lambda e: F.struct(e["key"].alias("key"), F.coalesce(F.to_json(e["value"]), F.lit("null")).alias("json")))
    return F.when(F.ltrim(json_text).startswith("{"), each)


def is_object(json_text: Column) -> Column:
    """Is the text a JSON object, whole and with nothing behind it?"""
    return F.coalesce(_entries(json_text).isNotNull(), F.lit(False))


def _spelled(entries: Column) -> Column:
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(_quoted(e["key"]), F.lit(":"), e["json"])), ","), F.lit("}"))


def _entry(key: Column, json_text: Column) -> Column:
    return F.struct(key.alias("key"), json_text.alias("json"))


def _lookup(entries: Column, key: Column) -> Column:
    return F.try_element_at(F.filter(entries, lambda e: e["key"] == key), F.lit(-1))["json"]


def _without(entries: Column, key: Column) -> Column:
    return F.filter(entries, lambda e: e["key"] != key)


def _get(doc: Column, k1: Column, k2: Column) -> Column:
    top = _lookup(doc, k1)
    return F.when(k2.isNull(), top).otherwise(_lookup(_entries(top), k2))


def _inside(doc: Column, k1: Column, change: Callable[[Column], Column]) -> Column:
    """``doc`` with the object under ``k1`` changed; values that are no objects stay."""
    each = lambda e: F.when((e["key"] == k1) & _entries(e["json"]).isNotNull(), _entry(e["key"], _spelled(change(_entries(e["json"]))))).otherwise(_entry(e["key"], e["json"]))
    return F.transform(doc, each)


def _drop(doc: Column, k1: Column, k2: Column) -> Column:
    return F.when(k2.isNull(), _without(doc, k1)).otherwise(_inside(doc, k1, lambda x: _without(x, k2)))


def _put(doc: Column, k1: Column, k2: Column, v: Column) -> Column:
    new = F.concat(doc, F.array(_entry(k1, _spelled(F.array(_entry(k2, v))))))
    nested = F.when(_lookup(doc, k1).isNull(), new).otherwise(_inside(doc, k1, lambda x: F.concat(_without(x, k2), F.array(_entry(k2, v)))))
    return F.when(k2.isNull(), F.concat(_without(doc, k1), F.array(_entry(k1, v)))).otherwise(nested)


def upcast(event_type: Column, version: Column, payload: Column, steps: list[tuple[str, int, str]]) -> Column:
    """``upcaster`` as one built-in expression, for steps on fields at most one object deep: the steps of the payload's prefix
    are folded over its fields, so the expression does not grow with the steps. Fields come out in the order of their last
    change; numbers as JSON spells them."""
    rows: dict[str, list] = {}
    for prefix, since, text in sorted(steps, key=lambda x: (x[0], x[1])):
        step = json.loads(text)
        way = lambda path: (path.split(".") + [None])[:2]
        source, to = step["from"] if step["op"] == "rename" else step["field"], step.get("to") if step["op"] == "rename" else step["field"]
        if max(source.count("."), to.count(".")) > 1:
            raise ValueError(f"deeper than one object: {text}")
        value = json.dumps(step.get("value")) if step["op"] == "set" else step.get("to") if step["op"] == "cast" else None
        rows.setdefault(prefix, []).append(F.struct(*(F.lit(x).alias(n) for n, x in zip(("since", "op", "k1", "k2", "t1", "t2", "json"), (since, step["op"], *way(source), *way(to), value)))))
    if not rows:
        return payload
    chains = F.create_map(*(x for p, c in rows.items() for x in (F.lit(p), F.array(*c).cast(_STEP))))
    chain = F.try_element_at(chains, F.substring_index(event_type, ":", 1))

    def apply(doc: Column, s: Column) -> Column:
        v = _get(doc, s["k1"], s["k2"])
        moved = F.when((s["op"] == "cast") & (s["json"] == "string") & ~v.startswith('"') & (v != "null"), _quoted(v)).otherwise(v)
        rest = _drop(doc, s["k1"], s["k2"])
        changed = F.when(s["op"] == "set", _put(doc, s["k1"], s["k2"], s["json"])).when(v.isNull(), doc).when(s["op"] == "drop", rest).otherwise(_put(rest, s["t1"], s["t2"], moved))
        return F.when(s["since"] >= F.coalesce(version.cast("int"), F.lit(0)), changed).otherwise(doc)

    doc = _entries(payload).cast(_ENTRIES)
    new = _spelled(F.aggregate(chain, doc, apply))
    return F.when(chain.isNull() | doc.isNull(), payload).otherwise(new)


def durable_name(type_name: str, prefix: str | None = None) -> str:
    """The stored name of an event class: its prefix, or its name in snake case."""
    return prefix or re.sub(_WORDS, "_", type_name).lower()
