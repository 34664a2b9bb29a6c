"""Deeply nested records to related flat tables.

Method: structural variants. A bottom-up tree automaton gives every JSON value a state: scalars have fixed states, an
array's state is the set of its elements' states, an object's state is the set of its (field, state) pairs. The state of
a record object is its variant. Every record is routed to the subtype table of its kind and variant, with typed columns;
the common supertype keeps source, event, aggregate key, kind, record id and the id of the record around it.

Records come in every JSON form: lists (null elements are no records), one object in place of a list, objects that file
records under their ids, and any of these as a JSON text inside a JSON text. Texts that are not valid JSON hold none.
"""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.session import scratch_path

#: The fields that hold records, the kind of their records and the field of a record's own id.
RECORD_FIELDS = {
    "shipments": ("shipment", "shipment_id"),
    "lines": ("line", "line_id"),
    "components": ("line", "line_id"),
    "adjustments": ("adjustment", "adj_id"),
}
ID_FIELDS = {own for _, own in RECORD_FIELDS.values()}

SUPERTYPE = "source string, event_id string, aggregate_key string, kind string, variant string, record_id string, parent_record_id string, fields string, types string, lists string"
_SCHEMA = pa.schema([(c.split()[0], pa.string()) for c in SUPERTYPE.split(", ")])


def _constant(name: str):
    raise ValueError(name)


_decoder = json.JSONDecoder(parse_constant=_constant)


def parse(text: str | None):
    """The value of a JSON text; None where the text is null or not valid JSON (also when nested beyond reason)."""
    if text is None:
        return None
    try:
        return _decoder.decode(text)
    except (ValueError, RecursionError):
        return None


def texts(values) -> pa.Array:
    """Strings for Arrow; lone surrogates, which JSON escapes can spell, become question marks."""
    try:
        return pa.array(values, pa.string())
    except UnicodeEncodeError:
        return pa.array([None if x is None else x.encode("utf-8", "replace").decode() for x in values], pa.string())


def _inner(v):
    """A text that is itself JSON for an object or list is that value."""
    while isinstance(v, str):
        s = v.lstrip()
        if not s or s[0] not in '{["':
            return v
        w = parse(v)
        if not isinstance(w, (dict, list, str)) or w == v:
            return v
        if isinstance(w, str) and w.lstrip()[:1] not in ("{", "[", '"'):
            return v
        v = w
    return v


class Automaton:
    """Deterministic bottom-up states of JSON values; the same structure has the same state in every task."""

    def __init__(self):
        self._names: dict = {}

    def _name(self, form: tuple) -> str:
        if form not in self._names:
            self._names[form] = hashlib.md5(repr(form).encode("utf-8", "replace")).hexdigest()[:12]
        return self._names[form]

    @staticmethod
    def _scalar(v) -> str:
        return "z" if v is None else "b" if isinstance(v, bool) else "n" if isinstance(v, (int, float)) else "s"

    def state(self, v) -> str:
        """Bottom-up with a stack of its own, so no nesting is too deep. A field that holds records counts by name only:
        its records have states of their own."""
        if not isinstance(v, (dict, list)):
            return self._scalar(v)
        done: dict[int, str] = {}
        stack = [(v, False)]
        while stack:
            x, ready = stack.pop()
            inner = x if isinstance(x, list) else [y for k, y in x.items() if k not in RECORD_FIELDS]
            if not ready:
                stack.append((x, True))
                stack.extend((y, False) for y in inner if isinstance(y, (dict, list)))
                continue
            of = lambda y: done[id(y)] if isinstance(y, (dict, list)) else self._scalar(y)
            if isinstance(x, list):
                done[id(x)] = self._name(("[", *sorted({of(y) for y in x})))
            else:
                done[id(x)] = self._name(("{", *sorted((k, "r" if k in RECORD_FIELDS else of(y)) for k, y in x.items())))
        return done[id(v)]

    def variant(self, record: dict) -> str:
        """The state of a record's own structure, without its id."""
        return self.state({k: x for k, x in record.items() if k not in ID_FIELDS})


def _filed(held, field: str, own: str):
    """(record, id) of each record that a record field holds, in no order."""
    stack = [held]
    while stack:
        held = _inner(stack.pop())
        if isinstance(held, list):
            stack.extend(x for x in held if isinstance(x, (dict, list, str)))
        elif isinstance(held, dict) and held:
            inner = [(k, _inner(x)) for k, x in held.items()] if own not in held else ()
            if inner and all(x is None or isinstance(x, dict) for _, x in inner):
                yield from ((x, k) for k, x in inner if x is not None)
            else:
                yield held, field


def _text(v) -> str:
    return v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)


def _type(v) -> str:
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, int):
        return "bigint" if -(2**63) <= v < 2**63 else "double" if abs(v) < 2**53 else "string"
    return "void" if v is None else "double" if isinstance(v, float) else "string"


def _flat(record: dict) -> tuple[dict, list]:
    """The record's own scalars under dotted names, and the scalars in its lists as [dotted name, dotted positions, value].

    Fields that hold records are left out at any depth, since their records have rows of their own. A name that is taken
    already (names can have dots themselves) gets an apostrophe.
    """
    flat, lists, stack = {}, [], [("", "", record)]
    while stack:
        name, at, v = stack.pop()
        if isinstance(v, dict):
            stack.extend((f"{name}.{k}" if name else k, at, x) for k, x in reversed(v.items()) if k not in RECORD_FIELDS)
        elif isinstance(v, list):
            stack.extend((name, f"{at}.{i}" if at else str(i), x) for i, x in reversed(list(enumerate(v))))
        elif at:
            lists.append([name, at, v])
        else:
            while name in flat:
                name += "'"
            flat[name] = v
    return flat, lists


def _records(value, automaton: Automaton):
    """``records`` with the types of the scalars, and the scalars in lists (None for none), both as JSON."""
    stack = [(value, "")]
    while stack:
        v, around = stack.pop()
        v = _inner(v)
        if isinstance(v, list):
            stack.extend((x, around) for x in reversed(v) if isinstance(x, (dict, list, str)))
        elif isinstance(v, dict):
            for k, x in reversed(v.items()):
                if not isinstance(x, (dict, list, str)):
                    continue
                if k not in RECORD_FIELDS:
                    stack.append((x, around))
                    continue
                kind, own = RECORD_FIELDS[k]
                for record, key in _filed(x, k, own):
                    rid = _text(record[own]) if record.get(own) is not None else key
                    flat, lists = _flat(record)
                    types = json.dumps({f: _type(flat[f]) for f in sorted(flat)}, ensure_ascii=False)
                    yield (
                        kind, automaton.variant(record), rid, around, json.dumps(flat, ensure_ascii=False), types,
                        json.dumps(lists, ensure_ascii=False) if lists else None,
                    )
                    stack.append((record, rid))


def records(value, automaton: Automaton):
    """(kind, variant, record id, parent record id, own scalar fields as JSON) of all records in ``value``, at any depth.

    Walks with a stack of its own, so no nesting is too deep.
    """
    return (r[:5] for r in _records(value, automaton))


def _shredder(source: str, per_key: bool):
    def run(batches):
        automaton = Automaton()
        for b in batches:
            out = []
            for event, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                v = _inner(parse(text)) if text is not None else None
                if per_key:
                    parts = v.items() if isinstance(v, dict) else ()
                else:
                    parts = (("", v),)
                for key, part in parts:
                    # a record field at the top of the snapshots is not an aggregate; its records have its name as key
                    held = {key: part} if per_key and key in RECORD_FIELDS else part
                    out.extend((source, event, key, *r) for r in _records(held, automaton))
            for i in range(0, len(out), 10_000):
                rows = out[i : i + 10_000]
                yield pa.RecordBatch.from_arrays([texts(c) for c in zip(*rows)], schema=_SCHEMA)

    return run


def may_hold(text: str):
    """JVM-side: can the JSON text hold records? (A field name may be spelled with \\u escapes.)"""
    names = "|".join(RECORD_FIELDS)
    return F.col(text).rlike(rf"{names}|\\u00")


def shred(texts: DataFrame, source: str, per_key: bool) -> DataFrame:
    """The supertype table of ``texts`` (``event_id``, ``text``).

    ``per_key``: the text is an object of aggregate key to state. Null texts and texts without records give no rows.
    """
    return texts.select("event_id", "text").mapInArrow(_shredder(source, per_key), SUPERTYPE)


def route(supertype: DataFrame) -> DataFrame:
    """Write each variant of each kind to a table of its own (a folder per kind and variant) and read all of them as one: a
    filter on kind or variant reads those tables only. Rows are rebalanced by variant first, which splits a variant that
    holds most records over many tasks and keeps small ones in few files."""
    spark = supertype.sparkSession
    path = scratch_path(spark, "variants")
    supertype.hint("rebalance", "kind", "variant").write.partitionBy("kind", "variant").option("compression", "zstd").parquet(path)
    return spark.read.schema(supertype.schema).parquet(path).select(*supertype.columns)


#: Typed columns that the subtype tables have even where no record does.
SUBTYPES = {
    "shipment": "carrier string",
    "line": "sku string, qty bigint, note string",
    "adjustment": "code string, cents bigint",
}
_LINK = ["source", "event_id", "aggregate_key", "variant", "record_id", "parent_record_id"]


def _common(a: str, b: str) -> str:
    """The type that holds the values of both."""
    if a == b or b == "void":
        return a
    return b if a == "void" else "double" if {a, b} == {"bigint", "double"} else "string"


def columns(supertype: DataFrame, kind: str, variant: str | None = None) -> dict[str, str]:
    """Field to type over all records of a kind, or of one of its variants, besides the kind's own id."""
    rows = supertype.filter(F.col("kind") == kind)
    rows = rows if variant is None else rows.filter(F.col("variant") == variant)
    out: dict[str, str] = {} if variant else dict(c.split() for c in SUBTYPES[kind].split(", "))
    for r in rows.select("types").distinct().collect():  # one per structure
        for f, t in json.loads(r["types"]).items():
            out[f] = _common(out.get(f, "void"), t)
    own = {own for k, own in RECORD_FIELDS.values() if k == kind}
    return {f: "string" if t == "void" else t for f, t in out.items() if f not in own}


def subtype(supertype: DataFrame, kind: str, variant: str | None = None) -> DataFrame:
    """The flat typed table of one kind and variant, its columns derived from the variant's records; without ``variant`` the
    union of the kind's variants, a column having the type that holds all its values. Keys and parent link are kept; a
    field that a record lacks is null; objects are dotted columns, lists are in ``lists``.

    Reads ``supertype`` twice, so it should be written. A name that differs from an earlier one by case only, or is that of
    a key, ends in underscores.
    """
    rows = supertype.filter(F.col("kind") == kind)
    rows = rows if variant is None else rows.filter(F.col("variant") == variant)
    found = columns(supertype, kind, variant)
    first = [c.split()[0] for c in SUBTYPES[kind].split(", ")]
    taken, typed = {*_LINK, "t"}, []
    for f in sorted(found, key=lambda f: (f not in first, first.index(f) if f in first else 0, f)):
        name = f
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        typed.append(F.element_at("t", F.lit(f)).try_cast(found[f]).alias(name))
    return rows.select(*_LINK, F.from_json("fields", "map<string,string>").alias("t")).select(*_LINK, *typed)


def lists(supertype: DataFrame) -> DataFrame:
    """The child table of all kinds: one row per scalar in a record's lists, with its dotted name and positions (from 0)."""
    of = ["source", "event_id", "aggregate_key", "kind", "record_id"]
    held = supertype.filter("lists is not null").select(*of, F.explode(F.from_json("lists", "array<array<string>>")).alias("x"))
    return held.select(*of, F.col("x")[0].alias("field"), F.col("x")[1].alias("position"), F.col("x")[2].alias("value"))


def variants(supertype: DataFrame) -> DataFrame:
    """The catalogue of structural variants: records and an example's fields."""
    return supertype.groupBy("kind", "variant").agg(F.count("*").alias("records"), F.min("fields").alias("example"))
