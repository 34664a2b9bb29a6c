"""Schemas that drift between files.

Method: rescue-column ingestion. Every payload is read against a target schema; fields it does not know, and values that
do not fit, stay in a rescue column as JSON; approved fields are promoted, and rescued values are replayed into the new
typed columns. The rescued fields, with their types and values per file, also tell each change.

Payloads that are not JSON objects, also after decoding a JSON text once more, are passed over. A field is a leaf named
by its dotted path; a list is one field.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomlog.operators.shred import parse, texts
from loomlog.session import small, written

_KEYS = ["producer", "event_type", "segment_no"]
_FILE = [*_KEYS, "payload"]


def json_object(text: str | None) -> dict | None:
    v = parse(text)
    if isinstance(v, str):
        v = parse(v)
    return v if isinstance(v, dict) else None


def leaves(v: dict):
    """(dotted path, value) of all leaves, without recursion."""
    stack = [("", v)]
    while stack:
        prefix, d = stack.pop()
        for k, x in d.items():
            if isinstance(x, dict):
                stack.append((f"{prefix}{k}.", x))
            else:
                yield prefix + k, x


def json_type(v) -> str | None:
    if v is None:
        return None
    if isinstance(v, bool):
        return "boolean"
    return "number" if isinstance(v, (int, float)) else "string" if isinstance(v, str) else "list"


def atoms(v):
    """The scalar values a field draws on, as texts: a list's elements, a number and its text alike."""
    if isinstance(v, list):
        for x in v:
            yield from atoms(x)
    elif isinstance(v, dict):
        yield json.dumps(v, sort_keys=True)
    elif v is not None:
        yield json.dumps(v) if isinstance(v, (bool, float)) else str(v)


_FACTS = pa.schema(
    [("producer", pa.string()), ("event_type", pa.string()), ("segment_no", pa.int64()), ("path", pa.string()),
     ("type", pa.string()), ("atom", pa.string())]
)


#: Distinct facts that a task holds before it sends them on.
_HELD = 100_000


def _sent(seen: set, schema: pa.Schema):
    rows = list(seen)
    for i in range(0, len(rows), 10_000):
        arrays = [pa.array(c, pa.int64()) if f.name == "segment_no" else texts(c) for c, f in zip(zip(*rows[i : i + 10_000]), schema)]
        yield pa.RecordBatch.from_arrays(arrays, schema=schema)
    seen.clear()


def _observe(batches):
    seen: set = set()
    add = seen.add
    for b in batches:
        for producer, kind, segment, text in zip(*(c.to_pylist() for c in b.columns)):
            for path, x in leaves(json_object(text) or {}):
                if x.__class__ is str:
                    add((producer, kind, segment, path, "string", x))
                elif x.__class__ is int:
                    add((producer, kind, segment, path, "number", str(x)))
                else:
                    of = json_type(x)
                    for a in set(atoms(x)) or (None,):
                        add((producer, kind, segment, path, of, a))
        if len(seen) > _HELD:
            yield from _sent(seen, _FACTS)
    yield from _sent(seen, _FACTS)


def observe(rescued: DataFrame) -> DataFrame:
    """The (file, event type, path, type, value) facts of a rescue column, most repeats removed."""
    ddl = "producer string, event_type string, segment_no bigint, path string, type string, atom string"
    return rescued.select("producer", "event_type", "segment_no", "_rescued").mapInArrow(_observe, ddl)


_FIELD = pa.schema([f for f in _FACTS if f.name != "atom"])


def _fields(batches):
    seen: set = set()
    add = seen.add
    for b in batches:
        for producer, kind, segment, text in zip(*(c.to_pylist() for c in b.columns)):
            v = json_object(text)
            if v is not None:
                add((producer, kind, segment, None, None))
                for path, x in leaves(v):
                    c = x.__class__
                    add((producer, kind, segment, path, "string" if c is str else "number" if c is int else json_type(x)))
        if len(seen) > _HELD:
            yield from _sent(seen, _FIELD)
    yield from _sent(seen, _FIELD)


def schemas(lines: DataFrame) -> DataFrame:
    """The schema of each file and event type: ``producer, event_type, segment_no, path, types`` (JSON types without null),
    a row with null path saying that the type has lines there."""
    ddl = "producer string, event_type string, segment_no bigint, path string, type string"
    return lines.select(*_FILE).mapInArrow(_fields, ddl).groupBy(*_KEYS, "path").agg(F.array_sort(F.collect_set("type")).alias("types"))


def _rescuer(batches):
    for b in batches:
        known: dict = {}
        out: tuple[list, ...] = ([], [], [], [])
        for producer, kind, segment, text, misfits in zip(*(c.to_pylist() for c in b.columns)):
            v = json_object(text)
            if v is None:
                continue
            of = known.get((producer, kind, segment))
            if of is None:
                of = known[producer, kind, segment] = frozenset(misfits)
            left = {path: x for path, x in leaves(v) if path in of}
            if left:
                for c, x in zip(out, (producer, kind, segment, json.dumps(left, ensure_ascii=False))):
                    c.append(x)
        yield pa.RecordBatch.from_arrays([texts(out[0]), texts(out[1]), pa.array(out[2], pa.int64()), texts(out[3])], names=["producer", "event_type", "segment_no", "_rescued"])


def rescue(lines: DataFrame, misfits: DataFrame) -> DataFrame:
    """The rescue column of ``lines`` read against the schemas of the files beside theirs: the JSON of the fields that those
    do not know, or know with another type (``misfits``: ``producer, event_type, segment_no, paths``). Lines in which every
    field fits have no rescued rest and give no row, and files without misfits are not parsed."""
    held = lines.select(*_FILE).join(small(misfits), _KEYS)
    return held.select(*_KEYS, "payload", "paths").mapInArrow(_rescuer, "producer string, event_type string, segment_no bigint, _rescued string")


def report(lines: DataFrame) -> DataFrame:
    """``producer, segment_no, event_type, field, old_field, change`` of each file against the last earlier file in which
    the producer's event type has lines. Null producers, types or segments take part in nothing.

    Each file is read against two target schemas, those of the files before and after it; what does not fit them is in its
    rescue column, and the report is read off that: a rescued field that the file before does not know came, one that the
    file after does not know goes, one that it knows otherwise was retyped. A field that goes and one that comes in one file
    are a rename when their rescued values share one; of several candidates the pair with most shared values goes first
    (ties: by name), each field in one pair.
    """
    lines = lines.filter("producer is not null and event_type is not null and segment_no is not null")
    lines = lines.withColumn("segment_no", F.col("segment_no").cast("bigint"))
    fields = written(schemas(lines), "fields")
    order = Window.partitionBy("producer", "event_type").orderBy("segment_no")
    steps = fields.filter("path is null").select(*_KEYS, F.lag("segment_no").over(order).alias("prev"), F.lead("segment_no").over(order).alias("next"))
    real = fields.filter("path is not null").join(small(written(steps, "steps")), _KEYS)
    now = real.filter("prev is not null").select(*_KEYS, "path", F.col("types").alias("now"))
    before = real.filter("next is not null").select(
        "producer", "event_type", F.col("next").alias("segment_no"), "path", F.col("types").alias("before"), F.col("segment_no").alias("was")
    )
    change = (
        F.when(F.col("before").isNull(), "added").when(F.col("now").isNull(), "removed")
        .when((F.size("before") > 0) & (F.size("now") > 0) & (F.col("before") != F.col("now")), "retyped")
    )
    misfits = before.join(now, [*_KEYS, "path"], "full_outer").withColumn("change", change).filter("change is not null")
    # the file that holds the field, and the one at which the change is reported
    holder = F.when(F.col("change") == "removed", F.col("was")).otherwise(F.col("segment_no"))
    misfits = written(misfits.select("producer", "event_type", holder.alias("segment_no"), "path", F.col("segment_no").alias("at"), "change"), "misfits")
    rescued = rescue(lines, misfits.groupBy(*_KEYS).agg(F.collect_set("path").alias("paths")))
    facts = written(observe(rescued), "facts")
    seen = small(misfits)
    found = written(facts.select(*_KEYS, "path").distinct().join(seen, [*_KEYS, "path"]).select("producer", "event_type", F.col("at").alias("segment_no"), "path", "change"), "changes")
    values = facts.filter("atom is not null").join(seen.filter("change <> 'retyped'"), [*_KEYS, "path"])
    values = values.select("producer", "event_type", F.col("at").alias("segment_no"), "change", "path", "atom").distinct()
    old = values.filter("change = 'removed'").select(*_KEYS, "atom", F.col("path").alias("old_field"))
    new = values.filter("change = 'added'").select(*_KEYS, "atom", F.col("path").alias("field"))
    shared = old.join(new, [*_KEYS, "atom"]).groupBy(*_KEYS, "old_field", "field").agg(F.count("*").alias("common"))
    renamed = shared.groupBy(*_KEYS).agg(F.array_sort(F.collect_list(F.struct((-F.col("common")).alias("c"), "old_field", "field"))).alias("p")).select(
        *_KEYS, F.explode(_greedy("p")).alias("r")
    ).select(*_KEYS, F.col("r.field").alias("field"), F.col("r.old_field").alias("old_field"))
    renamed = written(renamed, "renamed")
    paired = renamed.select(*_KEYS, F.col("field").alias("path"), F.lit("added").alias("change")).unionByName(
        renamed.select(*_KEYS, F.col("old_field").alias("path"), F.lit("removed").alias("change"))
    )
    rest = found.join(small(paired), [*_KEYS, "path", "change"], "left_anti").select(*_KEYS, F.col("path").alias("field"), F.lit("").alias("old_field"), "change")
    out = rest.unionByName(renamed.select(*_KEYS, "field", "old_field", F.lit("renamed").alias("change")))
    return out.select("producer", "segment_no", "event_type", "field", "old_field", "change")


def _greedy(pairs: str):
    """Of pairs sorted best first, those whose fields no better pair has taken. A file has few changed fields."""
    empty = F.array().cast("array<struct<old_field:string,field:string>>")
    return F.aggregate(
        pairs, empty,
        lambda acc, x: F.when(
            F.exists(acc, lambda y: (y["old_field"] == x["old_field"]) | (y["field"] == x["field"])), acc
        ).otherwise(F.concat(acc, F.array(F.struct(x["old_field"].alias("old_field"), x["field"].alias("field"))))),
    )


#: Texts that spell a number or a truth value.
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
_TRUTH = {"true": True, "yes": True, "false": False, "no": False}
#: Kinds of typed columns. For ``target`` a list of one scalar is that scalar (``single``); where a field has other lists too, all its values are lists.
_ARROW = {"string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


def _string(v) -> str:
    return v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)


def _single(v):
    """A list of one scalar is that scalar."""
    return v[0] if isinstance(v, list) and len(v) == 1 and v[0] is not None and not isinstance(v[0], (dict, list)) else v


def _cast(v, to: str):
    """``v`` as the target type, or raise ValueError where it does not fit."""
    if v is None:
        return None
    if to == "array<string>":
        return [None if x is None else _string(x) for x in (v if isinstance(v, list) else [v])]
    if to == "string":
        return _string(v)
    if to == "boolean":
        if isinstance(v, bool):
            return v
        if isinstance(v, str) and v.lower() in _TRUTH:
            return _TRUTH[v.lower()]
        if isinstance(v, (int, float)) and v in (0, 1):
            return bool(v)
        raise ValueError
    if isinstance(v, (bool, dict, list)) or isinstance(v, str) and not _NUMBER.fullmatch(v) or isinstance(v, int) and abs(v) > 2**53:
        raise ValueError
    return float(v)


def _form(v) -> str:
    v = _single(v)
    if isinstance(v, list):
        return "many"
    if isinstance(v, str):
        return "truth text" if v.lower() in _TRUTH else "number text" if _NUMBER.fullmatch(v) else "text"
    return "null" if v is None else "boolean" if isinstance(v, bool) else "text" if isinstance(v, int) and abs(v) > 2**53 else "number"


def _forms(batches):
    for b in batches:
        seen: dict = {}
        for text in b.column(0).to_pylist():
            for path, x in leaves(json_object(text) or {}):
                at = (path, _form(x))
                seen[at] = seen.get(at, 0) + 1
        if seen:
            yield pa.RecordBatch.from_arrays([texts([p for p, _ in seen]), pa.array([f for _, f in seen]), pa.array(list(seen.values()), pa.int64())], names=["path", "form", "n"])


def target(lines: DataFrame, renamed: list[tuple[str, str]], known: dict[str, str]) -> tuple[dict[str, str], dict[str, str]]:
    """The columns of the one table for all fields of ``lines``, and the renames to them, for ``ingest`` and ``promote_all``.

    Names that a pair of ``renamed`` links, directly or over others, or that differ by case only, are one field. It has
    the name that ``known`` (name to kind) has, else the most frequent one (ties: by name). Its kind is that of ``known``, else
    the narrowest that holds all values; where lists of other than one scalar occur, a list of texts.
    """
    forms: dict[str, dict[str, int]] = {}
    for r in lines.select("payload").mapInArrow(_forms, "path string, form string, n bigint").groupBy("path", "form").agg(F.sum("n").alias("n")).collect():
        forms.setdefault(r["path"], {})[r["form"]] = r["n"]  # one row per name and form
    up: dict[str, str] = {}

    def find(x: str) -> str:
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    same: dict[str, str] = {}
    for name in sorted({*forms, *known, *(x for pair in renamed for x in pair)}):
        up[find(name)] = find(same.setdefault(_column(name).lower(), name))
    for old, new in renamed:
        up[find(old)] = find(new)
    fields: dict[str, list[str]] = {}
    for name in sorted(up):
        fields.setdefault(find(name), []).append(name)
    columns, renames = {}, {}
    for names in fields.values():
        best = min(names, key=lambda x: (x not in known, -sum(forms.get(x, {}).values()), x))
        have = {f for x in names for f in forms.get(x, ())} - {"null"}
        if "many" in have:
            kind = "array<string>"
        elif best in known:
            kind = known[best]
        elif "number" in have and have <= {"number", "number text"}:
            kind = "double"
        elif "boolean" in have and have <= {"boolean", "truth text"}:
            kind = "boolean"
        else:
            kind = "string"
        columns[best] = kind
        renames.update({x: best for x in names if x != best})
    return columns, renames


def _ingester(columns: dict[str, str], renames: dict[str, str], single: bool):
    def run(batches):
        for b in batches:
            payloads = b.column("payload").to_pylist()
            out = {c: [] for c in columns}
            rescued = []
            for text in payloads:
                v = json_object(text)
                if v is None:
                    for c in columns:
                        out[c].append(None)
                    rescued.append(None if text is None else json.dumps({"_raw": text}, ensure_ascii=False))
                    continue
                row, left = {}, {}
                for path, x in leaves(v):
                    to = renames.get(path, path)
                    if to in columns and row.get(to) is None:
                        try:
                            row[to] = _cast(_single(x) if single and columns[to] != "array<string>" else x, columns[to])
                            continue
                        except ValueError:
                            pass
                    left[path] = x
                for c in columns:
                    out[c].append(row.get(c))
                rescued.append(json.dumps(left, ensure_ascii=False) if left else None)
            keep = [b.column(c) for c in b.schema.names if c != "payload"]
            names = [c for c in b.schema.names if c != "payload"]
            made = [_array(out[c], k) for c, k in columns.items()] + [texts(rescued)]
            yield pa.RecordBatch.from_arrays(keep + made, names=[*names, *(_column(c) for c in columns), "_rescued"])

    return run


def _array(values: list, kind: str) -> pa.Array:
    try:
        return pa.array(values, _ARROW[kind])
    except UnicodeEncodeError:
        return texts(values) if kind == "string" else pa.array([x and [t and t.encode("utf-8", "replace").decode() for t in x] for x in values], _ARROW[kind])


def _column(path: str) -> str:
    return "f_" + path.replace(".", "__")


def ingest(lines: DataFrame, columns: dict[str, str], renames: dict[str, str] | None = None, single: bool = False) -> DataFrame:
    """``lines`` with ``payload`` read into one typed column per entry of ``columns`` (dotted path to string, double or
    boolean) and ``_rescued``: the JSON of all fields that are unknown or do not fit, null when nothing was left over.
    ``renames`` maps older paths to the target's. A payload that is no JSON object is rescued whole under ``_raw``.
    ``single``: a list of one scalar is read as that scalar."""
    keep = [c for c in lines.columns if c != "payload"]
    types = dict(lines.dtypes)
    ddl = ", ".join([*(f"`{c}` {types[c]}" for c in keep), *(f"`{_column(c)}` {k}" for c, k in columns.items()), "_rescued string"])
    return lines.select(*keep, "payload").mapInArrow(_ingester(columns, renames or {}, single), ddl)


def _replay(columns: dict[str, str], renames: dict[str, str], single: bool):
    def run(batches):
        for b in batches:
            made: dict = {c: [] for c in columns}
            left = []
            for text in b.column("_rescued").to_pylist():
                row, rest = {}, {}
                for path, x in (parse(text) or {} if text is not None else {}).items():
                    to = renames.get(path, path)
                    if to in columns and row.get(to) is None:
                        try:
                            row[to] = _cast(_single(x) if single and columns[to] != "array<string>" else x, columns[to])
                            continue
                        except ValueError:
                            pass
                    rest[path] = x
                for c in columns:
                    made[c].append(row.get(c))
                left.append(json.dumps(rest, ensure_ascii=False).encode("utf-8", "replace").decode() if rest else None)
            keep = [c for c in b.schema.names if c != "_rescued"]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in keep), *(_array(made[c], k) for c, k in columns.items()), pa.array(left, pa.string())],
                names=[*keep, *(_column(c) for c in columns), "_rescued"],
            )

    return run


def promote_all(ingested: DataFrame, columns: dict[str, str], renames: dict[str, str] | None = None, single: bool = False) -> DataFrame:
    """Approve rescued fields (dotted path to kind): typed columns filled by one replay of the rescued values, which leave
    the rescue column; what does not fit stays there. ``renames`` and ``single`` as in ``ingest``."""
    keep = [f"`{c}` {t}" for c, t in ingested.dtypes if c != "_rescued"]
    return ingested.mapInArrow(_replay(columns, renames or {}, single), ", ".join([*keep, *(f"`{_column(c)}` {k}" for c, k in columns.items()), "_rescued string"]))


def promote(ingested: DataFrame, path: str, kind: str) -> DataFrame:
    """``promote_all`` of one field."""
    return promote_all(ingested, {path: kind})
