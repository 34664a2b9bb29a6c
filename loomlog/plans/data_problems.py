"""The p1..p6 queries: each applies its operator, with production parameters, to its whole tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.functions.ids import id_key, id_text
from loomlog.operators import drift, hierarchy, incremental, orphans, shred, skew
from loomlog.session import table, written
from loomlog.sources.events import first_by_id

#: p1_found: an event this many links or more below its root is a case.
DEEP = 25
#: p2_found: a key is heavy from this share of all rows, as one in so many.
HEAVY_ONE_IN = 20


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    first = first_by_id(table(spark, d, "stored_events"), "parent_id")
    return first.select("key", id_key("parent_id").alias("parent"), F.col("seq").alias("ord"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = hierarchy.resolve(_nodes(spark, d)).filter(f"cyclic or depth >= {DEEP}")
    return found.select(id_text("key").alias("id"), id_text("top").alias("top_id"), "depth")


def p1_trees(spark: SparkSession, d: str) -> DataFrame:
    """Per root: events and deepest level of its tree; loops under their smallest id with depth -1."""
    trees = hierarchy.resolve(_nodes(spark, d)).groupBy("top").agg(F.count("*").alias("n_events"), F.max("depth").alias("max_depth"))
    return trees.select(id_text("top").alias("top_id"), "n_events", "max_depth")


def _paths(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    nodes = written(_nodes(spark, d), "nodes")
    resolved = written(hierarchy.resolve(nodes), "resolved")
    return resolved, hierarchy.paths(nodes, resolved)


def p1_paths(spark: SparkSession, d: str) -> DataFrame:
    """Every event's root, depth and path from the root, its ids parted by slashes; on and below loops the loop's smallest
    id, -1 and null."""
    resolved, paths = _paths(spark, d)
    looped = resolved.filter("cyclic").select("key", "top", "depth", F.lit(None).cast("array<binary>").alias("path"))
    rooted = paths.filter("path is not null").select("key", F.element_at("path", 1).alias("top"), (F.size("path") - 1).cast("bigint").alias("depth"), "path")
    return rooted.unionByName(looped).select(
        id_text("key").alias("id"), id_text("top").alias("top_id"), "depth", F.array_join(F.transform("path", id_text), "/").alias("path")
    )


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every event's descendants, one row each, with the number of links between; events without any give no row."""
    below = hierarchy.pairs(_paths(spark, d)[1])
    return below.select(id_text("ancestor").alias("id"), id_text("key").alias("descendant_id"), "distance")


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "stored_events").select(
        id_key("correlation_id").alias("correlation"), F.encode("reactor_id", "UTF-8").alias("reactor"), "seq",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"),
    )
    pairs = F.array(
        F.struct(F.lit("correlation_id").alias("field"), F.col("correlation").alias("key")),
        F.struct(F.lit("reactor_id").alias("field"), F.col("reactor").alias("key")),
    )
    return e.select(F.explode(pairs).alias("p"), "seq", "ts").select("p.field", "p.key", "seq", "ts").filter("key is not null")



def _key_value():
    return F.when(F.col("field") == "reactor_id", F.decode("key", "UTF-8")).otherwise(id_text("key"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    total = table(spark, d, "stored_events").count()
    heavy = skew.profile(_keyed(spark, d)).filter(F.col("n") * HEAVY_ONE_IN >= total)
    return heavy.select("field", _key_value().alias("key_value"))


def p2_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Per correlation and per reactor: rows, first and last event, longest pause, and the outcomes recorded for it;
    keys with outcomes only have no rows (0) and no events."""
    outcomes = table(spark, d, "reactor_outcomes").dropDuplicates(["outcome_no"]).select(
        F.explode(F.array(
            F.struct(F.lit("correlation_id").alias("field"), id_key("correlation_id").alias("key")),
            F.struct(F.lit("reactor_id").alias("field"), F.encode("reactor_id", "UTF-8").alias("key")),
        )).alias("p"), "status",
    ).filter("p.key is not null").groupBy("p.field", "p.key").agg(
        F.count("*").alias("n_outcomes"), F.count_if(F.col("status") == "error").alias("n_errors")
    )
    p = skew.profile(_keyed(spark, d)).join(outcomes, ["field", "key"], "full_outer")
    zero = F.lit(0)
    return p.select(
        "field", _key_value().alias("key_value"), F.coalesce("n", zero).cast("bigint").alias("n"), "first_seq", "last_seq",
        F.coalesce("max_step", zero).cast("bigint").alias("longest_pause_us"),
        F.coalesce("n_outcomes", zero).cast("bigint").alias("n_outcomes"), F.coalesce("n_errors", zero).cast("bigint").alias("n_errors"),
    )


def p3_records(spark: SparkSession, d: str) -> DataFrame:
    """The supertype table of all records in both sources, read from the tables of their variants."""
    held = F.when(shred.may_hold("payload"), F.col("payload")).alias("text")
    events = table(spark, d, "stored_events").select("id", "seq", held)
    events = first_by_id(events, "text").filter("text is not null").select(id_text("key").alias("event_id"), "text")
    commits = table(spark, d, "intent_commits").select(id_key("event_id").alias("key"), F.col("aggregate_snapshots").alias("text"))
    commits = commits.filter(F.col("text").isNotNull() & shred.may_hold("text")).distinct().select(
        F.coalesce(id_text("key"), F.lit("")).alias("event_id"), "text"
    )
    return shred.route(shred.shred(events, "stored_events", per_key=False).unionByName(shred.shred(commits, "intent_commits", per_key=True)))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_records(spark, d).select("source", "event_id", "aggregate_key", "kind", "record_id", "parent_record_id")


def _subtype(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """All records of a kind, the union of its variants' tables. Their names (``p3_variants``) are no part of the answer."""
    return shred.subtype(p3_records(spark, d), kind).drop("variant")


def p3_shipments(spark: SparkSession, d: str) -> DataFrame:
    return _subtype(spark, d, "shipment")


def p3_lines(spark: SparkSession, d: str) -> DataFrame:
    return _subtype(spark, d, "line")


def p3_adjustments(spark: SparkSession, d: str) -> DataFrame:
    return _subtype(spark, d, "adjustment")


def p3_lists(spark: SparkSession, d: str) -> DataFrame:
    """The values in the records' lists."""
    return shred.lists(p3_records(spark, d))


def p3_variants(spark: SparkSession, d: str) -> DataFrame:
    return shred.variants(p3_records(spark, d))


def _month(t: str):
    return F.coalesce(F.year(t) * 12 + F.month(t) - 1, F.lit(-1)).alias("month")


def _us(t: str):
    return F.unix_micros(F.col(t).cast("timestamp")).alias("us")


def p4_references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All references, and the events by key."""
    e = table(spark, d, "stored_events").select(id_key("id").alias("key"), "seq", "ts", id_key("parent_id").alias("parent"))
    first = e.filter("key is not null").groupBy("key").agg(F.min(F.struct("seq", "ts", "parent")).alias("e")).select("key", "e.*")
    first = written(first, "first")
    holders = first.select("seq", "ts", "parent").unionByName(e.filter("key is null").select("seq", "ts", "parent")).filter("parent is not null")
    parents = holders.select(F.lit(0).alias("ref_table"), F.col("seq").alias("holder"), F.col("parent").alias("key"), _us("ts"), _month("ts"))
    triggers = table(spark, d, "reactor_outcomes").select("outcome_no", "started_at", F.explode("triggering_event_ids").alias("t")).select(
        F.lit(1).alias("ref_table"), F.col("outcome_no").alias("holder"), id_key("t").alias("key"), _us("started_at"), _month("started_at")
    ).filter("key is not null")
    return parents.unionByName(triggers), first.select("key", _us("ts"))


_TABLES = ("stored_events", "reactor_outcomes")


def _period():
    m = F.col("month")
    return F.when(m < 0, "none").otherwise(F.format_string("%04d-%02d", F.floor(m / 12), m % 12 + 1))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    references, events = p4_references(spark, d)
    tombstones = table(spark, d, "event_tombstones").select(id_key("event_id").alias("key")).filter("key is not null")
    return orphans.find(references, events, tombstones).select(
        F.when(F.col("ref_table") == 0, _TABLES[0]).otherwise(_TABLES[1]).alias("ref_table"), _period().alias("period"), "holder",
        id_text("key").alias("ref_id"), "state",
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d)


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """References in question per table, month and state."""
    return _orphans(spark, d).groupBy("ref_table", "period", "state").agg(F.count("*").alias("n_references"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    feed = incremental.ChangeFeed(spark)
    rows = feed.captured(0, table(spark, d, "pointer_status"), table(spark, d, "stored_events"))
    return rows.select("pointer_name", "seq")


def p5_runs(spark: SparkSession, d: str) -> DataFrame:
    """What two runs deliver: the first is planned when the log is readable up to the middle of its times, the rest arrives
    before its rows are read and its positions promoted, and it fails once after its rows are written and is repeated; the
    second is planned on the whole log."""
    feed = incremental.ChangeFeed(spark)
    pointers, events = table(spark, d, "pointer_status"), table(spark, d, "stored_events")
    t = F.unix_micros(F.col("ingested_at").cast("timestamp"))
    low, high = events.agg(F.min(t), F.max(t)).first()
    middle = F.lit(((low or 0) + (high or 0)) // 2)
    feed.plan(0, pointers, events.filter(t.isNull() | (t <= middle)))
    feed.write(0, feed.captured(0, pointers, events))  # and no commit
    for batch in (0, 1):
        feed.deliver(batch, feed.captured(batch, pointers, events))
        pointers = pointers.select("pointer_name", "log_partition", "active", "staged", "updated_at").unionByName(feed.positions(batch, datetime.max))
    return feed.sink().select("pointer_name", "seq")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.report(table(spark, d, "archive_lines"))


#: p6_table: the target schema that lines are ingested against; all other fields are promoted from the rescue column.
TARGET = {"qty": "double", "amount": "double", "city": "string", "channel": "string", "order_ref": "string", "active": "boolean"}


def p6_renames(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of names that are one field: the renames that the report finds and those that the upcasters tell."""
    found = p6_found(spark, d).filter("change = 'renamed'").select("old_field", "field")
    step = F.from_json("transform", "op string, `from` string, `to` string").alias("s")
    told = table(spark, d, "upcasters").select(step).filter("s.op = 'rename' and s.`from` is not null and s.`to` is not null")
    return found.union(told.select("s.from", "s.to")).distinct()


def p6_table(spark: SparkSession, d: str) -> DataFrame:
    """All archive lines as one table: every field one typed column, whatever its names; what does not fit its column's type
    is in the rescued rest. Lines are ingested against ``TARGET``, names coming together by ``p6_renames``; then the rescue
    column is replayed into one column for each other field."""
    archive = table(spark, d, "archive_lines")
    pairs = sorted((r["old_field"], r["field"]) for r in p6_renames(spark, d).collect())  # distinct names of fields
    columns, renames = drift.target(archive, pairs, TARGET)
    lines = archive.select("line_no", "producer", "segment_no", "event_type", "payload")
    approved = {c: k for c, k in columns.items() if c in TARGET}
    rest = {c: k for c, k in columns.items() if c not in approved}
    return drift.promote_all(drift.ingest(lines, approved, renames, single=True), rest, renames, single=True)


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_trees, p1_paths, p1_descendants, p2_found, p2_profiles, p3_found, p3_shipments, p3_lines, p3_adjustments, p3_lists, p3_variants, p4_found, p4_report, p5_found, p5_runs, p6_found, p6_renames, p6_table)
}
