"""Lineage trees and flow graphs of a log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.operators import hierarchy
from loomlog.session import written

_SIGN = -(1 << 63)


def correlation_of(log: DataFrame, position: int) -> DataFrame:
    return log.filter((F.col("position") == position) & F.col("correlation_id").isNotNull()).select("correlation_id").limit(1)


def lineage_tree(log: DataFrame, position: int) -> DataFrame:
    """All events of the correlation of one event, each with ``root_position``: the first parentless event's position, or
    the given one where there is none. An unknown position gives no rows."""
    tree = log.join(F.broadcast(correlation_of(log, position)), "correlation_id", "left_semi")
    root = tree.agg(F.min(F.when(F.col("parent_id").isNull(), F.col("position")))).first()[0]
    return tree.withColumn("root_position", F.lit(position if root is None else root).cast("bigint"))


def lineage_flow(log: DataFrame, correlation_id: str) -> DataFrame:
    return log.filter(F.col("correlation_id") == correlation_id)


def edges(log: DataFrame) -> DataFrame:
    """Parent and child of every link inside the log."""
    up = log.select(F.col("event_id").alias("parent_id"), F.col("position").alias("parent_position"), F.col("event_type").alias("parent_type"))
    return log.select("event_id", "position", "event_type", "reactor_id", "correlation_id", "parent_id").join(up, "parent_id")


def roots(log: DataFrame) -> DataFrame:
    """Events without a parent, or whose parent is not in the log."""
    known = log.select(F.col("event_id").alias("parent_id"))
    orphans = log.filter("parent_id is not null").join(known, "parent_id", "left_anti")
    return log.filter("parent_id is null").unionByName(orphans.select(log.columns))


def _ordered_key(c: str) -> Column:
    """A bigint as 8 bytes that order as the numbers do."""
    return F.unhex(F.lpad(F.hex(F.col(c).cast("bigint").bitwiseXOR(F.lit(_SIGN))), 16, "0"))


def _number(key: str) -> Column:
    return F.conv(F.hex(key), 16, -10).cast("bigint").bitwiseXOR(F.lit(_SIGN))


def _resolved(log: DataFrame, parent: Column) -> DataFrame:
    nodes = log.select(_ordered_key("event_id").alias("key"), parent.alias("parent"), F.col("position").alias("ord"))
    return hierarchy.resolve(nodes).select(_number("key").alias("event_id"), _number("top").alias("root_id"), "depth")


def depths(log: DataFrame) -> DataFrame:
    """``event_id``, ``root_id`` and ``depth`` (hops) of every event, by contraction (see ``hierarchy``). On a loop, and below
    one, the root is the loop's smallest id and the depth -1."""
    return _resolved(log, _ordered_key("parent_id"))


def subtree(log: DataFrame, position: int) -> DataFrame:
    """The event at a position and all its descendants in its correlation, each with its level, however deep.

    The event's own parent link is cut, so it is the root of its subtree, also where it stands on a loop; one contraction
    then gives every level. An unknown position gives no rows.
    """
    tree = log.join(F.broadcast(correlation_of(log, position)), "correlation_id", "left_semi")
    tree = written(tree.select("event_id", "parent_id", "position", "event_type"), "tree")
    top = tree.filter(F.col("position") == position).select(F.col("event_id").alias("root_id"))
    below = _resolved(tree, F.when(F.col("position") != position, _ordered_key("parent_id"))).join(F.broadcast(top), "root_id", "left_semi")
    return tree.join(below.filter("depth >= 0").select("event_id", F.col("depth").cast("int").alias("level")), "event_id")


def critical_paths(log: DataFrame) -> DataFrame:
    """Per correlation the chain that ends last: its leaf, hops, and the time from its root to the leaf."""
    resolved = depths(log)
    at = log.select("event_id", "correlation_id", "created_at", "position")
    start = at.select(F.col("event_id").alias("root_id"), F.col("created_at").alias("root_at"))
    rows = resolved.join(at, "event_id").join(start, "root_id")
    span = (F.unix_micros(F.col("created_at").cast("timestamp")) - F.unix_micros(F.col("root_at").cast("timestamp"))).alias("span_us")
    best = F.max(F.struct(span, (-F.col("position")).alias("p"), "event_id", "depth")).alias("b")
    return rows.groupBy("correlation_id").agg(best).select("correlation_id", F.col("b.event_id").alias("leaf_id"), F.col("b.depth").alias("hops"), F.col("b.span_us").alias("span_us"))


def children_by_reactor(log: DataFrame) -> DataFrame:
    """Children of each event per reactor that emitted them ('' for direct ones)."""
    return log.filter("parent_id is not null").groupBy("parent_id", F.coalesce("reactor_id", F.lit("")).alias("reactor_id")).agg(
        F.count("*").alias("n_children"), F.min("position").alias("first_position")
    )


def flow_nodes(log: DataFrame, executions: DataFrame) -> DataFrame:
    """Nodes of the flow graph: event types with their counts, and reactors, also those only seen in outcomes."""
    types = log.groupBy(F.col("event_type").alias("node")).agg(F.count("*").alias("n")).select(F.lit("event").alias("kind"), "node", "n")
    ran = log.filter("reactor_id is not null").groupBy(F.col("reactor_id").alias("node")).agg(F.count("*").alias("n"))
    only = executions.select(F.col("reactor_id").alias("node")).distinct()
    reactors = only.join(ran, "node", "full_outer").select(F.lit("reactor").alias("kind"), "node", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    return types.unionByName(reactors)


def flow_edges(log: DataFrame, hidden: list[str] | None = None) -> DataFrame:
    """Distinct edges event type -> reactor (over the parent link) and reactor -> event type.

    ``hidden`` reactors are taken out, with the event types that only they emit.
    """
    e = edges(log).filter("reactor_id is not null").select("parent_type", "reactor_id", "event_type").distinct()
    if hidden:
        emitted = e.groupBy(F.col("event_type").alias("t")).agg(F.min(F.col("reactor_id").isin(hidden)).alias("only_hidden"))
        gone = emitted.filter("only_hidden").select("t")
        e = e.filter(~F.col("reactor_id").isin(hidden))
        e = e.join(gone, e["parent_type"] == gone["t"], "left_anti").join(gone, e["event_type"] == gone["t"], "left_anti")
    into = e.select(F.col("parent_type").alias("source"), F.col("reactor_id").alias("target"))
    out = e.select(F.col("reactor_id").alias("source"), F.col("event_type").alias("target"))
    return into.unionByName(out).distinct()
