"""The append-only event log as DataFrames: cursor reads, point lookups, searches, idempotent append, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlog.operators import ordered
from loomlog.session import small, written

#: The largest pages of the two read paths.
MAX_PAGE, MAX_FEED = 200, 500


def load_from(log: DataFrame, after: int, limit: int) -> DataFrame:
    """The first ``limit`` events after a position (gaps between positions are legal)."""
    return log.filter(F.col("position") > after).orderBy("position").limit(limit)


def load_stream(log: DataFrame, aggregate_type: str, aggregate_id, after_version: int | None = None) -> DataFrame:
    """One aggregate's events after a version; a null version counts as 0."""
    return log.filter(
        (F.col("aggregate_type") == aggregate_type) & (F.col("aggregate_id") == aggregate_id) & (F.coalesce("version", F.lit(0)) > (after_version or 0))
    )


def latest_position(log: DataFrame) -> DataFrame:
    """One row; 0 for an empty log."""
    return log.agg(F.coalesce(F.max("position"), F.lit(0)).cast("bigint").alias("position"))


def get_event(log: DataFrame, position: int) -> DataFrame:
    return log.filter(F.col("position") == position)


def events_from(log: DataFrame, start: int, limit: int) -> DataFrame:
    """Events from a position on (inclusive), at most ``MAX_FEED``."""
    return log.filter(F.col("position") >= start).orderBy("position").limit(min(limit, MAX_FEED))


def matches(term: str, *columns: str) -> Column:
    """Case-insensitive: does any column contain the term, taken literally?"""
    needle = F.lit(term.lower())
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), needle), F.lit(False))
    return hit


def list_events(log: DataFrame, limit: int, cursor=None, since=None, until=None, correlation_id=None, search=None) -> DataFrame:
    """A page, newest first. ``since`` and ``until`` are inclusive, ``cursor`` (a position) exclusive; filters that are
    not given are not in the plan."""
    q = log
    if cursor is not None:
        q = q.filter(F.col("position") < cursor)
    if since is not None:
        q = q.filter(F.col("created_at") >= F.lit(since).cast("timestamp_ntz"))
    if until is not None:
        q = q.filter(F.col("created_at") <= F.lit(until).cast("timestamp_ntz"))
    if correlation_id is not None:
        q = q.filter(F.col("correlation_id") == correlation_id)
    if search:
        q = q.filter(matches(search, "event_type", "payload", "correlation_id"))
    return q.orderBy(F.desc("position")).limit(min(limit, MAX_PAGE))


def page(log: DataFrame, limit: int, **filters) -> tuple[list, int | None]:
    """(rows, next cursor): the cursor is the last row's position if the page is full, else None."""
    rows = list_events(log, limit, **filters).collect()
    return rows, rows[-1]["position"] if rows and len(rows) == min(limit, MAX_PAGE) else None


def most_recent(log: DataFrame, capacity: int) -> DataFrame:
    """What a bounded cache with first-in-first-out eviction holds."""
    return log.orderBy(F.desc("position")).limit(capacity)


def append(log: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """The rows to write for ``new`` events: known ids and repeats are left out (append is idempotent by ``event_id``), the
    others get the next positions and versions. Only the new rows are numbered; of the log one maximum and, per touched
    aggregate, one count are taken.

    Positions come from one global numbering of the new rows; versions are contiguous per aggregate.
    """
    first = Window.partitionBy("event_id").orderBy(order)
    fresh = new.withColumn("_nth", F.row_number().over(first)).filter("_nth = 1").drop("_nth").join(log.select("event_id"), "event_id", "left_anti")
    # Number the rows inside range partitions, then shift each partition by those before: no global sort in one task. The
    # partitions are written first, because range bounds are sampled and may differ when computed again.
    placed = fresh.repartitionByRange(order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id())
    placed = written(placed, "append")
    top = log.agg(F.coalesce(F.max("position"), F.lit(0)).alias("top")).first()["top"]
    counted = placed.withColumn("_nth", F.row_number().over(Window.partitionBy("_part").orderBy("_id")))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = placed.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    numbered = counted.join(shifts, "_part").withColumn("position", (F.lit(top) + F.col("_shift") + F.col("_nth")).cast("bigint"))
    touched = numbered.select("aggregate_type", "aggregate_id").distinct()
    have = log.join(touched, ["aggregate_type", "aggregate_id"], "left_semi").groupBy("aggregate_type", "aggregate_id").agg(F.max("version").alias("_have"))
    versioned = ordered.numbered(numbered.join(small(have), ["aggregate_type", "aggregate_id"], "left"), ["aggregate_type", "aggregate_id"], ["position"], "_v")
    version = F.when(F.col("aggregate_id").isNotNull(), F.coalesce("_have", F.lit(0)) + F.col("_v")).cast("bigint")
    return versioned.withColumn("version", version).select("position", *new.columns, "version")


def append_expected(log: DataFrame, new: DataFrame, expected: DataFrame) -> DataFrame:
    """Optimistic concurrency: of ``new`` the rows whose aggregate still stands at the version ``expected`` names
    (``aggregate_type, aggregate_id, expected_version``; 0 for a new aggregate). Others are conflicts."""
    keys = ["aggregate_type", "aggregate_id"]
    now = log.join(expected.select(*keys), keys, "left_semi").groupBy(*keys).agg(F.max("version").alias("_now"))
    ok = expected.join(now, keys, "left").filter(F.coalesce("_now", F.lit(0)) == F.col("expected_version"))
    return new.join(ok.select(*keys), keys, "left_semi")


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    """Per aggregate the snapshot of the highest version."""
    rest = [c for c in snapshots.columns if c not in ("aggregate_type", "aggregate_id", "version")]
    best = F.max(F.struct("version", *rest)).alias("s")
    return snapshots.groupBy("aggregate_type", "aggregate_id").agg(best).select("aggregate_type", "aggregate_id", "s.*")
