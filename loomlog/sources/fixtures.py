"""The driver's plain tables read as an event log, its executions and an order stream (see FIXTURES.md, part B)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomlog.operators import ordered
from loomlog.session import table, written

_kept: dict[tuple, DataFrame] = {}


def hydrated(spark: SparkSession, d: str, name: str, make) -> DataFrame:
    """A derived table, written once per application and folder and then read like any stored one."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _kept:
        _kept[key] = written(make(spark, d), name)
    return _kept[key]


def _events_log(spark: SparkSession, d: str) -> DataFrame:
    e = ordered.neighbours(table(spark, d, "events"), ["user_id"], ["event_id"], {"before": "ts"})
    e = ordered.numbered(e, ["user_id"], ["event_id"], "version")
    fresh = F.col("before").isNull() | (F.col("ts") > F.col("before") + F.expr("INTERVAL 12 HOURS"))
    e = ordered.running_sum(e.withColumn("fresh", fresh.cast("bigint")), ["user_id"], ["event_id"], "sess", "fresh")
    e = ordered.numbered(e, ["user_id", "sess"], ["event_id"], "rn")
    up = e.select(
        F.col("user_id").alias("pu"), F.col("sess").alias("ps"), F.col("rn").alias("pn"), F.col("event_id").alias("parent_id"), F.col("event_type").alias("parent_type")
    )
    link = (F.col("user_id") == F.col("pu")) & (F.col("sess") == F.col("ps")) & (F.floor(F.col("rn") / 2) == F.col("pn"))
    return e.join(up, link, "left").select(
        (F.col("event_id") + 1).alias("position"), "event_id", "parent_id",
        F.concat(F.lit("u"), "user_id", F.lit("-"), "sess").alias("correlation_id"),
        F.concat(F.lit("activity:"), "event_type").alias("event_type"), F.col("props").alias("payload"),
        F.col("ts").alias("created_at"), "value", F.lit("User").alias("aggregate_type"), F.col("user_id").alias("aggregate_id"), "version",
        F.when(F.col("parent_id").isNotNull(), F.concat(F.lit("on_"), "parent_type", F.lit("_"), F.col("rn") % 2)).alias("reactor_id"),
        (F.col("event_type") != "view").alias("persistent"),
    )


def events_log(spark: SparkSession, d: str) -> DataFrame:
    return hydrated(spark, d, "events_log", _events_log)


def _executions(spark: SparkSession, d: str) -> DataFrame:
    log = events_log(spark, d)
    trigger = log.select(F.col("event_id").alias("parent_id"), F.col("created_at").alias("started_at"))
    error, view = F.col("event_type") == "activity:error", F.col("event_type") == "activity:view"
    return log.join(trigger, "parent_id").select(
        F.col("parent_id").alias("event_id"), "reactor_id", "correlation_id", "started_at",
        F.when(error, "error").when(view, "running").otherwise("completed").alias("status"),
        F.when(~view, F.col("created_at")).alias("completed_at"),
        F.when(error, F.concat(F.lit("boom-"), F.col("position") % 5)).alias("error"), (F.col("position") % 3).cast("int").alias("attempts"),
        "position", F.col("event_type").alias("child_type"),
    )


def executions(spark: SparkSession, d: str) -> DataFrame:
    return hydrated(spark, d, "executions", _executions)


def reactor_logs(spark: SparkSession, d: str) -> DataFrame:
    """One log row per execution."""
    level = F.element_at(F.array(F.lit("DEBUG"), F.lit("INFO"), F.lit("WARN")), (F.col("position") % 3 + 1).cast("int"))
    return executions(spark, d).select(
        "event_id", "reactor_id", "correlation_id", level.alias("level"), F.col("child_type").alias("message"), F.col("started_at").alias("logged_at"), "position"
    )


def order_stream(spark: SparkSession, d: str) -> DataFrame:
    """Two event families of one aggregate: an order placed, and its lines shipped or returned."""
    zero = F.lit(0).cast("bigint")
    placed = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("aggregate_id"), F.lit(0).alias("k"), F.lit(0).alias("ln"), zero.alias("pk"), zero.alias("sk"),
        F.col("o_totalprice").alias("amt"), F.col("o_orderdate").alias("ts"), F.lit("order_placed").alias("event_type"),
    )
    lines = table(spark, d, "lineitem").select(
        F.col("l_orderkey"), F.lit(1), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_extendedprice"), F.col("l_shipdate"),
        F.when(F.col("l_returnflag") == "R", "line:returned").otherwise("line:shipped"),
    )
    order = Window.partitionBy("aggregate_id").orderBy("k", "ln", "pk", "sk", "amt", "ts", "event_type")
    return placed.union(lines).withColumn("version", F.row_number().over(order).cast("bigint"))
