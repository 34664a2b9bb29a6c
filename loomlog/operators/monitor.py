"""Operational metrics of the queue, the executions and the log."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlog.session import partitions, written


def _ago(now: Column, minutes: int) -> Column:
    return now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))


def pending_depth(executions: DataFrame) -> DataFrame:
    return executions.agg(F.count_if(F.col("status") == "running").alias("pending"))


def failure_rate(executions: DataFrame, now: Column, minutes: int = 5) -> DataFrame:
    """Failed share of the executions that ended lately; null when there are none."""
    ended = executions.filter((F.col("completed_at") > _ago(now, minutes)) & (F.col("completed_at") <= now))
    return ended.agg(F.round(F.avg(F.when(F.col("status") == "error", 1.0).otherwise(0.0)), 6).alias("failure_rate"), F.count("*").alias("ended"))


def active_workflows(log: DataFrame, now: Column, minutes: int) -> DataFrame:
    return log.filter((F.col("created_at") > _ago(now, minutes)) & (F.col("created_at") <= now)).agg(F.count_distinct("correlation_id").alias("active"))


def percentiles(rows: DataFrame, group: str, value: str, ps: dict[str, float], parts: int | None = None) -> DataFrame:
    """Exact interpolated percentiles of each group, however large: rows are range-partitioned by (group, value), ranked
    inside the partitions and shifted by the counts before, and only the rows at the wanted ranks are kept. Nulls are left
    out; a group without values gives no row."""
    rows = rows.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).filter("g is not null and v is not null")
    placed = rows.repartitionByRange(parts or partitions(rows.sparkSession), "g", "v").withColumn("_p", F.spark_partition_id())
    placed = written(placed, "percentiles")  # sampled bounds: count and ranks must see the same partitions
    by = Window.partitionBy("g")
    counts = placed.groupBy("g", "_p").agg(F.count("*").alias("_n")).select(
        "g", "_p", (F.sum("_n").over(by.orderBy("_p")) - F.col("_n")).alias("_before"), F.sum("_n").over(by).alias("_all")
    )
    ranked = placed.withColumn("_i", F.row_number().over(Window.partitionBy("g", "_p").orderBy("v")) - 1).join(counts, ["g", "_p"])
    rank, last = F.col("_before") + F.col("_i"), F.col("_all") - 1
    wanted = [(n, F.lit(p) * last) for n, p in ps.items()]
    hit = [(rank == F.floor(at)) | (rank == F.ceil(at)) for _, at in wanted]
    kept = ranked.filter(functools.reduce(lambda a, b: a | b, hit))
    out = []
    for n, at in wanted:
        low = F.max(F.when(rank == F.floor(at), F.col("v")))
        high = F.max(F.when(rank == F.ceil(at), F.col("v")))
        share = F.max(at - F.floor(at))
        out.append((low + (high - low) * share).alias(n))
    return kept.groupBy(F.col("g").alias(group)).agg(*out)


def latency_percentiles(executions: DataFrame) -> DataFrame:
    """Per reactor p50, p95 and p99 of the run time in microseconds, interpolated."""
    us = F.unix_micros(F.col("completed_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))
    p = percentiles(executions.select("reactor_id", us.alias("us")), "reactor_id", "us", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return p.select("reactor_id", *(F.round(n, 3).alias(n) for n in ("p50", "p95", "p99")))


def latency_percentiles_approx(executions: DataFrame, accuracy: int = 10_000) -> DataFrame:
    us = F.unix_micros(F.col("completed_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))
    p = executions.filter("completed_at is not null").groupBy("reactor_id").agg(F.percentile_approx(us, [0.5, 0.95, 0.99], accuracy).alias("p"))
    return p.select("reactor_id", *(F.col("p")[i].alias(n) for i, n in enumerate(("p50", "p95", "p99"))))


def oversized_payloads(log: DataFrame, characters: int) -> DataFrame:
    return log.filter(F.length("payload") > characters).select("event_id", "event_type", F.length("payload").cast("bigint").alias("size"))


def stale(executions: DataFrame, now: Column, minutes: int = 3) -> DataFrame:
    """Executions still running that started too long ago."""
    return executions.filter((F.col("status") == "running") & (F.col("started_at") < _ago(now, minutes)))


def by_error(dlq: DataFrame) -> DataFrame:
    return dlq.groupBy("error").agg(F.count("*").alias("n"))


def by_reason(dlq: DataFrame) -> DataFrame:
    return dlq.groupBy("reason", "reactor_id").agg(F.count("*").alias("n"), F.count_distinct("correlation_id").alias("workflows"))


def queue_status(executions: DataFrame) -> DataFrame:
    """Per correlation: pending and dead-lettered executions."""
    return executions.groupBy("correlation_id").agg(
        F.count_if(F.col("status") == "running").alias("pending"), F.count_if(F.col("status") == "error").alias("dead_lettered")
    )


def retention(rows: DataFrame, at: str, cutoff: Column) -> tuple[DataFrame, DataFrame]:
    """(rows to keep, rows to archive): older than the cutoff."""
    old = F.coalesce(F.col(at) < cutoff, F.lit(False))
    return rows.filter(~old), rows.filter(old)
