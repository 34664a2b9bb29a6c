"""Event-time windows over a stream or table of the log: extensions beyond the engine's own surface."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts(events: DataFrame, time: str, length: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Events per type and tumbling or sliding window; what comes later than ``late`` is left out of a stream."""
    e = events.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", late)
    w = F.window("_at", length, slide) if slide else F.window("_at", length)
    return e.groupBy(w, "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n")


def sessions(events: DataFrame, key: str, time: str, gap: str) -> DataFrame:
    e = events.withColumn("_at", F.col(time).cast("timestamp"))
    return e.groupBy(key, F.session_window("_at", gap)).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), "n")
