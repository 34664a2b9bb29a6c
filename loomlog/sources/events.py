"""The stored event log and its companions, read with canonical keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.functions.ids import id_key
from loomlog.session import table


def first_by_id(events: DataFrame, *columns: str) -> DataFrame:
    """*The* event of each id: the row with the lowest ``seq``. Rows without an id are left out.

    Result: ``key`` (binary), ``seq`` and ``columns`` of that row. One shuffle on the key.
    """
    rows = events.select(id_key("id").alias("key"), "seq", *columns).filter("key is not null")
    first = F.min(F.struct("seq", *columns)) if columns else F.min(F.struct("seq"))
    return rows.groupBy("key").agg(first.alias("e")).select("key", "e.*")


def stored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "stored_events")
