"""A stored event log: Parquet folders by day, written by idempotent appends, read as a table or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomlog.sources import log as L

SCHEMA = (
    "position bigint, event_id string, parent_id string, correlation_id string, event_type string, payload string, created_at timestamp_ntz, "
    "aggregate_type string, aggregate_id string, metadata map<string,string>, persistent boolean, version bigint"
)


def _filled(events: DataFrame) -> DataFrame:
    """``events`` with all columns of the stored schema but position and version."""
    default = {"metadata": F.create_map().cast("map<string,string>"), "persistent": F.lit(True)}
    for f in StructType.fromDDL(SCHEMA).fields:
        if f.name not in ("position", "version"):
            own = F.col(f.name).cast(f.dataType) if f.name in events.columns else F.lit(None).cast(f.dataType)
            events = events.withColumn(f.name, F.coalesce(own, default[f.name]) if f.name in default else own)
    return events


class StoredLog:
    """One writer at a time; rows are partitioned by day, so time filters prune folders, and sorted by position inside."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.schema = StructType.fromDDL(SCHEMA)

    def _there(self) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def table(self) -> DataFrame:
        if not self._there():
            return self.spark.createDataFrame([], self.schema).withColumn("day", F.to_date("created_at"))
        return self.spark.read.schema(SCHEMA + ", day date").parquet(self.path)

    def stream(self, files_per_batch: int | None = None) -> DataFrame:
        r = self.spark.readStream.schema(SCHEMA + ", day date")
        return (r.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else r).parquet(self.path)

    def append(self, new: DataFrame, order: str) -> int:
        """Append events that are not there yet; the number of new ones. ``new`` has the schema without position and
        version, and ``order`` names the column that orders it."""
        columns = [f.name for f in self.schema.fields if f.name not in ("position", "version")]
        rows = L.append(self.table(), new.select(*columns, F.col(order).alias("_order")), "_order")
        from loomlog.session import written

        rows = written(rows, "append")
        n = rows.count()
        if n:
            rows.select(*[f.name for f in self.schema.fields]).withColumn("day", F.to_date("created_at")).sortWithinPartitions("day", "position").write.mode("append").partitionBy("day").parquet(self.path)
        return n

    def persist(self, events: DataFrame, aggregate_type: str, aggregate_id: str, order: str) -> int:
        """Append events to the streams of one aggregate type; ``aggregate_id`` names the column with the stream."""
        of = events.withColumns({"aggregate_type": F.lit(aggregate_type), "aggregate_id": F.col(aggregate_id).cast("string")})
        return self.append(_filled(of), order)

    def emit_output(self, outputs: DataFrame, order: str) -> int:
        """Append prepared rows of any event type as they are: what they lack is filled with nulls, metadata with an empty
        map, and they are persistent unless they say otherwise. Repeats of known ids are no new events."""
        return self.append(_filled(outputs), order)

    def next_partition(self, day: str) -> str:
        """Make the folder of a day before its first event comes; its path. An existing one is left as it is."""
        at = f"{self.path}/day={day}"
        p = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(p)
        return at

    def archive(self, before: str, to: str) -> dict[str, int]:
        """Move the days before a date to another folder: they are copied, counted there, and only then deleted here, folder
        by folder, so a run that fails can be repeated. Events without a time have no day and stay. Returns ``archived`` and
        ``kept`` rows."""
        old = self.table().filter(F.col("day") < F.lit(before).cast("date"))
        days = [str(r["day"]) for r in old.select("day").distinct().collect()]  # one per folder
        if days:
            old.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(to)
        done = 0
        if days:
            schema = SCHEMA + ", day date"
            copied = self.spark.read.schema(schema).parquet(to).filter(F.col("day").cast("string").isin(days))
            done, have = copied.count(), old.count()
            if done != have:
                raise RuntimeError(f"{have} rows to archive, {done} copied")
            for d in days:
                p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/day={d}")
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        return {"archived": done, "kept": self.table().count()}

    def load_from(self, after: int, limit: int) -> DataFrame:
        return L.load_from(self.table(), after, limit)

    def load_stream(self, aggregate_type: str, aggregate_id, after_version: int | None = None) -> DataFrame:
        return L.load_stream(self.table(), aggregate_type, aggregate_id, after_version)

    def latest_position(self) -> int:
        return L.latest_position(self.table()).first()[0]
