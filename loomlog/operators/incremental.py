"""Processing only new or changed records.

Method: log-based change capture with an offset per log partition. The next batch is first written as a plan
(write-ahead: per pointer and partition the promoted offset, its time, and how far the log reached); a run that fails is
repeated from the same plan, so it captures the same rows; each batch has its own folder in the sink, which a repeated run
replaces, and the sink keeps one row per pointer, key and offset over all batches; only then is the pointer promoted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.functions.ids import id_key
from loomlog.session import BROADCAST_ROWS, partitions, scratch_path, small, written

PLAN = "pointer_name string, log_partition int, active bigint, since timestamp_ntz, upto bigint, horizon timestamp_ntz"


def promoted(pointers: DataFrame) -> DataFrame:
    """The promoted position of each pointer and partition: of the rows without ``staged`` the latest by ``updated_at``
    (ties: the higher ``active``). Rows that only staged, and rows without a time, promote nothing."""
    rows = pointers.filter("staged is null and updated_at is not null and active is not null and log_partition is not null")
    last = rows.groupBy("pointer_name", "log_partition").agg(F.max(F.struct("updated_at", "active")).alias("p"))
    return last.select("pointer_name", F.col("log_partition").cast("int").alias("log_partition"), "p.active", F.col("p.updated_at").alias("since"))


def _digest() -> Column:
    return F.unhex(F.md5("payload"))


def capture(plan: DataFrame, events: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """``pointer_name, key, seq, log_partition`` of all rows the plan's batch must process, each once.

    A row is new to a pointer if its ``seq`` is above the promoted one, or it became readable after the promotion; a row
    without ``ingested_at`` goes by its ``seq`` alone; a null horizon (no row of the partition has a time) bounds nothing. Of
    the new rows those are left out whose id has a row of lower ``seq`` with the same payload (null equals null) anywhere in
    the log. The new rows are found first, by conditions that reach the scan; of the history only the rows of their ids are
    kept, map-side while the ids are few enough to broadcast, and only those are compared.
    """
    new = "(seq > active or ingested_at > since) and seq <= upto and (ingested_at is null or horizon is null or ingested_at <= horizon)"
    low = plan.agg(F.min("active").alias("active"), F.min("since").alias("since"), F.count("*").alias("n")).first()
    columns = [id_key("id").alias("key"), "payload", "seq", "ingested_at", F.col("log_partition").cast("int").alias("log_partition")]
    reach = events.filter((F.col("seq") > low["active"]) | (F.col("ingested_at") > F.lit(low["since"]).cast("timestamp_ntz"))) if low["n"] else events.limit(0)
    rows = reach.select(*columns).withColumn("digest", F.when(F.col("key").isNotNull(), _digest())).drop("payload")
    if low["n"] <= bound:
        out = rows.join(F.broadcast(plan), "log_partition")
    else:  # too many positions to broadcast: spread each partition of the log over salts
        salts = partitions(plan.sparkSession)
        salted = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        out = rows.withColumn("salt", F.pmod(F.xxhash64("seq"), F.lit(salts)).cast("int")).join(salted, ["log_partition", "salt"])
    found = written(out.filter(new).select("pointer_name", "key", "digest", "seq", "log_partition"), "candidates")
    ids = found.select("key").filter("key is not null").distinct()
    history = events.select(id_key("id").alias("key"), "payload", "seq").join(small(written(ids, "ids"), bound), "key", "left_semi")
    first = history.select("key", _digest().alias("digest"), "seq").groupBy("key", "digest").agg(F.min("seq").alias("first"))
    same = F.col("c.key").eqNullSafe(F.col("h.key")) & F.col("c.digest").eqNullSafe(F.col("h.digest")) & (F.col("c.seq") > F.col("h.first"))
    kept = found.filter("key is not null").alias("c").join(first.alias("h"), same, "left_anti")
    # rows with one id, payload and seq say the same; each pointer gets one of them
    kept = kept.dropDuplicates(["pointer_name", "key", "digest", "seq"]).unionByName(found.filter("key is null"))
    return kept.select("pointer_name", "key", "seq", "log_partition")


class ChangeFeed:
    """One feed: a folder with the written plans, the sink and the committed batches."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or scratch_path(spark, "feed")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        p, fs = self._fs(path)
        return fs.exists(p)

    def plan(self, batch: int, pointers: DataFrame, events: DataFrame) -> DataFrame:
        """The plan of ``batch``: the one already written, if a run before wrote it and failed, else a new one."""
        at = f"{self.path}/plans/{batch}"
        if not self._exists(f"{at}/_SUCCESS"):
            reach = events.groupBy(F.col("log_partition").cast("int").alias("log_partition")).agg(F.max("seq").alias("upto"), F.max("ingested_at").alias("horizon"))
            made = promoted(pointers).join(reach, "log_partition").select(
                "pointer_name", "log_partition", "active", "since", "upto", "horizon"
            )
            made.coalesce(1).write.mode("overwrite").parquet(at)
        return self.spark.read.schema(PLAN).parquet(at)

    def captured(self, batch: int, pointers: DataFrame, events: DataFrame) -> DataFrame:
        return capture(self.plan(batch, pointers, events), events)

    def write(self, batch: int, rows: DataFrame) -> None:
        """Write a batch's rows to its folder of the sink, in place of what a failed run left there, without those that other
        batches have delivered. Only the delivered rows of the same pointers and keys are compared, from the lowest new
        ``seq`` on."""
        same = ["pointer_name", "key", "seq"]
        rows = written(rows.dropDuplicates(same), "batch")
        at = f"{self.path}/sink/batch={batch}"
        others = self._delivered().filter(F.col("batch") != batch) if self._exists(f"{self.path}/sink") else None
        if others is not None:
            low = rows.agg(F.min("seq")).first()[0]
            have = others.filter(F.col("seq") >= (low if low is not None else 0)).select(*same)
            have = have.join(small(rows.select("pointer_name", "seq").distinct()), ["pointer_name", "seq"], "left_semi")
            cond = [F.col("n.pointer_name") == F.col("h.pointer_name"), F.col("n.key").eqNullSafe(F.col("h.key")), F.col("n.seq") == F.col("h.seq")]
            rows = rows.alias("n").join(have.alias("h"), cond, "left_anti")
        rows.write.mode("overwrite").parquet(at)

    def deliver(self, batch: int, rows: DataFrame) -> None:
        """Write a batch's rows to the sink; then the batch is committed."""
        self.write(batch, rows)
        p, fs = self._fs(f"{self.path}/commits/{batch}")
        fs.create(p, True).close()

    def committed(self, batch: int) -> bool:
        return self._exists(f"{self.path}/commits/{batch}")

    def _delivered(self) -> DataFrame:
        return self.spark.read.schema("pointer_name string, key binary, seq bigint, log_partition int, batch int").parquet(f"{self.path}/sink")

    def sink(self) -> DataFrame:
        return self._delivered().drop("batch")

    def positions(self, batch: int, now) -> DataFrame:
        """The rows that promote the pointers after a committed batch. ``updated_at`` is the plan's own horizon (or ``now``,
        should that be earlier; without a horizon the time promoted before): what became readable after the plan was
        written is in no batch yet, and the next plan must find it after ``since``, however low its ``seq``. A horizon before
        ``since`` promotes nothing, and the sink keeps the rows that are then captured again from a second delivery."""
        plan = self.spark.read.schema(PLAN).parquet(f"{self.path}/plans/{batch}")
        return plan.select(
            "pointer_name", "log_partition", F.greatest("active", "upto").alias("active"), F.lit(None).cast("bigint").alias("staged"),
            F.least(F.coalesce("horizon", "since"), F.lit(now).cast("timestamp_ntz")).alias("updated_at"),
        )
