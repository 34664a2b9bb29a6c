"""The work queue as append-only tables in a shared folder: intents, transitions, journal, descriptions, states, checkpoint.

Every call writes under its own batch name and commits last; a batch without its commit marker is not read, and a repeated
batch overwrites its own folders, so a failed call can simply be made again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.operators.dataflow import last_status

SCHEMAS = {
    "intents": "event_id string, reactor_id string, correlation_id string, execute_at timestamp_ntz, timeout_seconds int, max_attempts int, priority int, hops int",
    "transitions": "event_id string, reactor_id string, at bigint, status string, attempts int, error string",
    "journal": "event_id string, reactor_id string, seq bigint, value string",
    "cleared": "event_id string, reactor_id string, seq bigint",
    "descriptions": "correlation_id string, reactor_id string, event_id string, at bigint, description string",
    "states": "event_id string, aggregate_key string, state string, at bigint",
    "checkpoints": "checkpoint bigint",
    "cancellations": "correlation_id string, cancelled_at timestamp_ntz",
}


class Queue:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _fs(self, at: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _batches(self) -> list[str]:
        p, fs = self._fs(f"{self.path}/commits")
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def commit(self, batch: str, **tables: DataFrame) -> None:
        """Write the tables of one batch, then its marker; a batch that is committed already is left as it is."""
        p, fs = self._fs(f"{self.path}/commits/{batch}")
        if fs.exists(p):
            return
        for name, df in tables.items():
            columns = [c.split()[0] for c in SCHEMAS[name].split(", ")]
            df.select(*columns).write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")
        fs.create(p, True).close()

    def read(self, name: str) -> DataFrame:
        """The rows of all committed batches: one listing of the table and one of the markers, however many batches there are."""
        p, fs = self._fs(f"{self.path}/{name}")
        if not fs.exists(p):
            return self.spark.createDataFrame([], SCHEMAS[name])
        rows = self.spark.read.schema(f"{SCHEMAS[name]}, batch string").parquet(f"{self.path}/{name}")
        done = self.spark.createDataFrame([(b,) for b in self._batches()], "batch string")
        return rows.join(F.broadcast(done), "batch", "left_semi").drop("batch")

    def enqueue(self, batch: str, commits: DataFrame) -> None:
        """Commits of processed events (columns of ``intent_commits``): their intents, descriptions, states and checkpoint."""
        c = commits.dropDuplicates(["event_id"])
        self.commit(
            batch, intents=intents(c), descriptions=descriptions(c), states=states(c), checkpoints=c.agg(F.max("checkpoint").alias("checkpoint")).filter("checkpoint is not null")
        )

    def checkpoint(self) -> int:
        return self.read("checkpoints").agg(F.coalesce(F.max("checkpoint"), F.lit(0))).first()[0]

    def pending(self) -> DataFrame:
        """Intents whose newest transition has not ended them; with their attempts so far."""
        last = self.read("transitions").groupBy("event_id", "reactor_id").agg(F.max(F.struct("at", "status", "attempts")).alias("t"))
        q = self.read("intents").dropDuplicates(["event_id", "reactor_id"]).join(last, ["event_id", "reactor_id"], "left")
        return q.filter("t is null or t.status = 'retry'").withColumn("attempts", F.coalesce("t.attempts", F.lit(0))).drop("t")

    def resolve(self, batch: str, results: DataFrame) -> int:
        """Write transitions (complete, retry, dead_letter); those of executions never queued are dropped and counted."""
        known = self.read("intents").select("event_id", "reactor_id").distinct()
        self.commit(batch, transitions=results.join(known, ["event_id", "reactor_id"], "left_semi"))
        return results.join(known, ["event_id", "reactor_id"], "left_anti").count()

    def statuses(self) -> DataFrame:
        """The status of every queued execution: that of its newest transition, ``pending`` where it has none."""
        last = last_status(self.read("transitions"), ["event_id", "reactor_id"], "at", ["status", "attempts", "error"])
        q = self.read("intents").select("event_id", "reactor_id").distinct().join(last, ["event_id", "reactor_id"], "left")
        return q.select("event_id", "reactor_id", F.coalesce("status", F.lit("pending")).alias("status"), F.coalesce("attempts", F.lit(0)).alias("attempts"), "error")

    def dead_letters(self) -> DataFrame:
        last = self.read("transitions").groupBy("event_id", "reactor_id").agg(F.max(F.struct("at", "status", "attempts", "error")).alias("t"))
        return last.filter("t.status = 'dead_letter'").select("event_id", "reactor_id", "t.attempts", "t.error")

    def journal(self) -> DataFrame:
        """Journal entries of executions that have not completed; of a repeated sequence number the first counts."""
        done = self.read("transitions").filter("status = 'complete'").select("event_id", "reactor_id").distinct()
        gone = self.read("cleared").groupBy("event_id", "reactor_id").agg(F.max("seq").alias("_upto"))
        rows = self.read("journal").groupBy("event_id", "reactor_id", "seq").agg(F.min("value").alias("value")).join(done, ["event_id", "reactor_id"], "left_anti")
        return rows.join(gone, ["event_id", "reactor_id"], "left").filter("_upto is null or seq > _upto").drop("_upto")

    def clear_journal(self, batch: str, executions: DataFrame) -> None:
        """Forget the journal of executions (``event_id, reactor_id``) without completing them; what they write later counts."""
        top = self.journal().join(executions, ["event_id", "reactor_id"], "left_semi").groupBy("event_id", "reactor_id").agg(F.max("seq").alias("seq"))
        self.commit(batch, cleared=top)

    def load_journal(self, event_id: str, reactor_id: str) -> DataFrame:
        """One execution's entries in their order."""
        return self.journal().filter((F.col("event_id") == event_id) & (F.col("reactor_id") == reactor_id)).orderBy("seq")

    def earliest_pending(self, by: str | None = None):
        """When the next pending work can run: one time (null for none), or a row per value of ``by``."""
        if by is not None:
            return self.pending().groupBy(by).agg(F.min("execute_at").alias("earliest_at"))
        return self.pending().agg(F.min("execute_at")).first()[0]

    def reclaim(self, now) -> DataFrame:
        """Pending work whose timeout has passed since it could run."""
        limit = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("timeout_seconds"))
        return self.pending().filter(F.col("execute_at") + limit < F.lit(now).cast("timestamp_ntz"))


def intents(commits: DataFrame) -> DataFrame:
    """One row per intent; null and empty lists give none."""
    return commits.select("event_id", "correlation_id", F.explode("intents").alias("i")).filter("i is not null").select(
        "event_id", "i.reactor_id", "correlation_id", "i.execute_at", F.greatest(F.coalesce("i.timeout_seconds", F.lit(900)), F.lit(1)).alias("timeout_seconds"),
        F.coalesce("i.max_attempts", F.lit(1)).alias("max_attempts"), F.coalesce("i.priority", F.lit(10)).alias("priority"), F.coalesce("i.hops", F.lit(0)).alias("hops"),
    )


def descriptions(commits: DataFrame) -> DataFrame:
    """One row per described reactor of a commit (JSON object of reactor to blocks); broken JSON gives none."""
    m = F.from_json("reactor_descriptions", "map<string,string>")
    return commits.select("correlation_id", "event_id", F.col("checkpoint").alias("at"), F.explode(m).alias("reactor_id", "description"))


def states(commits: DataFrame) -> DataFrame:
    """One row per aggregate state of a commit (JSON object of aggregate key to state); broken JSON gives none."""
    m = F.from_json("aggregate_snapshots", "map<string,string>")
    return commits.select("event_id", F.col("checkpoint").alias("at"), F.explode(m).alias("aggregate_key", "state"))
