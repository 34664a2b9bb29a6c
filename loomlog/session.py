"""Session helpers: the shared folder, written intermediate tables, size-checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when it was counted and has no more rows than this.
BROADCAST_ROWS = 200_000

_roots: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where that setting is absent, a single machine (master ``local`` or ``local[n]``) gets a temporary folder; anywhere else it
    is an error, since other machines would not see what is written there.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _roots:
        _roots[app] = tempfile.mkdtemp(prefix="loomlog-")
    return _roots[app]


def _delete_later(spark: SparkSession, path: str) -> None:
    def drop() -> None:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM has gone already
            pass

    atexit.register(drop)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/loomlog/{name}-{uuid.uuid4().hex}"
    _delete_later(spark, path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder (so a lost executor costs nothing) and read back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.loomlog_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a written table before the driver ends; nothing may read it any more."""
    p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.loomlog_path)
    p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint when a count shows at most ``rows`` rows, else as it is.

    ``df`` should be cheap to count (a written table or a small aggregate).
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Rows of one key that a join gives to a single task.
HEAVY_ROWS = 1_000_000


def lookup(rows: DataFrame, of: DataFrame, key: str, how: str = "left", heavy: int = HEAVY_ROWS) -> DataFrame:
    """``rows`` joined with ``of``, which is unique by ``key``. Keys with more than ``heavy`` rows are few (at most all rows over
    ``heavy``); they are looked up on their own and broadcast, so their rows stay where they are. ``rows`` should be cheap to
    count by key (a written table)."""
    few = written(rows.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > heavy).select(key).filter(F.col(key).isNotNull()), "heavy")
    n = few.count()
    if n == 0 or n > BROADCAST_ROWS:
        return rows.join(of, key, how)
    few = F.broadcast(few)
    known = written(of.join(few, key, "left_semi"), "known")
    return rows.join(few, key, "left_semi").join(F.broadcast(known), key, how).unionByName(rows.join(few, key, "left_anti").join(of, key, how))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
