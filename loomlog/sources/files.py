"""Tables in files of other formats: CSV, JSON lines and Parquet, always under a given schema, so nothing is guessed from data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

KINDS = ("csv", "json", "parquet")
_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
#: Options that make what is written come back the same: quotes doubled, line breaks kept, nulls apart from empty texts.
_OPTIONS = {
    "csv": {"header": "true", "multiLine": "true", "escape": '"', "nullValue": "\\N", "emptyValue": "", "timestampNTZFormat": _TIME},
    "json": {"ignoreNullFields": "false", "timestampNTZFormat": _TIME},
    "parquet": {},
}


def _kind(kind: str) -> str:
    if kind not in KINDS:
        raise ValueError(f"no such format: {kind}")
    return kind


def write(df: DataFrame, path: str, kind: str) -> None:
    df.write.format(_kind(kind)).options(**_OPTIONS[kind]).save(path)


def read(spark: SparkSession, path: str, kind: str, schema: StructType | str) -> DataFrame:
    """Columns that the files lack are null; a value that does not fit its type is null."""
    return spark.read.format(_kind(kind)).schema(schema).options(**_OPTIONS[kind]).load(path)


def stream(spark: SparkSession, path: str, kind: str, schema: StructType | str, files_per_batch: int | None = None) -> DataFrame:
    r = spark.readStream.format(_kind(kind)).schema(schema).options(**_OPTIONS[kind])
    return (r.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else r).load(path)
