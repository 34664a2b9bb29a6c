"""Per-key results when a few keys hold most records.

Method: range-partition on the composite (key, order) with sampled quantiles, so a heavy key spreads over as many
partitions as its share asks for; each partition folds its runs of equal keys to one partial state; the partial states,
at most one per key and partition, are stitched in order at the boundaries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomlog.session import partitions

_PARTIAL = pa.schema(
    [("field", pa.string()), ("key", pa.binary()), ("n", pa.int64()), ("first_seq", pa.int64()), ("last_seq", pa.int64()),
     ("first_ts", pa.int64()), ("last_ts", pa.int64()), ("max_step", pa.int64())]
)
_NO_SEQ = -(1 << 63)
_PARTIAL_DDL = "field string, key binary, n bigint, first_seq bigint, last_seq bigint, first_ts bigint, last_ts bigint, max_step bigint"


def _batch_runs(b: pa.RecordBatch) -> list[list]:
    """The columns of one partial state per run of equal (field, key) in a sorted batch."""
    field, key = b.column("field"), b.column("key")
    seq, ts = b.column("seq").to_numpy(zero_copy_only=False), b.column("ts")
    timed = ts.is_valid().to_numpy(zero_copy_only=False)
    ts = pc.fill_null(ts, 0).to_numpy(zero_copy_only=False)
    change = np.ones(b.num_rows, bool)
    if b.num_rows > 1:
        differs = pc.or_(pc.not_equal(key[1:], key[:-1]), pc.not_equal(field[1:], field[:-1]))
        change[1:] = differs.to_numpy(zero_copy_only=False)
    start = np.flatnonzero(change)
    end = np.append(start[1:], b.num_rows) - 1
    step = np.zeros(b.num_rows, np.int64)
    step[1:] = np.where(change[1:] | ~timed[1:] | ~timed[:-1], 0, ts[1:] - ts[:-1])
    at = lambda i: pa.array(ts[i], mask=~timed[i]).to_pylist()
    return [
        field.take(pa.array(start)).to_pylist(), key.take(pa.array(start)).to_pylist(), (end - start + 1).tolist(), seq[start].tolist(), seq[end].tolist(),
        at(start), at(end), np.maximum.reduceat(step, start).tolist(),
    ]


def _follow(a: list, b: list) -> list:
    """The state of a run and of the one that goes on from it."""
    seam = b[5] - a[6] if b[5] is not None and a[6] is not None else 0
    return [*a[:2], a[2] + b[2], a[3], b[4], a[5], b[6], max(a[7], b[7], seam)]


def _runs(batches):
    """One partial state per (field, key) of a sorted partition, whatever Arrow batches it comes in; ``max_step`` is the longest
    time between neighbours that both have one."""
    held: list | None = None
    for b in batches:
        if not b.num_rows:
            continue
        rows = [list(r) for r in zip(*_batch_runs(b))]
        if held is not None:
            if held[:2] == rows[0][:2]:
                rows[0] = _follow(held, rows[0])
            else:
                rows.insert(0, held)
        held = rows.pop()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PARTIAL)], schema=_PARTIAL)
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(held, _PARTIAL)], schema=_PARTIAL)


def profile(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """One row per (field, key): ``n``, first and last ``seq`` and ``ts``, and ``max_step``, the longest time between
    events that follow each other by ``seq`` (0 where no two neighbours have a time).

    ``rows``: ``field`` string, ``key`` binary (not null), ``seq`` bigint, ``ts`` bigint or null. Ties in ``seq`` count as
    neighbours in any order. A row without ``seq`` counts and stands before all others (its ``first_seq`` is null). Empty
    input, empty result. A key has at most as many partial states as there are partitions, one each; they are stitched row
    by row, never as one list.
    """
    seq = F.coalesce("seq", F.lit(_NO_SEQ)).alias("seq")
    placed = rows.select("field", "key", seq, F.col("ts").cast("bigint").alias("ts")).repartitionByRange(parts or partitions(rows.sparkSession), "field", "key", "seq")
    partial = placed.sortWithinPartitions("field", "key", "seq").mapInArrow(_runs, _PARTIAL_DDL)
    order = Window.partitionBy("field", "key").orderBy("first_seq", "last_seq")
    seam = F.col("first_ts") - F.lag("last_ts").over(order)
    stitched = partial.withColumn("seam", seam)
    first, last = F.struct("first_seq", "last_seq"), F.struct("last_seq", "first_seq")
    known = lambda c: F.nullif(c, F.lit(_NO_SEQ))
    return stitched.groupBy("field", "key").agg(
        F.sum("n").alias("n"), known(F.min("first_seq")).alias("first_seq"), known(F.max("last_seq")).alias("last_seq"),
        F.min(F.struct(first.alias("o"), F.col("first_ts").alias("t")))["t"].alias("first_ts"), F.max(F.struct(last.alias("o"), F.col("last_ts").alias("t")))["t"].alias("last_ts"),
        F.greatest(F.max("max_step"), F.max("seam"), F.lit(0)).alias("max_step"),
    )
