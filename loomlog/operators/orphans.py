"""References to records that do not exist.

Method: the keys are dictionary-encoded as dense integers inside each key range (a range of the keys' hash), every range
builds compressed bitmaps of the keys present, deleted, and referred to per table and period, computes
reference AND NOT present, and decodes the surviving bits to keys. References are reduced to one row per table, period and
key before the shuffle, so a key that a third of all rows refer to is one row here; the surviving keys are joined back to
the references last. Keys with so many references that they would fill a partition are few (at most all references over
``HEAVY``); they are joined on their own, broadcast, and taken out of the shuffle of the rest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.session import partitions, small, written

_SPARSE = 4096
#: Rows of keys (events, tombstones, distinct references) that one key range holds in memory, on average.
RANGE_ROWS = 1_000_000
#: A key with more references than this in one table and month is joined apart.
HEAVY = 1_000_000


class Bitmap:
    """A compressed bitmap: per 65,536 codes a sorted array of at most 4,096 offsets, or 8 KB of bits."""

    def __init__(self, codes: np.ndarray):
        codes = np.unique(codes)
        self.parts = {}
        high = codes >> 16
        for h in np.unique(high):
            low = (codes[high == h] & 0xFFFF).astype(np.uint16)
            self.parts[int(h)] = low if len(low) <= _SPARSE else self._pack(low)

    @staticmethod
    def _pack(low: np.ndarray) -> np.ndarray:
        bits = np.zeros(1 << 16, np.uint8)
        bits[low] = 1
        return np.packbits(bits)

    @staticmethod
    def _bits(part) -> np.ndarray:
        return part if part.dtype == np.uint8 else Bitmap._pack(part)

    @classmethod
    def _of(cls, parts: dict) -> Bitmap:
        out = cls(np.empty(0, np.int64))
        out.parts = parts
        return out

    def and_not(self, other: Bitmap) -> Bitmap:
        out = {}
        for h, a in self.parts.items():
            b = other.parts.get(h)
            if b is None:
                out[h] = a
            elif a.dtype != np.uint8:
                out[h] = a[~np.unpackbits(b).astype(bool)[a]] if b.dtype == np.uint8 else np.setdiff1d(a, b, assume_unique=True)
            else:
                out[h] = a & ~self._bits(b)
        return self._of(out)

    def __and__(self, other: Bitmap) -> Bitmap:
        return self.and_not(self.and_not(other))

    def codes(self) -> np.ndarray:
        found = [
            (h << 16) + (np.flatnonzero(np.unpackbits(p)) if p.dtype == np.uint8 else p.astype(np.int64))
            for h, p in sorted(self.parts.items())
        ]
        return np.concatenate(found).astype(np.int64) if found else np.empty(0, np.int64)


EVENT, TOMBSTONE, REFERENCE = 0, 1, 2
STATES = ("missing", "deleted", "late")
_OUT = pa.schema([("key", pa.binary()), ("slot", pa.int32()), ("state", pa.string()), ("there_us", pa.int64()), ("n", pa.int64())])


def _ranger(heavy: int):
    """Heavy references in no question come out too, with the state null."""
    return lambda batches: _range(batches, heavy)


def _range(batches, heavy: int):
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    t = pa.Table.from_batches(batches)
    encoded = t["key"].combine_chunks().dictionary_encode()
    code = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    role = t["role"].to_numpy()
    slot = t["slot"].to_numpy()
    us = pc.fill_null(t["us"], np.iinfo(np.int64).max).to_numpy()
    there = np.zeros(len(encoded.dictionary), np.int64)
    events = role == EVENT
    there[code[events]] = us[events]
    present, deleted = Bitmap(code[events]), Bitmap(code[role == TOMBSTONE])
    refs, n = role == REFERENCE, t["n"].to_numpy()
    for s in np.unique(slot[refs]):
        here = refs & (slot == s)
        referred = Bitmap(code[here])
        gone = referred.and_not(present)
        at, when = code[here], us[here]
        count = np.zeros(len(encoded.dictionary), np.int64)
        count[at] = n[here]
        known = Bitmap(at[when < there[at]]) & present  # the earliest reference of the slot comes before its event
        much = Bitmap(at[count[at] > heavy]).and_not(gone).and_not(known)
        for state, found in (("missing", gone.and_not(deleted)), ("deleted", gone & deleted), ("late", known), (None, much)):
            codes = found.codes()
            for i in range(0, len(codes), 10_000):
                c = codes[i : i + 10_000]
                yield pa.RecordBatch.from_arrays(
                    [encoded.dictionary.take(pa.array(c)).cast(pa.binary()), pa.array(np.full(len(c), s, np.int32)),
                     pa.array([state] * len(c), pa.string()), pa.array(there[c]), pa.array(count[c])],
                    schema=_OUT,
                )


def find(references: DataFrame, events: DataFrame, tombstones: DataFrame, parts: int | None = None, heavy: int = HEAVY) -> DataFrame:
    """One row per distinct reference in question: ``ref_table``, ``month``, ``holder``, ``key``, ``state``.

    ``references``: ``ref_table`` int, ``holder`` bigint, ``key`` binary (not null), ``us`` bigint time or null, ``month``
    int (year * 12 + month - 1, -1 where the time is null). ``events``: ``key``, ``us`` (one row per key). ``tombstones``:
    ``key``. A reference without a time is never late. Repeated references count once. The tables should be cheap to count;
    ``parts`` is the number of key ranges, by default enough for ``RANGE_ROWS`` rows in each.
    """
    slot = (F.col("ref_table") * 1_000_000 + F.col("month") + 1).cast("int")
    refs = references.select("ref_table", "holder", "key", "us", "month", slot.alias("slot"))
    wanted = refs.groupBy("key", "slot").agg(F.min("us").alias("us"), F.count("*").alias("n")).select("key", F.lit(REFERENCE).alias("role"), "slot", "us", "n")
    zero = F.lit(0)
    rows = (
        events.select("key", F.lit(EVENT).alias("role"), zero.alias("slot"), "us", zero.cast("bigint").alias("n"))
        .unionByName(tombstones.select("key").distinct().select("key", F.lit(TOMBSTONE).alias("role"), zero.alias("slot"), F.lit(None).cast("bigint").alias("us"), zero.cast("bigint").alias("n")))
        .unionByName(wanted)
    )
    if parts is None:
        parts = max(partitions(rows.sparkSession), -(-(events.count() + references.count()) // RANGE_ROWS))
    ranges = rows.repartition(parts, "key").mapInArrow(_ranger(heavy), "key binary, slot int, state string, there_us bigint, n bigint")
    flagged = written(ranges, "flagged")
    few = flagged.filter(F.col("n") > heavy)
    if few.limit(1).count():
        few = small(few)
        rest = refs.join(few.select("key", "slot"), ["key", "slot"], "left_anti")
        found = refs.join(few.filter("state is not null"), ["key", "slot"]).unionByName(rest.join(small(flagged.filter(F.col("n") <= heavy)), ["key", "slot"]))
    else:
        found = refs.join(small(flagged), ["key", "slot"])
    return found.filter("state <> 'late' or us < there_us").select("ref_table", "month", "holder", "key", "state").distinct()
