"""Encoding of a whole corpus with a public tokenizer.

Method: content-defined chunk reuse. A rolling hash over 16 characters cuts every text where its content says so; chunks
that documents share are encoded once for the corpus; the encodings are put together again per document and every join is
repaired by re-encoding around it until both sides agree. A join at a token boundary that no context can move (see
``tokens.safe_cuts``) agrees as it is, and the cuts are moved to such places where one is near.

Null and empty texts give an empty list. Any text is ordinary text.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm import tokens
from loomlog.session import written

#: Characters the rolling hash sees; a cut comes on average every ``2 ** MASK_BITS`` characters.
WINDOW, MASK_BITS = 16, 8
#: A cut moves at most this many characters to a safe place; else it stays and its join is repaired.
SNAP = 256
#: Characters of text that one block of documents holds (a single longer text is a block of its own).
BLOCK_CHARS = 4_000_000
_STEP = 1 << 20
_B = 0x9E3779B97F4A7C15


@functools.lru_cache(maxsize=4)
def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** k and its inverse modulo 2 ** 64."""
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        a = np.full(n, b, np.uint64)
        a[0] = 1
        out.append(np.cumprod(a, dtype=np.uint64))
    return out[0], out[1]


def rolling(cps: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """At i: a hash of the ``window`` characters before i + 1 (only valid from ``window - 1`` on)."""
    n = len(cps)
    up, down = powers(_B, max(_STEP, 1 << (n - 1).bit_length()) if n > _STEP else _STEP)
    prefix = np.cumsum((cps.astype(np.uint64) + np.uint64(1)) * down[:n], dtype=np.uint64)
    sums = prefix.copy()
    sums[window:] -= prefix[:-window]
    h = sums * up[:n]
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def cuts(text: str) -> tuple[list[int], list[tuple[int, int, int, int]]]:
    """Chunk starts (the first is 0) and the repairs: (first chunk, last chunk, start, end) of each stretch without a safe
    place in which cuts fell; the stretch runs from a safe place in the first chunk to one in the last."""
    n = len(text)
    if n <= WINDOW:
        return [0], []
    cps = tokens.code_points(text)
    h = rolling(cps)
    hits = np.flatnonzero(h[WINDOW - 1 :] >> np.uint64(64 - MASK_BITS) == 0) + WINDOW
    hits = hits[hits < n]
    if not len(hits):
        return [0], []
    safe = np.flatnonzero(tokens.safe_cuts(tokens.class_of(cps)))
    ends = np.append(safe, n)
    to = ends[np.searchsorted(ends, hits)]
    near = to - hits <= SNAP
    at = np.unique(np.where(near, to, hits))
    at = at[at < n]
    starts = np.concatenate([[0], at])
    repairs = []
    if not near.all():
        bounds = np.concatenate([[0], ends])
        raw = at[~np.isin(at, safe)]
        lo = bounds[np.searchsorted(bounds, raw, "right") - 1]
        hi = ends[np.searchsorted(ends, raw)]
        for a, b in sorted(set(zip(lo.tolist(), hi.tolist()))):
            first = int(np.searchsorted(starts, a, "right")) - 1
            last = int(np.searchsorted(starts, b, "left")) - 1
            repairs.append((first, last, a, b))
    return starts.tolist(), repairs


_DOC = pa.schema(
    [("block", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("refs", pa.binary()),
     ("news", pa.list_(pa.struct([("h", pa.binary()), ("text", pa.string())]))),
     ("repairs", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("left", pa.int64()), ("right", pa.int64()), ("text", pa.string())])))]
)
_DOC_DDL = (
    "block bigint, row bigint, doc_id bigint, refs binary, news array<struct<h:binary,text:string>>, "
    "repairs array<struct<first:int,last:int,left:bigint,right:bigint,text:string>>"
)


def _chunk(batches):
    task = TaskContext.get().partitionId() << 32
    block, held, row = 0, 0, 0
    in_task: set[bytes] = set()
    in_block: set[bytes] = set()
    for b in batches:
        out = []
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            text = text or ""
            if held and held + len(text) > BLOCK_CHARS:
                block, held = block + 1, 0
                in_block.clear()
            held += len(text)
            row += 1
            refs, news, fixes = [], [], []
            if text:
                starts, repairs = cuts(text)
                for a, e in zip(starts, [*starts[1:], len(text)]):
                    part = text[a:e]
                    h = hashlib.blake2b(part.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                    refs.append(h)
                    if h not in in_block:
                        in_block.add(h)
                        if h in in_task:
                            news.append({"h": h, "text": None})
                        else:
                            in_task.add(h)
                            news.append({"h": h, "text": part})
                ends = [*starts[1:], len(text)]
                for first, last, a, e in repairs:
                    fixes.append(
                        {"first": first, "last": last, "left": len(text[a : ends[first]].encode()), "right": len(text[starts[last] : e].encode()), "text": text[a:e]}
                    )
            out.append((task + block, task + row, doc, b"".join(refs), news, fixes))
            if len(out) == 1000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)
        if len(in_task) > 2_000_000:  # forget, at the price of sending a chunk's text once more
            in_task.clear()


def _batch(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _DOC)], schema=_DOC)


def _encoder(path: str | None):
    schema = pa.schema([("of", pa.int64()), ("h", pa.binary()), ("ids", pa.binary())])

    def run(batches):
        """Rows sorted by chunk, those with the chunk's text first: encode it once, answer all blocks that need it."""
        e, kind = tokens.encoding(path), tokens.id_type(path)
        last, ids = None, b""
        for b in batches:
            out = []
            for h, text in zip(b.column("h").to_pylist(), b.column("text").to_pylist()):
                if h != last:
                    last, ids = h, np.array(e.encode_ordinary(text), kind).tobytes()
                out.append(ids)
            yield pa.RecordBatch.from_arrays([b.column("block"), b.column("h"), pa.array(out, pa.binary())], schema=schema)

    return run


def _trim(ids: np.ndarray, n_bytes: int, width: np.ndarray, from_end: bool) -> np.ndarray | None:
    """``ids`` without the tokens that cover the last (or first) ``n_bytes`` bytes; None where no token ends there."""
    lengths = np.cumsum(width[ids[::-1] if from_end else ids])
    k = int(np.searchsorted(lengths, n_bytes)) + 1 if n_bytes else 0
    if n_bytes and (k > len(lengths) or lengths[k - 1] != n_bytes):
        return None
    return ids[: len(ids) - k] if from_end else ids[k:]


def join_chunks(parts: list[np.ndarray], repairs, path: str | None) -> list[np.ndarray]:
    """The chunks' encodings with their joins repaired. Where the encodings do not agree around a repair, it is widened to
    the whole text, which the chunks' tokens spell."""
    if not repairs:
        return parts
    e, width, kind = tokens.encoding(path), tokens.token_bytes(path), tokens.id_type(path)
    encode = lambda text: np.array(e.encode_ordinary(text), kind)
    whole, parts = parts, list(parts)
    for r in repairs:
        first, last = r["first"], r["last"]
        left, right = _trim(parts[first], r["left"], width, True), None
        if left is not None:
            parts[first] = np.concatenate([left, encode(r["text"])])
            for i in range(first + 1, last):
                parts[i] = parts[i][:0]
            right = _trim(parts[last], r["right"], width, False)
        if right is None:
            return [encode(b"".join(e.decode_bytes(p.tolist()) for p in whole).decode("utf-8", "surrogatepass"))]
        parts[last] = right
    return parts


def _assembler(path: str | None):
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(docs: pa.Table, encoded: pa.Table) -> pa.Table:
        kind = tokens.id_type(path)
        known = {h: np.frombuffer(i, kind) for h, i in zip(encoded["h"].to_pylist(), encoded["ids"].to_pylist())}
        pieces, lengths = [], []
        for refs, repairs in zip(docs["refs"].to_pylist(), docs["repairs"].to_pylist()):
            parts = join_chunks([known[refs[i : i + 16]] for i in range(0, len(refs), 16)], repairs, path)
            pieces.extend(parts)
            lengths.append(sum(map(len, parts)))
        flat = np.concatenate(pieces).astype(np.int32) if pieces else np.empty(0, np.int32)
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
        return pa.table([docs["doc_id"].combine_chunks().cast(pa.int64()), ids], schema=schema)

    return run


def encode_corpus(documents: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id`` and ``ids`` of every row of ``documents`` (``doc_id`` bigint, ``text`` string).

    ``path``: the tokenizer's rank file. Repeated and null ids keep their rows; an empty table gives an empty result.
    """
    tokens.ship(documents.sparkSession, path)
    docs = written(documents.select("doc_id", "text").mapInArrow(_chunk, _DOC_DDL), "chunks")
    news = docs.select("block", F.explode("news").alias("c")).select("block", "c.h", "c.text")
    placed = news.repartition("h").sortWithinPartitions("h", F.col("text").isNull())
    needed = placed.select("block", "h", "text").mapInArrow(_encoder(path), "of bigint, h binary, ids binary")
    return (
        docs.select("block", "doc_id", "refs", "repairs").groupBy("block").cogroup(needed.groupBy("of"))
        .applyInArrow(_assembler(path), "doc_id bigint, ids array<int>")
    )
