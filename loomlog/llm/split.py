"""Splitting oversized texts at natural boundaries.

Method: a recursive hierarchy of separators. A text is cut into sections, those into paragraphs, lines (table rows, list
entries), sentences, words and at last characters; a unit is only taken apart where it does not fit into a piece of its own.
Consecutive units are packed greedily up to the limit, and each piece starts with about the last ``overlap`` tokens of the one
before, at the nearest boundary. A piece ends inside a sentence only if that sentence is all it holds besides the overlap; a
sentence or line that fits the limit but not with the whole overlap is kept whole, with less overlap before it.

Null and empty texts, and texts within the limit, are one piece, or none with ``oversized_only``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm import tokens

LIMIT, OVERLAP = 2048, 128

#: The separators from the coarsest to the finest; a boundary is where a match ends (or, for headings, rows and entries, starts).
LEVELS = (
    ("section", re.compile(r"\n(?===+[^=\n])")),
    ("paragraph", re.compile(r"\n[ \t]*\n+")),
    ("line", re.compile(r"\n(?!\n)")),
    ("sentence", re.compile(r"(?<=[.!?…])[\"'»”)\]]*\s+|[。！？।؟۔]+[”』」]*")),
    ("word", re.compile(r"\s+")),
)
CHARACTER = "character"
#: Levels below this one are no natural boundaries.
WORD_LEVEL = 4


class Splitter:
    def __init__(self, text: str, ids: list[int], encode, width: np.ndarray, limit: int, overlap: int):
        self.text, self.encode, self.limit, self.overlap = text, encode, limit, overlap
        # tokens that end at or before each character boundary
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        char_end = np.append(np.flatnonzero((raw & 0xC0) != 0x80)[1:], len(raw))
        token_end = np.cumsum(width[np.array(ids, np.int64)])
        self.before = np.concatenate([[0], np.searchsorted(token_end, char_end, "right")])
        self.found: dict[int, np.ndarray] = {}
        self.natural = np.unique(np.concatenate([self.boundaries(i) for i in range(WORD_LEVEL)]))

    def n(self, a: int, e: int) -> int:
        """Tokens between two characters in the encoding of the whole text; near what the part has alone."""
        return int(self.before[e] - self.before[a])

    def boundaries(self, level: int) -> np.ndarray:
        if level not in self.found:
            self.found[level] = np.array([m.end() for m in LEVELS[level][1].finditer(self.text)], np.int64)
        return self.found[level]

    def whole(self, a: int, e: int) -> bool:
        """Has text[a:e] no natural boundary inside?"""
        at = int(np.searchsorted(self.natural, a, "right"))
        return at == len(self.natural) or self.natural[at] >= e

    def parts(self, a: int, e: int, level: int, name: str, most: int) -> list[tuple[int, int, int, str]]:
        """(start, end, level, boundary at the end) of a unit's parts at the next level that parts it; characters at last."""
        while level < len(LEVELS):
            b = self.boundaries(level)
            inner = b[np.searchsorted(b, a, "right") : np.searchsorted(b, e, "left")]
            level += 1
            if len(inner):
                points = [a, *inner.tolist(), e]
                own = LEVELS[level - 1][0]
                return [(x, y, level, name if y == e else own) for x, y in zip(points, points[1:])]
        to = int(np.searchsorted(self.before, self.before[a] + max(1, most), "right")) - 1
        to = min(max(to, a + 1), e)
        return [(a, to, level, CHARACTER), (to, e, level, name)] if to < e else [(a, e, level, name)]

    def nearest(self, marks: np.ndarray, start: int, end: int, goal: int) -> int | None:
        """Of the marks inside (start, end) the one at which the count of tokens is nearest to ``goal``."""
        ideal = int(np.searchsorted(self.before, goal, "left"))
        at = int(np.searchsorted(marks, ideal, "left"))
        near = [int(m) for m in marks[max(0, at - 1) : at + 1] if start < m < end]
        return min(near, key=lambda m: abs(int(self.before[m]) - goal)) if near else None

    def back(self, start: int, end: int, room: int) -> int:
        """Where the piece after one that ends at ``end`` starts: at the boundary nearest to ``overlap`` tokens before it, with
        at most ``room`` tokens of overlap."""
        goal = int(self.before[end]) - min(self.overlap, room)
        goal = max(goal, int(self.before[start]) + 1)  # a piece shorter than the overlap: nearly all of it
        if room <= 0 or goal >= self.before[end]:
            return end
        least = int(np.searchsorted(self.before, int(self.before[end]) - room, "left")) - 1
        for marks, slack in ((self.natural, self.overlap // 4), (self.boundaries(WORD_LEVEL), self.overlap // 2)):
            best = self.nearest(marks, max(start, least), end, goal)
            if best is not None and abs(int(self.before[best]) - goal) <= slack:
                return best
        return min(max(int(np.searchsorted(self.before, goal, "left")), start + 1), end)

    def pieces(self):
        """(start, end, tokens, level of the boundary at its end)."""
        total, start, done = len(self.text), 0, 0
        stack = [(0, total, 0, "end")]
        while done < total:
            taken: list[tuple[int, int, int, str]] = []
            fit, previous = done, start
            if done:  # leave room for the next unit, or for its parts
                size = self.n(*stack[-1][:2])
                fits = size <= self.limit - self.overlap or size <= self.limit and stack[-1][2] <= WORD_LEVEL and self.whole(*stack[-1][:2])
                room = self.limit - size if fits else self.overlap
                start = self.back(previous, done, room)
            while stack:
                unit = stack[-1]
                if self.n(start, unit[1]) <= self.limit:
                    taken.append(stack.pop())
                    fit = unit[1]
                    continue
                size = self.n(*unit[:2])
                alone = size <= self.limit - self.overlap
                if taken and (alone or self.whole(*unit[:2])):
                    break  # it fits into the next piece, or could only be cut inside a sentence
                if not taken and alone and start < done:
                    start = self.back(start, done, self.limit - size)
                    continue
                stack.pop()
                stack.extend(reversed(self.parts(*unit, self.limit - self.n(start, unit[0]))))
            size = len(self.encode(self.text[start:fit]))
            while size > self.limit:  # alone it has more tokens than in its place
                if len(taken) > 1:
                    stack.append(taken.pop())
                    fit = taken[-1][1]
                elif start < done:
                    start = min(done, max(start + 1, int(np.searchsorted(self.before, self.before[start] + size - self.limit, "left"))))
                elif fit - start > 1:
                    unit = taken.pop()
                    first, *rest = self.parts(*unit, max(1, self.n(*unit[:2]) - (size - self.limit)))
                    if not rest:
                        first, rest = (unit[0], unit[1] - 1, unit[2], CHARACTER), [(unit[1] - 1, *unit[1:])]
                    stack.extend(reversed(rest))
                    taken, fit = [first], first[1]
                else:
                    break
                size = len(self.encode(self.text[start:fit]))
            yield start, fit, size, taken[-1][3]
            done = fit


_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("piece_no", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("n_tokens", pa.int32()),
     ("boundary", pa.string()), ("text", pa.string())]
)
PIECES = "doc_id bigint, piece_no int, start bigint, end bigint, n_tokens int, boundary string, text string"


def split_text(text: str | None, path: str | None = None, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple]:
    """(start, end, tokens, boundary) of the pieces of one text."""
    text = text or ""
    e = tokens.encoding(path)
    ids = e.encode_ordinary(text)
    if len(ids) <= limit:
        return [(0, len(text), len(ids), "end")]
    return list(Splitter(text, ids, e.encode_ordinary, tokens.token_bytes(path), limit, overlap).pieces())


def _cutter(path, limit, overlap, oversized_only, with_text):
    def run(batches):
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                made = split_text(text, path, limit, overlap)
                if oversized_only and len(made) == 1:
                    continue
                text = text or ""
                rows.extend((doc, i, a, e, n, at, text[a:e] if with_text else None) for i, (a, e, n, at) in enumerate(made))
                if len(rows) > 500:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)

    return run


def split_documents(documents: DataFrame, path: str | None = None, limit: int = LIMIT, overlap: int = OVERLAP, oversized_only: bool = False, with_text: bool = True) -> DataFrame:
    """One row per piece of each document (``doc_id``, ``text``): piece number, start and end in code points, tokens, the
    kind of boundary at its end, and its text. No shuffle. With ``oversized_only`` texts within the limit give no rows;
    a text has at most one token per byte, so short ones never leave the JVM."""
    tokens.ship(documents.sparkSession, path)
    docs = documents.select("doc_id", "text")
    if oversized_only:
        docs = docs.filter(F.octet_length("text") > limit)
    return docs.mapInArrow(_cutter(path, limit, overlap, oversized_only, with_text), PIECES)
