"""Evaluation texts leaking into training text.

Method: template canonicalisation. In the words of items and documents numbers, names and units become typed
placeholders; windows of template words are hash-joined; on the survivors the values that stand in the placeholders are
checked slot by slot. Equal values are an exact leak, another consistent mapping a re-parameterised one.

A word is typed by its own form in the text it stands in, so items and documents are read by one rule and no word has to be
known beforehand: a word with a digit is a number, a unit is a unit word right after a number, a word with a capital first
letter is a name, and neighbouring names, or numbers, are one. There are two families of templates. ``PLAIN`` only types
numbers and folds case, so every run of ``WORDS`` equal words has equal windows, however the document writes it, and none is
lost. ``NAMED`` types all three; a window needs more plain words than placeholders to say anything.

A document's windows that follow an item in order are one instance, across edits between them, and need one mapping: an
instance in which a value stands for two others, or two values for one, is no leak, while a document may hold an item
several times with different values.

Documents are read once. Of the items only the window hashes go to the executors, and only up to a counted number; more of
them are joined by shuffle like any other table. Null and empty texts have no words and match nothing.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm import encode, wikitext
from loomlog.session import small, written

WORDS = 13
#: Words of a window of each searched field; questions are short.
FIELDS = {"passage": WORDS, "question": 7}
#: Distinct window hashes of items that are sent to the executors (16 MB); with more, all windows are joined by shuffle.
BLOCK_WINDOWS = 2_000_000
#: Units, as they stand right after a number.
UNITS = frozenset(
    "m km cm mm mi ft in yd kg g mg t lb lbs oz s sec min h hr l ml ha ms hz khz mhz ghz w kw mw v a k c f b kb mb gb tb percent "
    "metre metres meter meters kilometre kilometres kilometer kilometers mile miles foot feet inch inches yard yards gram grams kilogram "
    "kilograms tonne tonnes ton tons pound pounds ounce ounces second seconds minute minutes hour hours day days week weeks month months "
    "year years litre litres liter liters hectare hectares acre acres volt volts watt watts degree degrees eur usd gbp euro euros dollar "
    "dollars cent cents".split()
)
_NUMBER, _NAME, _UNIT = (np.uint64(x) for x in (0x1111111111111111, 0x2222222222222222, 0x3333333333333333))
_C = 0xD6E8FEB86659FD93
_MIX = np.uint64(0x94D049BB133111EB)
_BATCH_CHARS = 1_000_000
PLAIN, NAMED = 0, 1
#: What a token of a template is, written before its text.
_MARKS = "=#@~"


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def _size(n: int) -> int:
    return max(1 << 20, 1 << max(n, 1).bit_length())


def word_hashes(cps: np.ndarray, kind: np.ndarray):
    """(start, end, hash, has a digit) of the words of folded code points."""
    word = (kind > 0).view(np.int8)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], word, [0]])))
    start, end = edge[::2], edge[1::2]
    up, down = encode.powers(encode._B, _size(len(cps)))
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(cps.astype(np.uint64) * up[: len(cps)], dtype=np.uint64)])
    digits = np.concatenate([[0], np.cumsum(kind == wikitext.DIGIT)])
    h = _mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))
    return start, end, h, digits[end] > digits[start]


def windows(h: np.ndarray, words: int = WORDS) -> np.ndarray:
    """The hash of each run of ``words`` template words."""
    if len(h) < words:
        return np.empty(0, np.uint64)
    up, down = encode.powers(_C, _size(len(h)))
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)], dtype=np.uint64)])
    n = len(h) - words + 1
    return _mix((prefix[words:] - prefix[:n]) * down[:n])


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(h), bool)
    at = np.searchsorted(known, h)
    return known[np.minimum(at, len(known) - 1)] == h


def _unit_hashes() -> np.ndarray:
    cps, kind, _ = wikitext.folded_cased(" ".join(sorted(UNITS)))
    return np.unique(word_hashes(cps, kind)[2])


def least_plain(words: int) -> int:
    """Plain words that a window of ``NAMED`` needs."""
    return words // 2 + 1


class Words:
    """The words of several texts in one array; ``text`` is the number of the text each stands in."""

    units: np.ndarray | None = None

    def __init__(self, texts: list[str]):
        read = [wikitext.folded_cased(wikitext.expand(wikitext.readable(t)) + "\n") for t in texts]
        self.cps, kind, upper = (np.concatenate(c) for c in zip(*read))
        self.start, self.end, self.hash, number = word_hashes(self.cps, kind)
        self.text = np.searchsorted(np.cumsum([len(c) for c, _, _ in read]), self.start, "right")
        if Words.units is None:
            Words.units = _unit_hashes()
        n = len(self.hash)
        same = np.zeros(n, bool)
        same[1:] = self.text[1:] == self.text[:-1]
        after_number = np.zeros(n, bool)
        after_number[1:] = number[:-1]
        unit = after_number & same & ~number & _among(self.hash, Words.units)
        name = upper[self.start] & ~number & ~unit
        self.type = np.where(number, 1, np.where(name, 2, np.where(unit, 3, 0))).astype(np.int8)
        joined = np.zeros(n, bool)
        joined[1:] = same[1:] & (self.type[1:] == self.type[:-1]) & ((self.type[1:] == 1) | (self.type[1:] == 2))
        #: per family the first word of each token, its template hash, and its type
        self.first = (np.arange(n), np.flatnonzero(~joined))
        typed = np.choose(self.type, [self.hash, _NUMBER, _NAME, _UNIT])
        self.template = (np.where(number, _NUMBER, self.hash), typed[self.first[1]])
        self.types = (np.where(number, 1, 0).astype(np.int8), self.type[self.first[1]])
        self.of = (self.text, self.text[self.first[1]])

    def windows(self, family: int, words: int) -> tuple[np.ndarray, np.ndarray]:
        """(first token, hash) of the windows that stand in one text."""
        w = windows(self.template[family], words)
        at = np.flatnonzero(self.of[family][: len(w)] == self.of[family][words - 1 : words - 1 + len(w)])
        if family == NAMED and len(at):
            plain = np.concatenate([[0], np.cumsum(self.types[family] == 0)])
            at = at[plain[at + words] - plain[at] >= least_plain(words)]
        return at, _mix(w[at] + np.uint64(2 * words + family))  # families never meet

    def tokens(self, family: int, a: int, e: int) -> list[str]:
        """The tokens a to e, each its type's mark and its folded words."""
        first, out = self.first[family], []
        for t in range(a, e):
            stop = int(first[t + 1]) if t + 1 < len(first) else len(self.start)
            ws = (self.cps[self.start[y] : self.end[y]].astype("<u4").tobytes().decode("utf-32-le", "replace") for y in range(int(first[t]), stop))
            out.append(_MARKS[self.types[family][t]] + " ".join(ws))
        return out


def _families(fields) -> list[tuple[int, int]]:
    """(family, words) that the fields need."""
    return [(f, n) for n in sorted({FIELDS[x] for x in fields}, reverse=True) for f in (PLAIN, NAMED)]


_ITEM = pa.schema(
    [("item_id", pa.int64()), ("field", pa.string()), ("part", pa.int64()), ("family", pa.int32()), ("words", pa.int32()), ("tokens", pa.list_(pa.string())),
     ("hashes", pa.list_(pa.int64()))]
)
_ITEM_DDL = "item_id bigint, field string, part bigint, family int, words int, tokens array<string>, hashes array<bigint>"
_STRETCH = pa.schema(
    [("doc_id", pa.int64()), ("row", pa.int64()), ("family", pa.int32()), ("words", pa.int32()), ("at", pa.int64()), ("tokens", pa.list_(pa.string())),
     ("hashes", pa.list_(pa.int64()))]
)
_STRETCH_DDL = "doc_id bigint, row bigint, family int, words int, at bigint, tokens array<string>, hashes array<bigint>"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _item_windows(batches):
    for b in batches:
        out = []
        for item, field, part, text in zip(*(c.to_pylist() for c in b.columns)):
            read = Words([text])
            for family in (PLAIN, NAMED):
                n = FIELDS[field]
                h = np.unique(read.windows(family, n)[1])
                if len(h):
                    out.append((item, field, part, family, n, read.tokens(family, 0, len(read.first[family])), h.view(np.int64).tolist()))
        if out:
            yield _batch(out, _ITEM)


class _Finder:
    """The stretches of documents whose windows are among ``known`` (sorted hashes), or all windows where that is None."""

    def __init__(self, known: np.ndarray | None, families):
        self.known, self.families = known, families
        if known is not None:
            self.maybe = np.zeros(1 << 20, bool)
            self.maybe[(known >> np.uint64(44)).astype(np.int64)] = True

    def find(self, ids: list, rows: list, texts: list[str]):
        read = Words(texts)
        for family, words in self.families:
            at, h = read.windows(family, words)
            if self.known is not None:
                maybe = np.flatnonzero(self.maybe[(h >> np.uint64(44)).astype(np.int64)])
                maybe = maybe[_among(h[maybe], self.known)]
                at, h = at[maybe], h[maybe]
            if not len(at):
                continue
            text = read.of[family][at]
            cut = np.flatnonzero((np.diff(at) > 1) | (np.diff(text) > 0)) + 1
            for a, e in zip([0, *cut.tolist()], [*cut.tolist(), len(at)]):
                d, first = int(text[a]), int(at[a])
                yield ids[d], rows[d], family, words, first, read.tokens(family, first, int(at[e - 1]) + words), np.unique(h[a:e]).view(np.int64).tolist()


def _search(known, families):
    def run(batches):
        task, row = TaskContext.get().partitionId() << 33, 0
        finder = _Finder(None if known is None else known.value, families)
        ids, rows, texts, held = [], [], [], 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                row += 1
                if not text:
                    continue
                ids.append(doc)
                rows.append(task + row)
                texts.append(text)
                held += len(text)
                if held > _BATCH_CHARS:
                    yield from _made(finder, ids, rows, texts)
                    ids, rows, texts, held = [], [], [], 0
        if texts:
            yield from _made(finder, ids, rows, texts)

    return run


def _made(finder: _Finder, ids, rows, texts):
    out = []
    for r in finder.find(ids, rows, texts):
        out.append(r)
        if len(out) == 2000:
            yield _batch(out, _STRETCH)
            out = []
    if out:
        yield _batch(out, _STRETCH)


def slots(item: list[str], doc: list[str]) -> str | None:
    """'exact', 'reparameterised', or None where the values that differ map inconsistently."""
    if item == doc:
        return "exact"
    forth, back = {}, {}
    for a, b in zip(item, doc):
        if forth.setdefault(a, b) != b or back.setdefault(b, a) != a:
            return None
    return "reparameterised"


def _template(tokens: list[str]) -> list[str]:
    return [t if t[0] == "=" else t[0] for t in tokens]


class _Item:
    """The windows of an item's template, by their text."""

    def __init__(self, tokens: list[str], words: int):
        self.tokens, self.words = tokens, words
        self.places: dict[tuple, list[int]] = {}
        self.exact: set[tuple] = set()
        form = _template(tokens)
        for i in range(len(tokens) - words + 1):
            self.places.setdefault(tuple(form[i : i + words]), []).append(i)
            self.exact.add(tuple(tokens[i : i + words]))


class _Instances:
    """The instances of one item in one document under one family, window by window in the document's order."""

    def __init__(self):
        self.exact = self.changed = 0
        self._last = (-2, -2)
        self._open()

    def _open(self) -> None:
        self.forth: dict[str, str] = {}
        self.back: dict[str, str] = {}
        self.ok, self.n = True, 0

    def close(self) -> None:
        if self.ok:
            self.changed += self.n
        self._open()

    def stretch(self, item: _Item, at: int, tokens: list[str]) -> None:
        n, form = item.words, _template(tokens)
        for j in range(len(tokens) - n + 1):
            here = tokens[j : j + n]
            places = item.places.get(tuple(form[j : j + n]))
            if places is None:
                continue
            if tuple(here) in item.exact:
                self.exact += 1
            d, i = self._last
            after = bisect.bisect_right(places, i)
            to = places[after] if after < len(places) else places[0]
            follows = at + j == d + 1 and to == i + 1
            if to <= i:  # the item starts again
                self.close()
            mine = item.tokens[to : to + n]
            for a, b in ((mine[-1], here[-1]),) if follows else zip(mine, here):
                if a[0] != "=" and (self.forth.setdefault(a, b) != b or self.back.setdefault(b, a) != a):
                    self.ok = False
            if mine != here and sum(t[0] == "=" for t in here) >= least_plain(n):
                self.n += 1
            self._last = (at + j, to)


_OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("field", pa.string()), ("part", pa.int64()), ("kind", pa.string()), ("n_windows", pa.int64())])
_OUT_DDL = "doc_id bigint, item_id bigint, field string, part bigint, kind string, n_windows bigint"


def _check(batches):
    """Rows sorted by document, item, family and place: each stretch with the item it may hold."""
    group, of, item, seen, out = None, None, None, {}, []

    def end():
        for s in seen.values():
            s.close()
        exact = seen[PLAIN].exact if PLAIN in seen else 0
        changed = max((s.changed for s in seen.values()), default=0)
        return [(group[0], *group[2:], k, n) for k, n in (("exact", exact), ("reparameterised", changed)) if n]

    for b in batches:
        for doc, row, item_id, field, part, family, words, at, tokens, theirs in zip(*(c.to_pylist() for c in b.columns)):
            key = (doc, row, item_id, field, part)
            if key != group:
                if group is not None:
                    out += end()
                group, seen = key, {}
            if (item_id, field, part, family) != of:
                of, item = (item_id, field, part, family), _Item(theirs, words)
            seen.setdefault(family, _Instances()).stretch(item, at, tokens)
        if len(out) > 1000:
            yield _batch(out, _OUT)
            out = []
    if group is not None:
        out += end()
    if out:
        yield _batch(out, _OUT)


def find_leaks(documents: DataFrame, items: DataFrame, block_windows: int = BLOCK_WINDOWS, fields: tuple[str, ...] = tuple(FIELDS)) -> DataFrame:
    """One row per document, item, searched field and kind of match with the number of matching windows.

    ``documents``: ``doc_id``, ``text``; ``items``: ``item_id`` and the ``fields`` (those it lacks are not searched). Rows with a
    null id or text match nothing; texts shorter than their field's window match nothing. Rows with one id add up.
    """
    spark = documents.sparkSession
    docs = documents.select("doc_id", "text").filter("doc_id is not null and text is not null")
    fields = tuple(f for f in fields if f in items.columns)
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields))).alias("x")
    texts = items.select(F.col("item_id").cast("bigint").alias("item_id"), each).select("item_id", "x.field", "x.text").filter("item_id is not null and text is not null")
    # items with one text are searched as one, under their smallest id, and told apart at the end
    texts = texts.select("item_id", "field", F.xxhash64("text").alias("part"), "text").distinct()
    texts = written(texts.join(texts.groupBy("field", "part", "text").agg(F.min("item_id").alias("first")), ["field", "part", "text"]), "texts")
    members = texts.select(F.col("first").alias("f"), "field", "part", "item_id")
    held = written(texts.filter("item_id = first").select("item_id", "field", "part", "text").mapInArrow(_item_windows, _ITEM_DDL), "items")
    hashes = held.select("family", "words", F.explode("hashes").alias("h"), "item_id", "field", "part")
    distinct = hashes.select("h").distinct()
    known = None
    if distinct.limit(block_windows + 1).count() <= block_windows:
        known = spark.sparkContext.broadcast(np.sort(distinct.toPandas()["h"].to_numpy(np.int64).view(np.uint64)))
    stretches = written(docs.mapInArrow(_search(known, _families(fields)), _STRETCH_DDL), "stretches")
    place = ["doc_id", "row", "family", "words", "at"]
    of = ["item_id", "field", "part", "family", "words"]
    pairs = stretches.select(*place, F.explode("hashes").alias("h")).join(small(hashes), ["family", "words", "h"]).select(*place, "item_id", "field", "part").distinct()
    whole = pairs.join(stretches.select(*place, "tokens"), place).join(small(held.select(*of, F.col("tokens").alias("theirs"))), of)
    key = ["doc_id", "row", "item_id", "field", "part", "family", "words", "at"]
    sorted_ = whole.repartition("doc_id", "row", "item_id").sortWithinPartitions(*key)
    found = sorted_.select(*key, "tokens", "theirs").mapInArrow(_check, _OUT_DDL).withColumnRenamed("item_id", "f")
    return found.join(small(members), ["f", "field", "part"]).groupBy("doc_id", "item_id", "field", "kind").agg(F.sum("n_windows").alias("n_windows"))
