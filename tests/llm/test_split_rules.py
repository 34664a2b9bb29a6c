"""Size, overlap and boundary of every piece, against the rules read straight from the text."""

import random
import re
import time

import pyarrow.parquet as pq
from loomlog.llm import split, tokens

E = tokens.encoding()
#: Where a natural boundary can be, read anew: heads, blank lines, line ends, ends of sentences.
NATURAL = re.compile(r"\n(?===+[^=\n])|\n[ \t]*\n+|\n|(?<=[.!?…])[\"'»”)\]]*\s+|[。！？।؟۔]+[”』」]*")


def n(text):
    return len(E.encode_ordinary(text))


def broken(text, limit=split.LIMIT, overlap=split.OVERLAP):
    """What is wrong with the pieces of a text."""
    pieces = split.split_text(text, None, limit, overlap)
    marks = {m.end() for m in NATURAL.finditer(text)}
    if pieces[0][0] != 0 or pieces[-1][1] != len(text):
        yield "does not cover the text"
    for k, (a, e, size, name) in enumerate(pieces):
        if size != n(text[a:e]) or size > limit and e - a > 1:
            yield f"piece {k} has {size} tokens"
        if k == 0:
            continue
        done = pieces[k - 1][1]
        if not pieces[k - 1][0] < a <= done < e:
            yield f"piece {k} leaves a gap or goes back"
        if name in ("word", "character") and any(done < m <= e for m in marks):
            yield f"piece {k} ends inside a sentence although a boundary stands in it"
        over = n(text[a:done])
        tight = size > limit - overlap  # a whole unit may leave less room
        if over > 2 * overlap or over < overlap // 2 and not tight and done - pieces[k - 1][0] > 4 * overlap:
            yield f"piece {k} overlaps by {over} tokens"


def section(i, words):
    return f"== Part {i} ==\n" + "alpha beta " * words


def test_sections_that_fit_stay_whole():
    text = ""
    for i in range(3):
        s = section(i, 10)
        while n(s) < 1905:
            s += "gamma delta. "
        text += s + "\n"
    pieces = split.split_text(text)
    assert len(pieces) == 3 and [p[3] for p in pieces] == ["section", "section", "end"] and not list(broken(text))


def test_a_sentence_that_fits_the_limit_is_not_cut():
    for size in (1930, 2000, 2040):
        long = "one two " * (size // 2 - 2)
        text = "Some words here. " * 30 + "\n" + long.strip() + ".\n" + "More words here. " * 30
        assert all(p[3] not in ("word", "character") for p in split.split_text(text)) and not list(broken(text))


def test_word_cuts_only_where_nothing_else_is():
    text = "A short start.\n\n" + "word " * 5000 + "\n\nAn end. " + "Small. " * 900
    assert not list(broken(text))


def test_rules_hold_on_random_texts():
    rng = random.Random(3)
    parts = ["word ", "Sentence one. ", "\n\n", "\n== H ==\n", "\n* item", "\n|-\n| cell", "日本語。", "漢字", "x" * 30, "😀", "  ", "ೞ", "!"]
    for _ in range(60):
        weight = [rng.random() ** 3 for _ in parts]
        text = "".join(rng.choices(parts, weight, k=rng.randrange(1500)))
        assert not [x for x in broken(text, 200, 16) if "overlaps" not in x]


def test_rules_hold_on_the_corpus():
    t = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    long = [x for x in t if x and n(x) > split.LIMIT]
    wrong = [w for x in long for w in broken(x)]
    assert long and not wrong, wrong[:5]


def test_time_grows_with_the_text():
    def took(k):
        text = "Some words. More of them,\n" * k
        t = time.process_time()
        split.split_text(text)
        return time.process_time() - t

    took(1000)
    assert took(80_000) < 8 * took(20_000)
