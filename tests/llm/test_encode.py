import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomlog.llm import encode, tokens

E = tokens.encoding()
PIECES = ["the ", "naïve", "  ", "\n\n", "'s", "’s", "日本語のテキスト", "。", "1234", " 5", "<|endoftext|>", "​", "é", "é", "😀", "ß", "\t", "don't", "x'll", "{{a|b}}", "مرحبا", "١", " ", " ", "ಕನ್ನಡ", "\U000e0001", "�"]
ANY = st.one_of(st.text(max_size=200), st.lists(st.sampled_from(PIECES), max_size=120).map("".join))


def through_chunks(text: str) -> list[int]:
    starts, repairs = encode.cuts(text)
    ends = [*starts[1:], len(text)]
    parts = [encode.np.array(E.encode_ordinary(text[a:e]), encode.np.uint16) for a, e in zip(starts, ends)]
    fixes = [{"first": f, "last": last, "left": len(text[a : ends[f]].encode()), "right": len(text[starts[last] : e].encode()), "text": text[a:e]} for f, last, a, e in repairs]
    return [i for p in encode.join_chunks(parts, fixes, None) for i in p.tolist()]


@given(ANY)
@settings(max_examples=300, deadline=None)
def test_safe_cuts_are_token_boundaries(text):
    if not text:
        return
    safe = tokens.safe_cuts(tokens.class_of(tokens.code_points(text)))
    want = E.encode_ordinary(text)
    for i in range(1, len(text)):
        if safe[i]:
            assert E.encode_ordinary(text[:i]) + E.encode_ordinary(text[i:]) == want


@given(ANY)
@settings(max_examples=200, deadline=None)
def test_chunks_join_to_the_whole(text):
    text = text * 20
    if text:
        assert through_chunks(text) == E.encode_ordinary(text)


@pytest.mark.parametrize("alphabet", ["ab", "語", "日本語文字列漢字", "!?", " ", "a b", "\n", "1", "é"])
def test_texts_without_safe_places_are_repaired(alphabet, monkeypatch):
    monkeypatch.setattr(encode, "MASK_BITS", 5)
    rng = random.Random(1)
    text = "".join(rng.choice(alphabet) for _ in range(6000))
    for t in (text, "word " + text + " end", text + "." + text, "x" * 500 + text[:900] + " " + "y" * 700):
        assert through_chunks(t) == E.encode_ordinary(t)


def test_repairs_happen(monkeypatch):
    monkeypatch.setattr(encode, "MASK_BITS", 5)
    rng = random.Random(2)
    text = "one two " + "".join(rng.choice("abcdefgh") for _ in range(3000)) + " three"
    assert encode.cuts(text)[1] and through_chunks(text) == E.encode_ordinary(text)


def test_chunks_are_content_defined():
    rng = random.Random(3)
    body = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(4000))
    a = {body[x:y] for x, y in zip(encode.cuts(body)[0], [*encode.cuts(body)[0][1:], len(body)])}
    moved = "An inserted start. " + body
    starts = encode.cuts(moved)[0]
    b = {moved[x:y] for x, y in zip(starts, [*starts[1:], len(moved)])}
    assert len(a & b) > 0.9 * len(a)


def test_corpus(spark, monkeypatch):
    monkeypatch.setattr(encode, "BLOCK_CHARS", 3000)
    rng = random.Random(4)
    base = " ".join(rng.choice(PIECES) for _ in range(600))
    rows = [(i, base[: rng.randrange(len(base))] + str(i), "x", 1) for i in range(60)] + [(60, None, "x", 1), (61, "", "x", 1), (62, "   ", "x", 1), (None, "null id", "x", 1), (7, "repeated id", "x", 1), (63, base * 30, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, block int").repartition(3)
    got = [(r["doc_id"], list(r["ids"])) for r in encode.encode_corpus(df).collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(got, key=key) == sorted(((i, E.encode_ordinary(t or "")) for i, t, _, _ in rows), key=key)
    assert encode.encode_corpus(df.limit(0)).count() == 0
