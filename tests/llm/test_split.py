import random

from hypothesis import given, settings
from hypothesis import strategies as st

from loomlog.llm import split, tokens

E = tokens.encoding()


def check(text, limit, overlap):
    pieces = split.split_text(text, None, limit, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text) and pieces[-1][3] == "end"
    for a, e, n, _ in pieces:
        assert n == len(E.encode_ordinary(text[a:e])) and (n <= limit or e - a == 1)
    for x, y in zip(pieces, pieces[1:]):
        assert x[0] < y[0] <= x[1] < y[1]
    return pieces


@given(st.lists(st.sampled_from(["word ", "Sentence one. ", "\n\n", "\n== H ==\n", "\n* item", "\n|-\n| cell", "日本語。", "漢字", "x" * 30, "😀", "  ", "ೞ", "!"]), min_size=1, max_size=400).map("".join), st.sampled_from([(20, 4), (60, 10), (200, 16)]))
@settings(max_examples=150, deadline=None)
def test_pieces_cover_and_fit(text, size):
    check(text, *size)


def test_natural_boundaries_come_first():
    rng = random.Random(1)
    section = lambda i: f"\n== Part {i} ==\n" + " ".join(f"Word{rng.randrange(99)} and more of it." for _ in range(20))
    text = "".join(section(i) for i in range(12))
    pieces = check(text, 400, 32)
    assert all(p[3] == "section" for p in pieces[:-1])
    for (_, e, _, _), (a, _, _, _) in zip(pieces, pieces[1:]):
        assert 8 <= len(E.encode_ordinary(text[a:e])) <= 64


def test_without_any_boundary():
    for text in ("x7" * 5000, "語" * 4000, "😀" * 3000):
        assert all(p[3] in ("character", "end") for p in check(text, 256, 16))


def test_documents(spark):
    long = "Some words here. " * 2000
    rows = [(1, long, "x"), (2, "short", "x"), (3, None, "x"), (4, "", "x"), (5, long, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, piece_no string")
    big = split.split_documents(df, oversized_only=True).collect()
    assert {r["doc_id"] for r in big} == {1, 5} and all(r["n_tokens"] <= split.LIMIT and long[r["start"] : r["end"]] == r["text"] for r in big)
    every = split.split_documents(df, with_text=False).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in every if r["doc_id"] in (2, 3, 4)} == {2: 1, 3: 1, 4: 1}
    assert split.split_documents(df.limit(0)).count() == 0
