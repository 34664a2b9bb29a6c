"""Vocabularies over 65,536 ids, other public tokenizers, and repairs that find no token boundary."""

import base64

import numpy as np
import pytest
from loomlog.llm import encode, tokens

TEXTS = ["one two three " * 40, "naïve 日本語のテキスト 12,345 <|endoftext|>", "", None, "x" * 5000, "  \n\n tabs\tand more " * 9]


@pytest.fixture(scope="module")
def wide(tmp_path_factory):
    """Ranks of the public file moved up, so that most ids pass 65,535."""
    at = tmp_path_factory.mktemp("ranks") / "wide.tiktoken"
    with open(tokens.default_ranks(), "rb") as f:
        pairs = [x.split() for x in f]
    at.write_bytes(b"\n".join(a + b" " + str(int(b) + 70_000).encode() for a, b in pairs) + b"\n")
    assert base64.b64decode(pairs[0][0])
    return str(at)


def encoded(spark, path):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").repartition(2)
    return {r["doc_id"]: list(r["ids"]) for r in encode.encode_corpus(df, path).collect()}


def test_wide_ids(spark, wide):
    assert tokens.id_type(wide) is np.uint32 and tokens.id_type() is np.uint16
    e = tokens.encoding(wide)
    assert encoded(spark, wide) == {i: e.encode_ordinary(t or "") for i, t in enumerate(TEXTS)}


def test_the_tokenizer_for_many_languages(spark):
    path = tokens.ranks("byte_bpe_multi_50k")
    e = tokens.encoding(path)
    assert encoded(spark, path) == {i: e.encode_ordinary(t or "") for i, t in enumerate(TEXTS)}


def test_a_repair_without_a_boundary_is_widened_to_the_text():
    e = tokens.encoding()
    text = "hello wonderful world of tokens"
    cut = text.index("derful")
    parts = [np.array(e.encode_ordinary(x), np.uint16) for x in (text[:cut], text[cut:])]
    for left, right in ((1, 3), (2, 1), (10**6, 0)):
        fix = [{"first": 0, "last": 1, "left": left, "right": right, "text": "?"}]
        if encode._trim(parts[0], left, tokens.token_bytes(), True) is None or encode._trim(parts[1], right, tokens.token_bytes(), False) is None:
            got = [i for p in encode.join_chunks(parts, fix, None) for i in p.tolist()]
            assert got == e.encode_ordinary(text)
    assert encode._trim(parts[0], 10**6, tokens.token_bytes(), True) is None
