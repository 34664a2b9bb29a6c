import random

import pytest

from loomlog.llm import leak, wikitext


@pytest.mark.parametrize(
    "markup,shown",
    [
        ("a '''bold''' b", "a bold b"), ("pre[[Target|fix]]ed", "prefixed"), ("[[Plain]] x", "Plain x"), ("[[Foo (bar)|]] x", "Foo x"),
        ("a{{cite|x={{y}}}}b", "ab"), ("a {{{1|{{b}}}}} c", "a  c"), ("a<ref name=x/> b<ref>hid <b>den</b></ref> c", "a b c"), ("a<!-- x -- y -->b", "ab"),
        ("{| class=\"w\"\n|-\n| style=\"color:red\" | one || two\n|}", "one  two"), ("[[Category:X]]a[[fr:B]]", "a"), ("[[:Category:X]]", "Category:X"),
        ("<nowiki>[[a]] {{b}}</nowiki>", "[[a]] {{b}}"), ("&eacute;&#97;&#x62;&nbsp;c &ndash; &amp;#97; &NDASH; &bogus;", "éab c – &#97; – &bogus;"),
        ("[http://x.y label here] z", "label here z"), ("[[File:A.jpg|thumb|200px|The [[cap|caption]]]]", "The caption"), ("a<br/>b <s>c</s>", "a b c"),
        ("{{unclosed [[link", "{{unclosed [[link"), ("<gallery>\nA.jpg|cap one\n</gallery>", "cap one"), ("<|endoftext|> __NOTOC__", "<|endoftext|>"),
        ("<ref>open a<ref>in</ref> b", "open a b"),
    ],
)
def test_readable(markup, shown):
    assert wikitext.words(wikitext.readable(markup)) == wikitext.words(shown)
    if "|" not in markup or "{|" not in markup:
        assert " ".join(wikitext.readable(markup).split()) == " ".join(shown.split())


def test_words_fold():
    assert wikitext.words("Élan VITAL, na­ïve ét​e ﬁn Straße №5 ２３ don't") == ["elan", "vital", "naive", "ete", "fin", "strasse", "no5", "23", "don", "t"]
    assert wikitext.words("日本語、テスト。한국어 हिन्दी") == ["日本語", "テスト", "한국어", "".join(wikitext.words("हिन्दी"))]
    assert wikitext.words("") == [] == wikitext.words(" \n.​")


def passages(rng, n):
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 7))) for _ in range(150)]
    return vocab, [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([5, 12, 13, 30, 60])))) for i in range(n)]


def test_against_brute_force(spark):
    rng = random.Random(6)
    vocab, items = passages(rng, 40)
    docs = []
    for d in range(300):
        words = [rng.choice(vocab) for _ in range(rng.randrange(80))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(items)[1].split()
            a, n = rng.randrange(len(p)), rng.choice([5, 12, 13, 14, 40])
            at = rng.randrange(len(words) + 1)
            words[at:at] = [rng.choice([w, w.upper(), f"'''{w}'''", f"[[x|{w}]]", w + "<ref>zz</ref>", w + ",", "\n* " + w]) for w in p[a : a + n]]
        docs.append((d, " ".join(words)))
    docs += [(300, None), (301, ""), (302, " ".join(["w"] * 400)), (None, items[3][1])]
    items += [(40, None), (41, ""), (None, "a b c"), (42, " ".join(["w"] * 20)), (43, items[3][1])]

    def grams(t):
        w = wikitext.words(wikitext.readable(t or ""))
        return {tuple(w[i : i + 13]) for i in range(len(w) - 12)}

    want = {(d, i) for d, t in docs for i, p in items if d is not None and i is not None and grams(t) & grams(p)}
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id bigint, text string, item_id int").repartition(4)
    it = spark.createDataFrame([(i, p, "x") for i, p in items], "item_id bigint, passage string, text string")
    for block in (leak.BLOCK_WINDOWS, 40):  # with small blocks many passes give the same
        rows = leak.find_leaks(df, it, block).filter("kind = 'exact'").collect()
        assert len(rows) == len({(r["doc_id"], r["item_id"]) for r in rows})
        assert {(r["doc_id"], r["item_id"]) for r in rows} == want and len(want) > 20
    assert leak.find_leaks(df.limit(0), it).count() == 0 and leak.find_leaks(df, it.limit(0)).count() == 0


def test_reparameterised(spark):
    item = "On day 12 the ship Orlando left port with 300 kg of salt and Orlando came back after 12 days at sea"
    other = item.replace("12", "45").replace("300", "7").replace("kg", "lb").replace("Orlando", "Minerva")
    broken = item.replace("12", "45", 1)
    d = spark.createDataFrame([(1, item), (2, other), (3, broken), (4, "nothing at all")], "doc_id bigint, text string")
    i = spark.createDataFrame([(9, item + ". Then Minerva and Orlando sailed")], "item_id bigint, passage string")
    got = {(r["doc_id"], r["kind"]) for r in leak.find_leaks(d, i).collect()}
    assert (1, "exact") in got and (2, "reparameterised") in got and (2, "exact") not in got and not any(x == 4 for x, _ in got)
    assert leak.slots(["a", "1", "1"], ["a", "2", "3"]) is None and leak.slots(["1", "2"], ["3", "3"]) is None
