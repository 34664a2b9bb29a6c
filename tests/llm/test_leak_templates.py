"""Re-parameterised leaks: values that no item knows, one mapping per instance, units by their place, questions, both ways
of joining."""

import random

from loomlog.llm import leak

SYLLABLES = ["ka", "ro", "mi", "ten", "sol", "var", "ni", "dra", "pel", "us", "go", "lin"]
FRAMES = [
    "the traveller {N} reached {M} on day {a} with {b} {u} of cargo and after {a} days the people of {M} thanked {N} for it",
    "in the year {a} the town council asked {N} to build {b} houses near the river because {M} had lost {b} of them",
    "when {N} counted the sheep there were {a} on the hill and {b} in the barn so {M} bought only {b} more from the farm",
    "a train leaves at {a} and moves {b} {u} each hour while {N} waits for it with {M} until the evening bell has rung",
]


def word(rng, n=3):
    return "".join(rng.choice(SYLLABLES) for _ in range(n))


def filled(rng, frame, suffix):
    a, b = rng.sample(range(10, 9999), 2)
    return frame.format(N=word(rng).capitalize() + suffix, M=word(rng).capitalize() + suffix + "x", a=a, b=b, u=rng.choice(["kg", "km", "lb", "t"]))


def rows(spark, docs, items, **k):
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    i = spark.createDataFrame(items, "item_id bigint, passage string")
    return {(r["doc_id"], r["item_id"], r["field"], r["kind"]): r["n_windows"] for r in leak.find_leaks(d, i, **k).collect()}


def test_recall_and_precision_with_unseen_values(spark):
    rng = random.Random(4)
    frames = [f"{word(rng, 2)} {word(rng, 2)} {f} {word(rng, 2)} {word(rng, 2)}" for f in FRAMES for _ in range(20)]
    items = [(i, filled(rng, f, "")) for i, f in enumerate(frames)]
    filler = lambda: " ".join(word(rng) for _ in range(rng.randrange(40)))
    docs, planted = [], set()
    for i, f in enumerate(frames):
        docs.append((1000 + i, f"{filler()}. {filled(rng, f, 'ov')}. {filler()}"))  # names that stand in no item
        planted.add((1000 + i, i))
        docs.append((3000 + i, f"{filler()} {word(rng).capitalize()} {rng.randrange(99)} {filler()}"))
    got = {(d, i) for d, i, _, kind in rows(spark, docs, items) if kind == "reparameterised"}
    right = {(d, i) for d, i in got if d < 3000 and (d - 1000) // 20 == i // 20}  # another item of the same frame is as good
    assert len(planted & got) >= 0.9 * len(planted) and len(right) >= 0.95 * len(got)


def test_a_name_no_item_knows(spark):
    item = "On day 12 the ship Orlando left port with 300 kg of salt and Orlando came back after 12 days at sea"
    got = rows(spark, [(1, item.replace("Orlando", "Cassandra")), (2, item.replace("Orlando", "Cassandra", 1))], [(9, item)])
    assert (1, 9, "passage", "reparameterised") in got
    assert (2, 9, "passage", "reparameterised") not in got  # two names for one


def test_one_mapping_for_all_windows_of_an_instance(spark):
    middle = " ".join(f"w{x}" for x in "abcdefghijklmnopqrstu")
    item = f"it took them 5 days to {middle} and after that another 5 days"
    wrong, right = item.replace("5", "7", 1).replace("5", "9"), item.replace("5", "7")
    edited = right.replace("wk", "wz")
    docs = [(1, wrong), (2, right), (3, right + " . " + item.replace("5", "8")), (4, edited), (5, edited.replace("another 7", "another 9"))]
    got = {d for d, _, _, kind in rows(spark, docs, [(7, item)]) if kind == "reparameterised"}
    assert got == {2, 3, 4}  # twice with other values is two instances; an edit between does not part one


def test_units_only_after_numbers(spark):
    item = "they lived for many long winters in a house beside the old stone bridge of town"
    docs = [(1, item.replace("in a house", "a in house")), (2, "we saw 5 m of the long red rope that hangs beside the old stone bridge")]
    got = rows(spark, docs, [(1, item), (2, docs[1][1].replace("5 m", "6 ft"))])
    assert not any(k[:2] == (1, 1) for k in got) and (2, 2, "passage", "reparameterised") in got


def test_questions_are_searched(spark):
    d = spark.createDataFrame([(1, "so: How many apples did Cassandra give to her brother? ok"), (2, "How many apples did")], "doc_id bigint, text string")
    i = spark.createDataFrame([(3, None, "How many apples did Orlando give to her brother?")], "item_id bigint, passage string, question string")
    got = {tuple(r)[:4] for r in leak.find_leaks(d, i).collect()}
    assert got == {(1, 3, "question", "reparameterised")}
    assert leak.find_leaks(d, i, fields=("passage",)).collect() == []


def test_broadcast_and_shuffle_agree(spark):
    rng = random.Random(8)
    items = [(i, filled(rng, rng.choice(FRAMES), "")) for i in range(30)] + [(30, "w " * 40), (31, ""), (None, "x " * 20)]
    docs = [(d, " ".join([filled(rng, rng.choice(FRAMES), "ov"), items[rng.randrange(30)][1].upper()])) for d in range(60)]
    docs += [(60, "W w " * 60), (61, ""), (None, items[0][1]), (7, docs[7][1])]
    one = rows(spark, docs, items)
    assert one and one == rows(spark, docs, items, block_windows=0) == rows(spark, docs, items, block_windows=100)
    assert one[(7, *next(k[1:] for k in one if k[0] == 7))] % 2 == 0  # repeated rows of one id add up
