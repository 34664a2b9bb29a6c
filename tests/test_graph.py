"""Lineage over numeric ids: loops named by their smallest number, subtrees of any depth."""

from loomlog.operators import graph

LOG = "position bigint, event_id bigint, parent_id bigint, correlation_id string, event_type string"


def log(spark, rows):
    return spark.createDataFrame([(i + 1, e, p, c, "t") for i, (e, p, c) in enumerate(rows)], LOG)


def test_loops_are_named_by_the_smallest_number(spark):
    rows = [(9, 10, "a"), (10, 9, "a"), (11, 10, "a"), (100, None, "a"), (2, 100, "a"), (-5, 2, "a"), (7, 999, "a"), (-3, -3, "b")]
    got = {r["event_id"]: (r["root_id"], r["depth"]) for r in graph.depths(log(spark, rows)).collect()}
    assert got == {9: (9, -1), 10: (9, -1), 11: (9, -1), 100: (100, 0), 2: (100, 1), -5: (100, 2), 7: (7, 0), -3: (-3, -1)}


def test_subtrees_have_no_deepest_level(spark):
    n = 12_000
    rows = [(i, i - 1 if i else None, "a") for i in range(n)] + [(n + 1, 5, "b")]
    got = {r["event_id"]: r["level"] for r in graph.subtree(log(spark, rows), 11).collect()}
    assert got == {i: i - 10 for i in range(10, n)}  # position 11 is event 10; the other correlation is left out


def test_the_subtree_of_an_event_on_a_loop(spark):
    rows = [(1, 3, "a"), (2, 1, "a"), (3, 2, "a"), (4, 3, "a"), (5, None, "a")]
    got = {r["event_id"]: r["level"] for r in graph.subtree(log(spark, rows), 2).collect()}
    assert got == {2: 0, 3: 1, 1: 2, 4: 2}
    assert graph.subtree(log(spark, rows), 99).collect() == []
