import random

import pytest

from loomlog.operators import hierarchy

SCHEMA = "key binary, parent binary, ord bigint, extra string, top string"


def brute(nodes):
    up = {k: p for k, p in nodes}
    out = {}
    for k in up:
        seen, x = [k], k
        while up.get(x) is not None and up[x] in up and up[x] not in seen:
            x = up[x]
            seen.append(x)
        nxt = up.get(x)
        if nxt is not None and nxt in up:
            loop = seen[seen.index(nxt) :]
            out[k] = (min(loop), -1)
        else:
            out[k] = (x, len(seen) - 1)
    return out


def forest(rng, n, loops, local):
    keys = [bytes([rng.randrange(256) for _ in range(4)]) + i.to_bytes(4, "big") for i in range(n)]
    nodes = []
    for i, k in enumerate(keys):
        if i == 0 or rng.random() < 0.05:
            p = None
        elif rng.random() < 0.02:
            p = b"absent" + bytes([rng.randrange(256)])
        else:
            p = keys[rng.randrange(max(0, i - 5) if local else 0, i)]
        nodes.append([k, p])
    for _ in range(loops):
        nodes[rng.randrange(n)][1] = keys[rng.randrange(n)]
    if n > 3 and loops:
        nodes[3][1] = keys[3]
    return [tuple(x) for x in nodes]


@pytest.mark.parametrize("n,loops,local,parts,base", [(0, 0, True, 3, 10), (1, 0, True, 3, 10), (300, 6, True, 4, 200_000), (300, 6, False, 4, 3), (400, 10, True, 8, 3), (200, 0, False, 3, 1)])
def test_resolve(spark, n, loops, local, parts, base):
    rng = random.Random(n + loops)
    nodes = forest(rng, n, loops, local)
    df = spark.createDataFrame([(bytearray(k), None if p is None else bytearray(p), i, "x", "y") for i, (k, p) in enumerate(nodes)], SCHEMA)
    got = {bytes(r["key"]): (bytes(r["top"]), r["depth"]) for r in hierarchy.resolve(df, parts, base).collect()}
    assert got == brute(nodes)


def test_one_long_chain_and_one_big_loop(spark):
    n = 3000
    key = lambda i: bytearray(i.to_bytes(4, "big"))
    shuffled = list(range(n))
    random.Random(1).shuffle(shuffled)
    chain = [(key(i), key(i - 1) if i else None, shuffled[i], "", "") for i in range(n)]
    got = {int.from_bytes(r["key"], "big"): r["depth"] for r in hierarchy.resolve(spark.createDataFrame(chain, SCHEMA), 4, 10).collect()}
    assert got == {i: i for i in range(n)}
    loop = [(key(i), key((i - 1) % n), shuffled[i], "", "") for i in range(n)]
    rows = hierarchy.resolve(spark.createDataFrame(loop, SCHEMA), 4, 10).collect()
    assert {(int.from_bytes(r["top"], "big"), r["depth"]) for r in rows} == {(0, -1)} and len(rows) == n


def test_paths_and_descendants(spark):
    nodes = forest(random.Random(5), 120, 3, True)
    df = spark.createDataFrame([(bytearray(k), None if p is None else bytearray(p), i, "x", "y") for i, (k, p) in enumerate(nodes)], SCHEMA)
    solved = hierarchy.resolve(df, 3, 10)
    up, want = dict(nodes), brute(nodes)

    def path(k):
        out = [k]
        while up.get(out[0]) in up:
            out.insert(0, up[out[0]])
        return out

    paths = {bytes(r["key"]): r["path"] for r in hierarchy.paths(df, solved).collect()}
    assert {k: None if p is None else [bytes(x) for x in p] for k, p in paths.items()} == {k: None if want[k][1] < 0 else path(k) for k in up}
    below = {bytes(r["key"]): r["n_descendants"] for r in hierarchy.descendants(df, solved).collect()}
    assert below == {k: sum(1 for x in up if x != k and want[x][1] >= 0 and k in path(x)) for k in up if want[k][1] >= 0}
