"""Parent-child links to full hierarchies.

Method: contract the parent chains inside each partition to the fragment exits, solve the smaller forest of fragments in
the same way, then expand. Rows are placed by a locality column (the log's ``seq``: parents stand shortly before their
children), so few links leave a partition and no key, however frequent, decides a partition's size.

Input: ``key`` (binary, unique, not null), ``parent`` (binary or null), ``ord`` (bigint). A parent that is not among the
keys makes its child a root. Result: one row per key with ``top`` (root, or for a loop and all that hangs below it the
smallest key on the loop), ``depth`` (links to the root, -1 for loops) and ``cyclic``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.session import discard, lookup, partitions, written

#: A quotient of at most this many fragments is solved by one task.
BASE_ROWS = 200_000

_LINKS = "key binary, parent binary, w bigint, m binary, ord bigint"
_OUT = pa.schema(
    [("key", pa.binary()), ("top", pa.binary()), ("dist", pa.int64()), ("m", pa.binary()), ("cyclic", pa.bool_()),
     ("open", pa.bool_()), ("parent", pa.binary()), ("w", pa.int64()), ("pm", pa.binary()), ("ord", pa.int64())]
)
_OUT_DDL = (
    "key binary, top binary, dist bigint, m binary, cyclic boolean, open boolean, parent binary, w bigint, "
    "pm binary, ord bigint"
)


def _binary(column: pa.ChunkedArray) -> pa.Array:
    return (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).cast(pa.binary())


def contract(links: pa.Table) -> pa.Table:
    """Follow every chain of ``links`` as far as it stays in the table, by pointer doubling.

    ``w`` is the number of original links a link stands for and ``m`` the smallest key after its start, up to and with
    its end. Of the result, ``parent``/``w``/``pm`` are set on the rows where a chain leaves the table.
    """
    n = links.num_rows
    key, parent, m = (_binary(links[c]) for c in ("key", "parent", "m"))
    at = pc.fill_null(pc.index_in(parent, value_set=key), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    own_w = links["w"].to_numpy().astype(np.int64)
    order = pc.sort_indices(m).to_numpy().astype(np.int64)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    none = n
    root = at < 0
    nxt = np.where(root, np.arange(n), at)
    dist = np.where(root, 0, own_w)
    least = np.where(root, none, rank)
    for _ in range(max(1, math.ceil(math.log2(n + 1)) + 1)):
        if root[nxt].all():
            break
        dist, least, nxt = dist + dist[nxt], np.minimum(least, least[nxt]), nxt[nxt]
    loop = ~root[nxt]
    by_rank = np.append(order, 0)
    least_of = np.where(loop, least[nxt], least)  # the end of an endless chain stands on its loop
    smallest = m.take(pa.array(by_rank[least_of], mask=least_of == none))
    top = key.take(pa.array(nxt))
    if loop.any():
        top = pc.if_else(pa.array(loop), smallest, top)
    leaves = root & parent.is_valid().to_numpy(zero_copy_only=False)
    leaves_a = pa.array(leaves)
    return pa.table(
        [key, top, pa.array(np.where(loop, -1, dist)), smallest, pa.array(loop), pa.array(leaves[nxt] & ~loop),
         pc.if_else(leaves_a, parent, pa.scalar(None, pa.binary())), pa.array(own_w, mask=~leaves),
         pc.if_else(leaves_a, m, pa.scalar(None, pa.binary())), links["ord"].combine_chunks()],
        schema=_OUT,
    )


def _contract_partition(batches):
    batches = [b for b in batches if b.num_rows]
    if batches:
        yield from contract(pa.Table.from_batches(batches).combine_chunks()).to_batches(max_chunksize=10_000)


def _double(links: DataFrame, n: int) -> DataFrame:
    """Links without any locality (more than half of them leave their partition, so contraction gains nothing): halve all
    chains by joins until each ends at a root; what never ends is a loop. Each round joins and writes all links that have not
    ended, and there are as many rounds as the longest chain of links has binary digits."""
    now = written(links.select("key", "parent", "w", "m", "ord"), "links")
    for _ in range(math.ceil(math.log2(n + 1)) + 1):
        to = now.select(F.col("key").alias("parent"), F.col("parent").alias("p2"), F.col("w").alias("w2"), F.col("m").alias("m2"))
        moving = now.filter("parent is not null").join(to, "parent")
        if moving.filter("p2 is not null").limit(1).count() == 0:
            break
        step = moving.select(
            "key", F.coalesce("p2", "parent").alias("parent"),
            (F.col("w") + F.when(F.col("p2").isNotNull(), F.col("w2")).otherwise(0)).alias("w"),
            F.when(F.col("p2").isNotNull(), F.least("m", "m2")).otherwise(F.col("m")).alias("m"), "ord",
        )
        last, now = now, written(step.unionByName(now.filter("parent is null")), "links")
        discard(last)
    # Every link now ends at a root or, on or below a loop, at a node of the loop whose own m is the loop's smallest.
    to = now.select(F.col("key").alias("parent"), F.col("parent").alias("p2"), F.col("m").alias("m2"))
    ends = now.filter("parent is not null").join(to, "parent").select(
        "key", F.when(F.col("p2").isNull(), F.col("parent")).otherwise(F.col("m2")).alias("top"), F.col("w").alias("dist"),
        F.col("p2").isNotNull().alias("cyclic"),
    )
    roots = now.filter("parent is null").select("key", F.col("key").alias("top"), F.lit(0).cast("bigint").alias("dist"), F.lit(False).alias("cyclic"))
    return ends.unionByName(roots)


def _solve(links: DataFrame, parts: int, base_rows: int, level: int = 0) -> DataFrame:
    """key, top, dist, cyclic for links whose parents may be missing from the keys."""
    placed = links.select("key", "parent", "w", "m", "ord")
    placed = placed.repartition(1) if parts <= 1 else placed.repartitionByRange(parts, "ord", "key")
    local = placed.mapInArrow(_contract_partition, _OUT_DDL)
    if parts <= 1:  # nothing leaves the one partition but links to absent parents
        return local.select("key", "top", "dist", "cyclic")
    local = written(local, f"fragments{level}")
    exits = local.filter("parent is not null").select("key", "parent", "w", "pm", "ord")
    to = local.select(F.col("key").alias("parent"), "top", "dist", "m", "cyclic", "open")
    onward = F.col("open")
    quotient = written(
        lookup(exits, to, "parent").select(
            "key",
            F.when(onward, F.col("top")).alias("parent"),
            (F.col("w") + F.coalesce("dist", F.lit(0))).alias("w"),
            F.least("pm", "m").alias("m"),
            "ord",
            F.when(~onward, F.col("top")).alias("end"),
            F.coalesce("cyclic", F.lit(False)).alias("end_cyclic"),
        ),
        f"quotient{level}",
    )
    n = quotient.count()
    if n == 0:
        return local.select("key", "top", "dist", "cyclic")
    before = local.count()
    if n <= base_rows:
        solved = _solve(quotient, 1, base_rows, level + 1)
    elif n > before / 2:
        solved = _double(quotient, n)
    else:
        solved = _solve(quotient, max(2, math.ceil(parts / 8)), base_rows, level + 1)
    # A fragment's top that ends at a settled node (or at an absent parent) passes that on to all that end at it.
    settled = quotient.select(F.col("key").alias("top"), "end", F.col("w").alias("end_w"), "end_cyclic")
    heads = solved.join(settled, "top", "left").select(
        F.col("key").alias("head"),
        F.coalesce("end", "top").alias("head_top"),
        (F.col("dist") + F.when(F.col("end").isNotNull(), F.col("end_w")).otherwise(0)).alias("head_dist"),
        (F.col("cyclic") | F.coalesce("end_cyclic", F.lit(False))).alias("head_cyclic"),
    )
    closed = local.filter("not open").select("key", "top", "dist", "cyclic")
    reopened = local.filter("open").select("key", F.col("top").alias("head"), "dist").join(heads, "head").select(
        "key", F.col("head_top").alias("top"), (F.col("dist") + F.col("head_dist")).alias("dist"), F.col("head_cyclic").alias("cyclic")
    )
    return closed.unionByName(reopened)


def resolve(nodes: DataFrame, parts: int | None = None, base_rows: int = BASE_ROWS) -> DataFrame:
    """Root, depth and loops of every node; see the module's text for input and result.

    Null keys are left out; of repeated keys all rows must agree. An empty input gives an empty result.
    """
    links = nodes.filter("key is not null").select(
        "key", "parent", F.lit(1).cast("bigint").alias("w"), F.col("parent").alias("m"), "ord"
    )
    return _solve(links, parts or partitions(nodes.sparkSession, 2), base_rows).select(
        "key", "top", F.when(F.col("cyclic"), F.lit(-1)).otherwise(F.col("dist")).cast("bigint").alias("depth"), "cyclic"
    )


_EXPANDED = pa.schema(
    [("key", pa.binary()), ("head", pa.binary()), ("above", pa.list_(pa.binary())), ("open", pa.bool_()), ("parent", pa.binary()),
     ("seg", pa.list_(pa.binary())), ("ord", pa.int64())]
)
_EXPANDED_DDL = "key binary, head binary, above array<binary>, open boolean, parent binary, seg array<binary>, ord bigint"
#: Path elements in one Arrow batch.
_ELEMENTS = 200_000


def _expand_partition(batches):
    """Per link (``key``, ``parent``, ``seg``: the nodes from its parent's side down to the key) the nodes ``above`` it as far
    as its chain stays in the partition. Chains end at a head: open heads go on in another partition and have their
    ``parent`` and ``seg`` set, and what hangs on them starts behind them; below the others ``above`` is whole. No loops."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    t = pa.Table.from_batches(batches)
    keys, segs, ords = t["key"].to_pylist(), t["seg"].to_pylist(), t["ord"].to_pylist()
    parents = t["parent"].to_pylist()
    at = {k: i for i, k in enumerate(keys)}
    above: list = [None] * len(keys)
    head = [0] * len(keys)
    for i in range(len(keys)):
        chain, x = [], i
        while above[x] is None:
            chain.append(x)
            up = at.get(parents[x]) if parents[x] is not None else None
            if up is None:
                y = chain.pop()
                head[y], above[y] = y, [] if parents[y] is not None else segs[y]
                break
            x = up
        for y in reversed(chain):
            up = at[parents[y]]
            head[y], above[y] = head[up], above[up] + segs[y]
    start, size = 0, 0
    for i in range(len(keys)):
        size += len(above[i]) + len(segs[i]) + 1
        if size >= _ELEMENTS or i == len(keys) - 1:
            of = range(start, i + 1)
            ends = [head[j] == j and parents[j] is not None for j in of]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for f, c in zip(_EXPANDED, (
                    keys[start : i + 1], [keys[head[j]] for j in of], above[start : i + 1], [parents[head[j]] is not None for j in of],
                    [parents[j] if e else None for j, e in zip(of, ends)], [segs[j] if e else None for j, e in zip(of, ends)], ords[start : i + 1],
                ))], schema=_EXPANDED,
            )
            start, size = i + 1, 0


def _double_above(links: DataFrame) -> DataFrame:
    """``key, above`` of links without any locality, by joins that halve all chains."""
    now = written(links.select("key", "parent", "seg"), "steps")
    while now.filter("parent is not null").limit(1).count():
        to = now.select(F.col("key").alias("parent"), F.col("parent").alias("p2"), F.col("seg").alias("seg2"))
        step = now.filter("parent is not null").join(to, "parent").select("key", F.col("p2").alias("parent"), F.concat("seg2", "seg").alias("seg"))
        last, now = now, written(step.unionByName(now.filter("parent is null")), "steps")
        discard(last)
    return now.select("key", F.col("seg").alias("above"))


def _above(links: DataFrame, parts: int, base_rows: int, level: int = 0) -> DataFrame:
    """``key, above``: expand the paths inside each fragment, solve the quotient of the fragments in the same way, and put
    the solved path of a fragment's head before the local paths of its nodes."""
    placed = links.select("key", "parent", "seg", "ord")
    placed = placed.repartition(1) if parts <= 1 else placed.repartitionByRange(parts, "ord", "key")
    local = placed.mapInArrow(_expand_partition, _EXPANDED_DDL)
    if parts <= 1:
        return local.select("key", "above")
    local = written(local, f"paths{level}")
    to = local.select(F.col("key").alias("parent"), "head", "above", "open")
    quotient = lookup(local.filter("parent is not null").select("key", "parent", "seg", "ord"), to, "parent", "inner").select(
        "key", F.when(F.col("open"), F.col("head")).alias("parent"), F.concat("above", "seg").alias("seg"), "ord"
    )
    quotient = written(quotient, f"steps{level}")
    n = quotient.count()
    if n == 0:
        return local.select("key", "above")
    if n <= base_rows:
        solved = _above(quotient, 1, base_rows, level + 1)
    elif n > local.count() / 2:
        solved = _double_above(quotient)
    else:
        solved = _above(quotient, max(2, math.ceil(parts / 8)), base_rows, level + 1)
    heads = solved.select(F.col("key").alias("head"), F.col("above").alias("before"))
    reopened = local.filter("open").select("key", "head", "above").join(heads, "head").select("key", F.concat("before", "above").alias("above"))
    return local.filter("not open").select("key", "above").unionByName(reopened)


def paths(nodes: DataFrame, resolved: DataFrame, parts: int | None = None, base_rows: int = BASE_ROWS) -> DataFrame:
    """``key`` and ``path``, the array of keys from the root to the node; null on and below loops.

    A root's path is itself. The arrays of one node are as long as its depth.
    """
    live = resolved.filter("not cyclic").select("key", "depth").join(nodes.filter("key is not null").select("key", "parent", "ord"), "key")
    up = F.when(F.col("depth") > 0, F.col("parent"))
    links = live.select("key", up.alias("parent"), F.when(up.isNotNull(), F.array("parent")).otherwise(F.array().cast("array<binary>")).alias("seg"), "ord")
    found = _above(links, parts or partitions(nodes.sparkSession, 2), base_rows)
    looped = resolved.filter("cyclic").select("key", F.lit(None).cast("array<binary>").alias("path"))
    return found.select("key", F.concat("above", F.array("key")).alias("path")).unionByName(looped)


def ancestors(nodes: DataFrame, resolved: DataFrame) -> DataFrame:
    """All (key, ancestor, distance) pairs, the closure of the trees; read by ``ancestor`` it lists all descendants.

    Loops and what hangs below them have no finite closure and are left out. The pairs are read off the paths, without a
    shuffle; every pair is output once, which is the size the question itself asks for.
    """
    return pairs(paths(nodes, resolved))


def pairs(found: DataFrame) -> DataFrame:
    """(key, ancestor, distance) of the ``paths`` result ``found``."""
    at = found.filter("path is not null").select("key", F.size("path").alias("n"), F.posexplode("path").alias("i", "ancestor"))
    return at.filter("i < n - 1").select("key", "ancestor", (F.col("n") - 1 - F.col("i")).cast("bigint").alias("distance"))


def descendants(nodes: DataFrame, resolved: DataFrame) -> DataFrame:
    """``key`` and ``n_descendants`` of every node outside loops."""
    n = ancestors(nodes, resolved).groupBy(F.col("ancestor").alias("key")).agg(F.count("*").alias("n"))
    return resolved.filter("not cyclic").select("key").join(n, "key", "left").select("key", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_descendants"))
