"""Parent-child links to full hierarchies: root, depth, path, descendants and cycles of every node.

Links form a forest of unknown depth in which every node names at most one parent. The operator works as a
weighted disjoint-set forest that is merged hierarchically:

1. Links are range-partitioned by (locality, node), so that most chains lie within one block whatever the skew of
   the locality column; every block finds, with vectorised path compression, each node's local representative and
   its offset to it. Local roots and local cycles are final there.
2. A chain that leaves its block ends in an *exit*. Only the distinct exits form the contracted graph of the next
   level, whose links carry the offsets of the level below. It is merged level by level: trees are hung below the tree
   they lead to, with their offset, wherever the toss of a hash lets the lower one move and the upper one stay, which
   leaves at most three quarters of the trees that lead on, and trees that lead to a root end there. When at most
   `merge_rows` nodes are left, one block resolves them in the same way as the first. Then the levels are gone back,
   and each hung tree finds its root, offset and cycle with one lookup. All levels together are as large as a few
   times the first, whatever the shape of the forest.
3. Exits are looked up once to give all rows their root and depth; paths come from following the indexed parents
   within a block and concatenating the blocks' pieces along the exits.

Defined results: a null node is no node, a null parent is none; repeated rows count once; a node that names several
parents keeps the smallest; a parent that is no node itself leaves its child a root. If a way never ends, the root is
the smallest node of the cycle reached, the depth ON_CYCLE on it and TO_CYCLE outside, and the path is null.
An empty table gives an empty result. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.session import blocks, cut, small, stored

ON_CYCLE, TO_CYCLE = -1, -2
#: What a block found about a node: it ends in a local root, leaves the block, lies on a cycle, or leads to one.
ROOT, OPEN, CYCLE, TAIL = 0, 1, 2, 3
MERGED = "x long, root long, depth long, on_cycle boolean"
BLOCK_SCHEMA = "v long, p long, kind int, last long, exit long, dist long, low long, part int"


def forest(v: np.ndarray, p: np.ndarray, has: np.ndarray) -> dict[str, np.ndarray]:
    """Resolve one block. v: sorted distinct nodes; p: parents where `has`.

    Gives for each node its kind, `last` (local root, last node before the exit, or smallest of the cycle), `exit`,
    `dist` (links to the root, or to the exit) and `low`, the smallest node on the way within the block.
    """
    n = len(v)
    at = np.minimum(np.searchsorted(v, p), max(n - 1, 0))
    inside = has & (v[at] == p) if n else has
    jump = np.where(inside, at, np.arange(n))
    ends = ~inside
    dist, low = inside.astype(np.int64), v.copy()
    for _ in range(max(1, math.ceil(math.log2(max(n, 2))) + 1)):
        dist = dist + dist[jump]
        low = np.minimum(low, low[jump])
        jump = jump[jump]
    done = ends[jump]
    kind = np.where(done, np.where(has[jump], OPEN, ROOT), TAIL).astype(np.int32)
    on = np.zeros(n, bool)
    on[jump[~done]] = True
    kind[on] = CYCLE
    last = np.where(done, v[jump], low[jump])
    leaves = kind == OPEN
    return {"kind": kind, "last": last, "exit": np.where(leaves, p[jump], 0), "leaves": leaves, "dist": np.where(done, dist + leaves, 0), "low": low}


def _gathered(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    """A partition of bounded size as one table, None if it is empty."""
    kept = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(kept) if kept else None


def _block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    if (t := _gathered(batches)) is None:
        return
    v = t["v"].to_numpy()
    has = ~t["p"].is_null().to_numpy(zero_copy_only=False)
    p = t["p"].fill_null(0).to_numpy()
    order = np.argsort(v, kind="stable")
    v, p, has = v[order], p[order], has[order]
    r = forest(v, p, has)
    part = np.full(len(v), TaskContext.get().partitionId(), np.int32)
    out = [pa.array(v), pa.array(p, mask=~has), pa.array(r["kind"]), pa.array(r["last"]), pa.array(r["exit"], mask=~r["leaves"]), pa.array(r["dist"]), pa.array(r["low"]), pa.array(part)]
    yield from pa.table(out, ["v", "p", "kind", "last", "exit", "dist", "low", "part"]).to_batches(100_000)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Resolve the whole contracted graph in one block of bounded size."""
    if (t := _gathered(batches)) is None:
        return
    order = np.argsort(t["v"].to_numpy(), kind="stable")
    c = {k: t[k].fill_null(0).to_numpy()[order] for k in ("v", "kind", "last", "exit", "dist", "low")}
    v, n = c["v"], len(order)
    at = np.minimum(np.searchsorted(v, c["exit"]), n - 1)
    goes = (c["kind"] == OPEN) & (v[at] == c["exit"])
    jump = np.where(goes, at, np.arange(n))
    # A node that goes nowhere stands for its local root; one whose exit is no node ends one link before it.
    own = np.where(c["kind"] == OPEN, c["dist"] - 1, c["dist"])
    dist, low = np.where(goes, c["dist"], 0), c["low"].copy()
    for _ in range(math.ceil(math.log2(max(n, 2))) + 1):
        dist = dist + dist[jump]
        low = np.minimum(low, low[jump])
        jump = jump[jump]
    endless = goes[jump]
    on = np.zeros(n, bool)
    on[jump[endless]] = True
    cyclic = endless | (c["kind"][jump] >= CYCLE)
    root = np.where(endless, low[jump], c["last"][jump])
    depth = np.where(cyclic, TO_CYCLE, dist + own[jump])
    out = [pa.array(x) for x in (v, root, depth, on)]
    yield from pa.table(out, ["x", "root", "depth", "on_cycle"]).to_batches(100_000)


def _contract(graph: DataFrame, merge_rows: int) -> DataFrame:
    """(x, root, depth, on_cycle) of a contracted graph of any size, merged level by level until one block holds the rest."""
    ids = graph.select(F.col("v").alias("to"), F.lit(True).alias("known"))
    s = graph.withColumn("to", F.col("exit")).join(ids, "to", "left").select(
        F.col("v").alias("x"), F.when(F.col("known"), F.col("to")).alias("to"), F.when(F.col("known").isNull(), F.col("last")).alias("root"),
        F.when(F.col("kind") >= CYCLE, F.lit(TO_CYCLE)).when((F.col("kind") != OPEN) | F.col("known"), F.col("dist")).otherwise(F.col("dist") - 1).alias("depth"), "low",
    )
    s, levels = stored(s), []
    while (n := s.count()) > merge_rows and not s.where("to <> x").isEmpty():
        toss = lambda c: F.xxhash64(c, F.lit(len(levels))).bitwiseAND(F.lit(1))  # noqa: B023, E731
        t = s.select(F.col("x").alias("to"), F.col("to").alias("t_to"), F.col("root").alias("t_root"), F.col("depth").alias("t_depth"))
        going, ends = F.col("to").isNotNull(), F.col("to").isNotNull() & F.col("t_to").isNull()
        moves = going & ~ends & (F.col("to") != F.col("x")) & (toss("x") == 1) & (toss("to") == 0)
        seen = stored(s.join(t, "to", "left").select(
            "x", F.when(going & ~ends, F.col("to")).alias("to"), F.when(ends, F.col("t_root")).otherwise(F.col("root")).alias("root"),
            F.when(ends & (F.col("t_depth") < 0), F.lit(TO_CYCLE)).when(ends, F.col("depth") + F.col("t_depth")).otherwise(F.col("depth")).alias("depth"), "low", moves.alias("moves"), (~going).alias("over"),
        ))
        moved = seen.where("moves").select("x", "to", "depth", "low")
        up = moved.select(F.col("x").alias("via"), F.col("to").alias("to2"), F.col("depth").alias("depth2"), F.col("low").alias("low2"))
        s = seen.where("not moves and not over").join(up, F.col("to") == F.col("via"), "left").select("x", F.coalesce("to2", "to").alias("to"), "root", F.when(F.col("via").isNotNull(), F.col("depth") + F.col("depth2")).otherwise(F.col("depth")).alias("depth"), F.least("low", "low2").alias("low"), "via")
        s = stored(s)
        # Roots have told all that led to them; nothing leads to them any more.
        levels.append((moved, s.where("via is not null").select("x", "via"), seen.where("over").select("x", "root", "depth", F.lit(False).alias("on_cycle"))))
    ends = F.col("to").isNull()
    if n <= merge_rows:
        block = s.select(F.col("x").alias("v"), F.when(~ends, OPEN).when(F.col("depth") < 0, TAIL).otherwise(ROOT).alias("kind"), "root", F.col("to").alias("exit"), F.greatest("depth", F.lit(0)).alias("dist"), "low").withColumnRenamed("root", "last")
        found = block.repartition(1).mapInArrow(_merge, MERGED)
    else:  # roots, and cycles of which one node is left
        found = s.select("x", F.coalesce("root", "low").alias("root"), F.when(ends, F.col("depth")).otherwise(F.lit(TO_CYCLE)).alias("depth"), (~ends).alias("on_cycle"))
    found = stored(found)
    for moved, led, over in reversed(levels):
        found = found.unionByName(over)
        # A hung tree lies on a cycle if one that led through it does.
        on = led.join(found.where("on_cycle").select("x"), "x", "left_semi").select(F.col("via").alias("x"), F.lit(True).alias("on_cycle")).distinct()
        above = found.select(F.col("x").alias("to"), "root", F.col("depth").alias("above"))
        hung = moved.join(above, "to").select("x", "root", F.when(F.col("above") < 0, F.lit(TO_CYCLE)).otherwise(F.col("depth") + F.col("above")).alias("depth"))
        found = found.unionByName(stored(hung.join(on, "x", "left").withColumn("on_cycle", F.coalesce("on_cycle", F.lit(False)))))
    return found


def _further(graph: DataFrame, nodes: int) -> DataFrame:
    """(x, path) of a contracted graph without cycles: each node's pieces of path along the exits, joined two at a time."""
    ids = graph.select(F.col("v").alias("to"), F.lit(True).alias("known"))
    s = cut(graph.withColumn("to", F.col("exit")).join(ids, "to", "left").select(F.col("v").alias("x"), F.when(F.col("known"), F.col("to")).alias("to"), "path"))
    for _ in range(math.ceil(math.log2(max(nodes, 2))) + 1):
        if s.where("to is not null").isEmpty():
            break
        b = s.select(F.col("x").alias("to"), F.col("to").alias("to2"), F.col("path").alias("path2"))
        s = cut(s.join(b, "to", "left").select("x", F.col("to2").alias("to"), F.when(F.col("to").isNotNull(), F.concat("path", "path2")).otherwise(F.col("path")).alias("path")))
    return s.select("x", "path")


def link_blocks(links: DataFrame, node: str, parent: str, locality: str | None = None, block_rows: int = 250_000) -> DataFrame:
    """The first level: every node with what its block found (BLOCK_SCHEMA), cut from its lineage."""
    spark = links.sparkSession
    loc = F.col(locality) if locality else F.lit(0)
    one = links.select(F.col(node).cast("long").alias("v"), F.col(parent).cast("long").alias("p"), loc.alias("loc")).where("v is not null").groupBy("v").agg(F.min("p").alias("p"), F.min("loc").alias("loc"))
    n = blocks(spark, links.count(), block_rows)
    return cut(one.repartitionByRange(n, "loc", "v").select("v", "p").mapInArrow(_block, BLOCK_SCHEMA))


def _walk(pdf):  # noqa: ANN001, ANN202
    """Nodes on the pieces of a cycle that lie in one block: the ways from its entries out of the block."""
    nxt = dict(zip(pdf["v"], pdf["p"]))
    on = []
    for v in pdf.loc[pdf["entry"], "v"]:
        while v in nxt:
            on.append(v)
            v = nxt.pop(v)
    return pdf.iloc[: len(on)][["v"]].assign(v=on)


def _cycle_members(level: DataFrame, exits: DataFrame) -> DataFrame:
    """Nodes on cycles that pass through several blocks, found from the entries on such a cycle."""
    entries = exits.where("on_cycle").select(F.col("x").alias("v"), F.lit(True).alias("entry"))
    at = cut(level.join(entries, "v").select("v", "part", "exit", "entry"))
    if at.isEmpty():
        return level.select("v").limit(0)
    lead = level.where(F.col("kind") == OPEN).join(at.select("part", "exit").distinct(), ["part", "exit"], "left_semi").join(entries, "v", "left")
    return lead.select("part", "v", "p", F.coalesce("entry", F.lit(False)).alias("entry")).groupBy("part").applyInPandas(lambda pdf: _walk(pdf), "v long")


def resolve_hierarchy(links: DataFrame, node: str, parent: str, locality: str | None = None, block_rows: int = 250_000, merge_rows: int = 250_000, level: DataFrame | None = None) -> DataFrame:
    """(node, root, depth) of every node; see the module's docstring. merge_rows bounds the block of the last merge like block_rows those of the first."""
    level = level if level is not None else link_blocks(links, node, parent, locality, block_rows)
    leaves = level.where(F.col("kind") == OPEN)
    graph = cut(level.join(leaves.select(F.col("exit").alias("v")).distinct(), "v", "left_semi").select("v", "kind", "last", "exit", "dist", "low"))
    nodes = graph.count()
    exits = cut(graph.repartition(1).mapInArrow(_merge, MERGED) if nodes <= merge_rows else _contract(graph, merge_rows))
    found = leaves.join(small(exits.withColumnRenamed("x", "exit"), nodes), "exit", "left").select(
        "v", F.coalesce("root", "last").alias("root"),
        F.when(F.col("root").isNull(), F.col("dist") - 1).when(F.col("depth") < 0, F.lit(TO_CYCLE)).otherwise(F.col("dist") + F.col("depth")).alias("depth"),
    )
    if not exits.where("on_cycle").isEmpty():
        on = _cycle_members(level, exits).withColumn("on", F.lit(True))
        found = found.join(on, "v", "left").select("v", "root", F.when(F.col("on"), F.lit(ON_CYCLE)).otherwise(F.col("depth")).alias("depth"))
    local = level.where(F.col("kind") != OPEN).select("v", F.col("last").alias("root"), F.when(F.col("kind") == CYCLE, F.lit(ON_CYCLE)).when(F.col("kind") == TAIL, F.lit(TO_CYCLE)).otherwise(F.col("dist")).alias("depth"))
    return local.unionByName(found).withColumnRenamed("v", node)


def _local_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(v, exit, kind, path): ways of a block's nodes through its indexed parents, without the exit; null where they never end."""
    if (t := _gathered(batches)) is None:
        return
    order = np.argsort(t["v"].to_numpy(), kind="stable")
    t = t.take(pa.array(order))
    v = t["v"].to_numpy()
    at = np.minimum(np.searchsorted(v, p := t["p"].fill_null(0).to_numpy()), len(v) - 1)
    kind, exits = t["kind"].to_numpy(), t["exit"].combine_chunks()
    ends = t["p"].is_null().to_numpy(zero_copy_only=False) | (v[at] != p)
    length = np.where(kind <= OPEN, t["dist"].to_numpy() + (kind == ROOT), 0)
    for a in range(0, len(v), 20_000):
        b = slice(a, min(a + 20_000, len(v)))
        offsets = np.concatenate([[0], np.cumsum(length[b])])
        values, cur, live, step = np.empty(offsets[-1], np.int64), np.arange(len(v))[b], kind[b] <= OPEN, 0
        while live.any():
            values[offsets[:-1][live] + step] = v[cur[live]]
            live = live & ~ends[cur]
            cur, step = np.where(live, at[cur], cur), step + 1
        lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values), mask=pa.array(kind[b] > OPEN))
        yield pa.RecordBatch.from_arrays([pa.array(v[b]), exits[b], pa.array(kind[b]), lists], ["v", "exit", "kind", "path"])


def _endless(level: DataFrame) -> DataFrame:
    """(v, cycle, code) of the nodes whose way never ends: the smallest node of their cycle, and ON_CYCLE or TO_CYCLE."""
    return cut(resolve_hierarchy(level, "v", "p", level=level).where("depth < 0").select("v", F.col("root").alias("cycle"), F.col("depth").alias("code")))


def _whole_paths(level: DataFrame, endless: DataFrame | None = None) -> DataFrame:
    """(v, path) of every node; the paths of endless nodes, if there are any, mean nothing."""
    # The checkpoint keeps the blocks' partitions, so every partition again holds exactly one block.
    paths = level.select("v", "p", "kind", "dist", "exit").mapInArrow(_local_paths, "v long, exit long, kind int, path array<long>")
    leaves = level.where(F.col("kind") == OPEN)
    wanted = level.join(leaves.select(F.col("exit").alias("v")).distinct(), "v", "left_semi").select("v", "kind", "last", "exit", "dist", "low")
    # Nodes whose way never ends have no path, and joining theirs would never end either.
    wanted = wanted.join(endless, "v", "left_anti") if endless is not None else wanted
    graph = cut(wanted.join(paths.select("v", "path"), "v"))
    further = _further(graph, graph.count()).select(F.col("x").alias("exit"), F.col("path").alias("more"))
    longer = F.when(F.col("more").isNotNull(), F.concat("path", "more")).otherwise(F.col("path"))
    return stored(paths.where(F.col("kind") != OPEN).select("v", "path").unionByName(paths.where(F.col("kind") == OPEN).join(further, "exit", "left").select("v", longer.alias("path"))))


def _below(level: DataFrame, endless: DataFrame, n: int, whole: DataFrame, block_rows: int) -> DataFrame:
    """(a, v): every node a with each other node v whose way leads through it, once; n: number of endless nodes."""
    above = lambda paths: paths.select(F.explode(F.slice("path", 2, 2_000_000_000)).alias("a"), "v")
    if not n:
        return above(whole)
    # Without the links of the cycles' members every way ends at the member where it enters its cycle.
    known = level.select("v", "p").join(small(endless, n), "v")
    entering = _whole_paths(link_blocks(known.select("v", F.when(F.col("code") != ON_CYCLE, F.col("p")).alias("p")), "v", "p", block_rows=block_rows))
    members = endless.where(F.col("code") == ON_CYCLE).select("cycle", F.col("v").alias("a"))
    around = entering.join(small(endless, n), "v").select("v", "cycle", F.element_at("path", -1).alias("entry"))
    round_cycle = around.join(members, "cycle").where(F.col("a") != F.col("entry")).select("a", "v")
    return above(whole.join(small(endless, n), "v", "left_anti")).unionByName(above(entering)).unionByName(round_cycle)


def hierarchy_paths(links: DataFrame, node: str, parent: str, locality: str | None = None, block_rows: int = 250_000) -> DataFrame:
    """(node, root, depth, path, descendants): path from the node to its root as an array, null on or towards a cycle.

    Descendants counts the other nodes whose way leads through the node, also on and towards cycles, as `descendants` lists them.
    """
    level = link_blocks(links, node, parent, locality, block_rows)
    endless = _endless(level)
    n = endless.count()
    paths = _whole_paths(level, endless)
    whole = paths.join(small(endless, n), "v", "left").select("v", F.when(F.col("code").isNull(), F.col("path")).alias("path"), "cycle", "code")
    below = _below(level, endless, n, paths, block_rows).groupBy(F.col("a").alias("v")).agg(F.count("*").alias("descendants"))
    out = whole.join(below, "v", "left")
    return out.select(F.col("v").alias(node), F.coalesce("cycle", F.element_at("path", -1)).alias("root"), F.coalesce("code", (F.size("path") - 1).cast("long")).alias("depth"), "path", F.coalesce("descendants", F.lit(0)).alias("descendants"))


def descendants(links: DataFrame, node: str, parent: str, locality: str | None = None, block_rows: int = 250_000) -> DataFrame:
    """(node, descendant): every node with each other node whose way leads through it, once.

    On and towards a cycle, too: a way to a cycle passes all its members, and each member is a descendant of every other.
    """
    level = link_blocks(links, node, parent, locality, block_rows)
    endless = _endless(level)
    return _below(level, endless, endless.count(), _whole_paths(level, endless), block_rows).select(F.col("a").alias(node), F.col("v").alias("descendant"))
