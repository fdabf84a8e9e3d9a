"""Graph operators beyond hierarchies: connected components, chain heads and positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.hierarchy import resolve_hierarchy
from chronoloom.session import cut


def components(edges: DataFrame, left: str, right: str, max_rounds: int = 60) -> DataFrame:
    """(node, component): each node's smallest reachable node, found by hooking to smaller neighbours and pointer jumping.

    Edges are undirected. Every round replaces each edge by one between its ends' labels and drops those that have
    become loops, so the edges shrink geometrically; labels are followed to their roots as a forest. Rows with a null
    end, repeated rows and loops add nothing but, for loops, the node. Exact at any size and depth.
    """
    pairs = edges.where(F.col(left).isNotNull() & F.col(right).isNotNull()).select(F.col(left).cast("long").alias("a"), F.col(right).cast("long").alias("b"))
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    label = cut(nodes.select("node", F.col("node").alias("component")))
    live = cut(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(max_rounds):
        if live.isEmpty():
            return label
        # Every node hooks to its smallest neighbour if that is smaller: a forest, whose roots are the new labels.
        hooks = live.groupBy("a").agg(F.min("b").alias("b"))
        forest = hooks.unionByName(live.select(F.col("b").alias("a"), F.lit(None).cast("long").alias("b")).distinct())
        roots = cut(resolve_hierarchy(forest.groupBy("a").agg(F.min("b").alias("b")), "a", "b").select(F.col("a").alias("n"), "root"))
        label = cut(label.join(roots, label.component == roots.n, "left").select("node", F.coalesce("root", "component").alias("component")))
        ends = live.join(roots.select(F.col("n").alias("a"), F.col("root").alias("ra")), "a").join(roots.select(F.col("n").alias("b"), F.col("root").alias("rb")), "b")
        live = cut(ends.where("ra <> rb").select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct())
    raise RuntimeError(f"components are not stable after {max_rounds} rounds")


def chains(links: DataFrame, node: str, following: str) -> DataFrame:
    """(node, head, position): places in chains of one-to-one links, counted from 1 at the head.

    A link whose target several nodes name is kept for the smallest of them alone; nodes on cycles have no place.
    """
    one = links.where(F.col(node).isNotNull()).groupBy(F.col(node).alias("node")).agg(F.min(following).alias("next"))
    taken = one.where("next is not null").groupBy("next").agg(F.min("node").alias("before")).where("next <> before")  # combines before the shuffle, however many name one target
    back = one.select("node").join(taken.withColumnRenamed("next", "node"), "node", "left")
    places = resolve_hierarchy(back, "node", "before")
    return places.where("depth >= 0").select(F.col("node").alias(node), F.col("root").alias("head"), (F.col("depth") + 1).alias("position"))


def edges_both_ways(links: DataFrame, node: str, following: str) -> DataFrame:
    """(node, relation, other): every link as NEXT and, from its target, as PREVIOUS; repeated links count once."""
    one = links.where(F.col(node).isNotNull() & F.col(following).isNotNull()).select(F.col(node).alias("a"), F.col(following).alias("b")).distinct()
    ways = F.array(F.struct(F.col("a").alias("node"), F.lit("NEXT").alias("relation"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.lit("PREVIOUS").alias("relation"), F.col("a").alias("other")))
    return one.select(F.explode(ways).alias("e")).select("e.*")


def cycles(links: DataFrame, node: str, following: str, within: list[str]) -> DataFrame:
    """(within..., node, cycle): nodes on cycles of links that stay within a group, with the smallest node of their cycle.

    within: columns that both ends of a link must share, null never shared; a node that names itself is a cycle of one.
    """
    at = links.where(F.col(node).isNotNull()).groupBy(node).agg(*[F.min(c).alias(c) for c in (following, *within)])
    target = at.select(F.col(node).alias("_t"), *[F.col(c).alias(f"_{c}") for c in within])
    shared = at.join(target, F.col(following) == F.col("_t"))
    for c in within:
        shared = shared.where(F.col(c) == F.col(f"_{c}"))
    kept = cut(shared.select(F.col(node).alias("n"), F.col(following).alias("to")))
    found = resolve_hierarchy(kept, "n", "to").where("depth = -1").select(F.col("n").alias(node), F.col("root").alias("cycle"))
    return found.join(at.select(node, *within), node).select(*within, node, "cycle")
