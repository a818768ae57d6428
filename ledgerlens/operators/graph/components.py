"""Weakly connected components by alternating large-star / small-star contraction
(Kiveris et al., "Connected Components in MapReduce and Beyond", 2014).

Edges are kept as ``(child, parent)`` with ``parent < child``. Rounds are O(log^2 n) at most. The
loop ends only when the edges are depth-1 stars: no node is both child and parent, and every child
has one parent. Running out of rounds raises. The component id of a node is the smallest node id in
it; isolated nodes are their own component.

Neighbour minima are aggregated before they are shuffled. They go back to the edges by a join on
the node, where a hub (the centre of a star, say) would be one key with most of the rows: hubs are
found by the neighbour counts of the same aggregate, and their edges take the minimum from a
broadcast of bounded size instead of being shuffled (``iterate.join_split``).
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from ledgerlens.operators.graph.build import Graph
from ledgerlens.operators.graph.iterate import hub_cutoff, join_split, partitions
from ledgerlens.session import cut_lineage


EDGES_PER_PARTITION = 200_000


def _minima(rows: DataFrame, key: str, value: str, cutoff: int):
    """``(key, m)`` with the smallest ``value`` of each key, cached, and the hubs among the keys (or None)."""
    m = (rows.groupBy(key).agg(F.min(value).alias("m"), F.count(F.lit(1)).alias("n"))
             .persist(StorageLevel.MEMORY_AND_DISK))
    hubs = m.where(F.col("n") > cutoff).select(key)
    return m, m.select(key, "m"), None if hubs.isEmpty() else hubs


def _large_star(e: DataFrame, cutoff: int):
    both = e.select(F.col("child").alias("u"), F.col("parent").alias("v")).unionByName(
        e.select(F.col("parent").alias("u"), F.col("child").alias("v")))
    held, m, hubs = _minima(both, "u", "v", cutoff)
    m = m.select("u", F.least("m", "u").alias("m"))
    up = join_split(both.where(F.col("v") > F.col("u")), m, hubs, "u")
    return up.select(F.col("v").alias("child"), F.col("m").alias("parent")).distinct(), held


def _small_star(e: DataFrame, cutoff: int):
    held, m, hubs = _minima(e, "child", "parent", cutoff)
    j = join_split(e, m, hubs, "child")
    moved = j.where(F.col("parent") != F.col("m")).select(
        F.col("parent").alias("child"), F.col("m").alias("parent"))
    return moved.unionByName(j.select("child", F.col("m").alias("parent"))).distinct(), held


def _is_stars(e: DataFrame) -> bool:
    ends = e.select(F.col("child").alias("id"), F.lit(1).alias("c"), F.lit(0).alias("p")).unionByName(
        e.select(F.col("parent").alias("id"), F.lit(0).alias("c"), F.lit(1).alias("p")))
    open_ = ends.groupBy("id").agg(F.sum("c").alias("c"), F.max("p").alias("p"))
    return open_.where("c > 1 or (c = 1 and p = 1)").isEmpty()


def star_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``(id, component)`` of every node of the undirected edges ``(src, dst)`` that is not the
    smallest of its component; the smallest nodes and isolated nodes have no row."""
    e = cut_lineage(
        edges.where(F.col("src") != F.col("dst"))
             .select(F.greatest("src", "dst").alias("child"), F.least("src", "dst").alias("parent"))
             .distinct())
    # A round never adds edges: partitions for the first count are enough for all.
    count = e.count()
    parts, rounds = count // EDGES_PER_PARTITION + 1, 0
    cutoff = hub_cutoff(count, partitions(e))
    while not _is_stars(e):
        if rounds == max_rounds:
            raise RuntimeError(f"components not complete after {max_rounds} rounds")
        large, held = _large_star(e, cutoff)
        large = cut_lineage(large.coalesce(parts))
        held.unpersist()
        small, held = _small_star(large, cutoff)
        e = cut_lineage(small.coalesce(parts))
        held.unpersist()
        rounds += 1
    return e.select(F.col("child").alias("id"), F.col("parent").alias("component"))


def connected_components(graph: Graph, out_col: str = "component", max_rounds: int = 100) -> DataFrame:
    e = star_components(graph.edges.select("src", "dst"), max_rounds)
    return (graph.nodes.select("id").join(e, "id", "left")
                 .select("id", F.coalesce(F.col("component"), F.col("id")).alias(out_col)))
