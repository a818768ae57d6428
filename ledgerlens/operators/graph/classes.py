"""Classes of nodes that have the same neighbours in a one-mode projection.

Accounts with the same devices, each as often, are joined with each other and with the same other accounts by edges
of the same strength. Their projected edges are all pairs of them; the pairs of the classes say the same. Degree,
PageRank, HITS, components and betweenness are equal for all members of a class, and are computed on one node a class
that counts as often as it has members:

* an edge ``src -> dst`` between classes stands for ``m`` edges into each member of ``dst``: the members of ``src``, without
  the member itself where ``src = dst`` (one row for each class of two or more);
* shortest paths never lead through a member of the class of either end, so that betweenness needs the edges between
  different classes only, each as ``m`` parallel ones.

Louvain: let two nodes u, v with the same neighbours be joined by an edge of weight ``w`` and be in different communities.
If each moved to the other, the two rises of ``2m * modularity`` would add up to ``4 * (w - k^2 / 2m)``; with ``w > k^2 / 2m`` one of
them is a rise, so in every partition that no move of a node improves they lie together, and may start so. The (at
most ``sqrt(2m / w)`` many) nodes of the other classes start alone.

Classes are found by two 64-bit hashes of the devices and then compared device by device; an account that only
shares the hashes is a class of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ledgerlens.session import cut_lineage


@dataclass
class Classes:
    members: DataFrame   # id, rep: the smallest member of the node's class
    edges: DataFrame     # src, dst, weight: joined classes in both directions, by rep; src = dst: the members are joined
    sizes: DataFrame     # rep, n

    def weighted(self, weight_col: str | None) -> Classes:
        """Undirected, with the strength or 1.0 as weight."""
        w = F.col(weight_col).cast("double") if weight_col else F.lit(1.0)
        one = self.edges.select("src", "dst", w.alias("weight"))
        back = one.where(F.col("src") != F.col("dst")).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
        return Classes(self.members, one.unionByName(back), self.sizes)

    def quotient(self) -> tuple[DataFrame, DataFrame]:
        """Nodes ``(id, n)`` and edges ``(src, dst, weight, m)``."""
        sizes = self.sizes.select(F.col("rep").alias("src"), "n")
        m = F.when(F.col("src") == F.col("dst"), F.col("n") - 1).otherwise(F.col("n")).cast("double")
        return (self.sizes.select(F.col("rep").alias("id"), F.col("n").cast("double").alias("n")),
                self.edges.join(sizes, "src").select("src", "dst", "weight", m.alias("m")))

    def units(self) -> tuple[DataFrame, DataFrame]:
        """``(id, unit)`` and the weights ``(src, dst, w)`` between units: classes that lie in one community in every
        local optimum of the modularity are one unit, other nodes are units of their own."""
        nodes, edges = self.quotient()
        k = edges.groupBy(F.col("dst").alias("id")).agg(
            F.sum(F.col("m") * F.col("weight")).alias("k"),
            F.max(F.when(F.col("src") == F.col("dst"), F.col("weight"))).alias("own"))
        k = cut_lineage(nodes.join(k, "id"))
        m2 = k.agg(F.sum(F.col("n") * F.col("k"))).first()[0] or 0.0
        whole = k.where(F.col("own") * F.lit(m2) > F.col("k") * F.col("k")).select(F.col("id").alias("rep"), F.lit(True).alias("_w"))
        units = cut_lineage(self.members.join(whole, "rep", "left")
                                .select("id", "rep", F.when(F.col("_w"), F.col("rep")).otherwise(F.col("id")).alias("unit")))
        own = units.groupBy("rep", "unit").agg(F.count(F.lit(1)).cast("double").alias("n"))
        a = own.select(F.col("rep").alias("src"), F.col("unit").alias("u"), F.col("n").alias("nu"))
        b = own.select(F.col("rep").alias("dst"), F.col("unit").alias("v"), F.col("n").alias("nv"))
        ways = F.col("nu") * F.when(F.col("u") == F.col("v"), F.col("nv") - 1).otherwise(F.col("nv"))
        adj = self.edges.join(a, "src").join(b, "dst").select(
            F.col("u").alias("src"), F.col("v").alias("dst"), (F.col("weight") * ways).alias("w")).where("w != 0")
        return units.select("id", "unit"), adj


def projection_classes(nodes: DataFrame, rows: DataFrame, account: str, device: str) -> Classes | None:
    """Classes of the ``nodes`` in the projection of ``rows``; None where node ids are null or repeat, or accounts are
    no nodes."""
    from ledgerlens.operators.graph.project import pivot_sum, projected_pairs

    cells = cut_lineage(pivot_sum(rows, account, device))
    marks = [F.bit_xor(F.xxhash64("device", "exist", F.lit(salt))).alias(f"h{salt}") for salt in (1, 2)]
    own = cut_lineage(cells.groupBy("account").agg(F.count(F.lit(1)).alias("k"), *marks))
    ids = nodes.select("id").groupBy("id").agg(F.count(F.lit(1)).alias("_n"))
    if not ids.where(F.col("id").isNull() | (F.col("_n") > 1)).isEmpty():
        return None
    if not own.join(ids.select(F.col("id").alias("account")), "account", "left_anti").isEmpty():
        return None
    first = own.groupBy("k", "h1", "h2").agg(F.min("account").alias("rep"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    alike = cut_lineage(own.join(first, ["k", "h1", "h2"]).where(F.col("account") != F.col("rep")).select("account", "rep", "k"))
    found = (cells.join(alike, "account")
                  .join(cells.select(F.col("account").alias("rep"), "device", "exist"), ["rep", "device", "exist"])
                  .groupBy("account", "rep", "k").agg(F.count(F.lit(1)).alias("_same"))
                  .where(F.col("_same") == F.col("k")).select(F.col("account").alias("id"), "rep"))
    members = cut_lineage(nodes.select("id").join(found, "id", "left").select("id", F.coalesce("rep", "id").alias("rep")))
    sizes = cut_lineage(members.groupBy("rep").agg(F.count(F.lit(1)).alias("n")))
    kept = cut_lineage(cells.join(sizes.select(F.col("rep").alias("account"), "n"), "account"))
    inside = (kept.where("n > 1").groupBy("account").agg(F.sum(F.col("exist") * F.col("exist")).cast("bigint").alias("strength"))
                  .select(F.col("account").alias("src"), F.col("account").alias("dst"), "strength"))
    pairs = projected_pairs(kept.drop("n")).select(F.col("start").alias("src"), F.col("end").alias("dst"), "strength")
    return Classes(members, cut_lineage(pairs.unionByName(inside)), sizes)
