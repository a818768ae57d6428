"""Build account/device graphs from transaction rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ledgerlens.functions.scalar import node_id
from ledgerlens.operators.graph.classes import Classes, projection_classes
from ledgerlens.operators.numbering import group_number


@dataclass
class Graph:
    nodes: DataFrame          # id, label
    edges: DataFrame          # src, dst, type, [weight, ...]; both directions when undirected
    directed: bool = True
    classes: Classes | None = None   # classes of nodes with the same neighbours, if known


def entity_signature(df: DataFrame, account_cols: list[str], device_cols: list[str],
                     account_out: str = "start_node_id", device_out: str = "end_node_id",
                     account_prefix: str = "a", device_prefix: str = "v") -> DataFrame:
    """Number distinct account / device key tuples in sorted order -> ``a{n}`` / ``v{n}``.

    A null in any key column gives a null id (row kept, no edge later).
    """
    out = group_number(df, account_cols, "_acc_n")
    out = group_number(out, device_cols, "_dev_n")
    return (out.withColumn(account_out, node_id(account_prefix, "_acc_n"))
               .withColumn(device_out, node_id(device_prefix, "_dev_n"))
               .drop("_acc_n", "_dev_n"))


def distinct_nodes(df: DataFrame, col: str, label: str, id_col: str = "id") -> DataFrame:
    return (df.where(F.col(col).isNotNull()).select(F.col(col).alias(id_col)).distinct()
              .withColumn("label", F.lit(label)))


def bipartite_graph(df: DataFrame, src: str = "start_node_id", dst: str = "end_node_id",
                    src_label: str = "account", dst_label: str = "device",
                    rel_type: str = "transaction", props: list[str] | None = None) -> Graph:
    """Account and device nodes plus one ``transaction`` edge per row (a multigraph)."""
    keep = [c for c in (props if props is not None else df.columns) if c not in (src, dst)]
    nodes = distinct_nodes(df, src, src_label).unionByName(distinct_nodes(df, dst, dst_label))
    edges = (df.where(F.col(src).isNotNull() & F.col(dst).isNotNull())
               .select(F.col(src).alias("src"), F.col(dst).alias("dst"),
                       F.lit(rel_type).alias("type"), *keep))
    return Graph(nodes, edges, directed=True)


def graph_projection(graph: Graph, node_labels: list[str] | None = None,
                     rel_types: list[str] | None = None, orientation: str = "natural",
                     weight_col: str | None = None) -> Graph:
    """Choose node labels, relationship types and orientation (natural / reverse / undirected).

    Parallel edges are kept. Undirected = both directions of every edge, from one read of the edges.
    """
    nodes = graph.nodes
    if node_labels is not None:
        nodes = nodes.where(F.col("label").isin(node_labels))
    edges = graph.edges
    if rel_types is not None and "type" in edges.columns:
        edges = edges.where(F.col("type").isin(rel_types))
    if node_labels is not None:
        ids = nodes.select(F.col("id"))
        edges = (edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
                      .join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi"))
    w = F.col(weight_col).cast("double") if weight_col else F.lit(1.0)
    base = edges.select("src", "dst", w.alias("weight"))
    orientation = orientation.lower()
    if orientation == "natural":
        adj, directed = base, True
    elif orientation == "reverse":
        adj, directed = base.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"), True
    elif orientation == "undirected":
        ways = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
        adj = base.select("weight", F.explode(ways).alias("_e")).select("_e.src", "_e.dst", "weight")
        directed = False
    else:
        raise ValueError(f"unknown orientation {orientation!r}")
    # Members of a class differ where an edge has a direction or nodes or edges are left out.
    classes = graph.classes if not directed and node_labels is None and rel_types is None else None
    return Graph(nodes.select("id", "label"), adj, directed, classes and classes.weighted(weight_col))


def filter_by_node_kind(nodes: DataFrame, label: str) -> DataFrame:
    return nodes.where(F.col("label") == label)


def mono_graph(accounts: DataFrame, projection: DataFrame, account_col: str = "start_node_id",
               label: str = "account", rel_type: str = "transaction", device_col: str | None = None) -> Graph:
    """All accounts (isolated ones included) plus projected ``(start, end, strength)`` edges.

    With the ``device_col`` that the projection went over, accounts that share all their devices become known as
    classes, so that metrics need not go through all pairs of accounts (``classes``)."""
    nodes = distinct_nodes(accounts, account_col, label)
    edges = projection.select(F.col("start").alias("src"), F.col("end").alias("dst"),
                              F.lit(rel_type).alias("type"), "strength")
    classes = projection_classes(nodes, accounts, account_col, device_col) if device_col else None
    return Graph(nodes, edges, directed=True, classes=classes)
