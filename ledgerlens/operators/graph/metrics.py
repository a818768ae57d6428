"""Group sizes, the per-node metric table and joining metrics back to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerlens.functions.scalar import affix_columns
from ledgerlens.session import cut_lineage

METRIC_COLUMNS = ["degree", "pagerank", "hits_auth", "hits_hub", "betweenness", "wcc_size",
                  "community_size"]
#: Metrics of so many nodes are sent to every executor.
BROADCAST_NODES = 200_000


def group_size(assign: DataFrame, group_col: str, out_col: str = "size") -> DataFrame:
    """Members per group (one row per group)."""
    return assign.groupBy(group_col).agg(F.count(F.lit(1)).cast("bigint").alias(out_col))


def join_group_size(assign: DataFrame, group_col: str, out_col: str = "size") -> DataFrame:
    """Attach the size of its group to each member (aggregate + join; no group is collected)."""
    return assign.join(group_size(assign, group_col, out_col), group_col).drop(group_col)


def node_metrics(graph, *, include_betweenness: bool = True, include_louvain: bool = True,
                 pagerank_iter: int = 20, hits_iter: int = 20, betweenness_kwargs: dict | None = None,
                 louvain_kwargs: dict | None = None) -> DataFrame:
    """One row per node: degree, pagerank, hits_auth, hits_hub, betweenness, wcc_size, community_size.

    The graph is written once and read by every metric; PageRank and HITS share its packed edges. Where classes of
    nodes with the same neighbours are known, a class is one node of it."""
    from ledgerlens.operators.graph.betweenness import betweenness
    from ledgerlens.operators.graph.build import Graph
    from ledgerlens.operators.graph.components import connected_components
    from ledgerlens.operators.graph.degree import degree
    from ledgerlens.operators.graph.hits import hits
    from ledgerlens.operators.graph.matrix import Matrix
    from ledgerlens.operators.graph.pagerank import pagerank

    given, classes = graph, graph.classes
    if graph.directed or set(betweenness_kwargs or {}) & {"sample", "max_depth"}:
        classes = None
    nodes, edges = classes.quotient() if classes else (graph.nodes, graph.edges)
    graph = Graph(cut_lineage(nodes), cut_lineage(edges), graph.directed)
    out = degree(graph)
    matrix = Matrix(graph, written=True)
    out = out.join(pagerank(graph, max_iter=pagerank_iter, matrix=matrix), "id")
    out = out.join(hits(graph, iterations=hits_iter, matrix=matrix), "id")
    matrix.unpersist()
    components = cut_lineage(connected_components(graph))
    if include_betweenness:
        out = out.join(betweenness(graph, components=components, **(betweenness_kwargs or {})), "id")
    if classes:
        members = classes.members.withColumnRenamed("rep", "_rep")
        out = members.join(out.withColumnRenamed("id", "_rep"), "_rep").drop("_rep")
        components = members.join(components.withColumnRenamed("id", "_rep"), "_rep").drop("_rep")
    out = out.join(join_group_size(components, "component", "wcc_size"), "id")
    if include_louvain:
        from ledgerlens.operators.graph.louvain import louvain
        out = out.join(join_group_size(louvain(given if classes else graph, **(louvain_kwargs or {})), "community",
                                       "community_size"), "id")
    return out


def join_mono_metrics(rows: DataFrame, metrics: DataFrame, key: str = "start_node_id") -> DataFrame:
    """Left join account metrics of the projected graph (the node id stays as ``id``)."""
    return rows.join(metrics, rows[key] == metrics["id"], "left")


def join_bipartite_metrics(rows: DataFrame, metrics: DataFrame, nodes: DataFrame,
                           account_key: str = "start_node_id", device_key: str = "end_node_id") -> DataFrame:
    """Left join account metrics as ``acc_*`` and device metrics as ``dev_*``; the ids are dropped."""
    labelled = cut_lineage(metrics.join(nodes.select("id", "label"), "id"))  # read twice
    acc = affix_columns(labelled.where(F.col("label") == "account").drop("label"), prefix="acc_")
    dev = affix_columns(labelled.where(F.col("label") == "device").drop("label"), prefix="dev_")
    out = rows.join(acc, rows[account_key] == acc["acc_id"], "left")
    out = out.join(dev, out[device_key] == dev["dev_id"], "left")
    return out.drop("acc_id", "dev_id")


def join_edge_metrics(edges: DataFrame, metrics: DataFrame, from_key: str = "txId_from",
                      to_key: str = "txId_to") -> DataFrame:
    """Left join metrics of both endpoints with ``_from`` / ``_to`` suffixes. The metrics are written once; those of up to
    ``BROADCAST_NODES`` nodes go to the edges, which then stay where they lie."""
    metrics = cut_lineage(metrics)
    mf = affix_columns(metrics, suffix="_from")
    mt = affix_columns(metrics, suffix="_to")
    if metrics.count() <= BROADCAST_NODES:
        mf, mt = F.broadcast(mf), F.broadcast(mt)
    out = edges.join(mf, edges[from_key] == mf["id_from"], "left")
    return out.join(mt, out[to_key] == mt["id_to"], "left")


def drop_signatures(df: DataFrame, cols: list[str], enabled: bool = True) -> DataFrame:
    return df.drop(*cols) if enabled else df
