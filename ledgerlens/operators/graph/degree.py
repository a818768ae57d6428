"""Degree: relationships leaving each node of the adjacency (undirected = all)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators.graph.build import Graph


def degree(graph: Graph, out_col: str = "degree"):
    if "m" in graph.edges.columns:  # edges between classes: ``m`` of them reach each member
        counts = graph.edges.groupBy(F.col("dst").alias("id")).agg(F.sum("m").alias("_d"))
    else:
        counts = graph.edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("_d"))
    return (graph.nodes.select("id").join(counts, "id", "left")
                 .select("id", F.coalesce(F.col("_d"), F.lit(0)).cast("double").alias(out_col)))
