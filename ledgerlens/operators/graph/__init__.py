"""Graphs as DataFrames: ``Graph(nodes(id, label), edges(src, dst, ...), directed)``.

An undirected graph stores both directions of every relationship in ``edges``
(the adjacency), so every algorithm walks ``src -> dst`` only.
"""

from ledgerlens.operators.graph.build import (  # noqa: F401
    Graph, entity_signature, bipartite_graph, graph_projection, mono_graph, distinct_nodes,
    filter_by_node_kind,
)
