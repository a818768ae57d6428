"""Hubs: edges of a node with a large share of all rows are dealt out, results stay the same."""

import numpy as np
from pyspark.sql import functions as F
import pytest

from ledgerlens.operators.graph import iterate
from ledgerlens.operators.graph.build import Graph, graph_projection
from ledgerlens.operators.graph.components import connected_components
from ledgerlens.operators.graph.hits import hits
from ledgerlens.operators.graph.pagerank import pagerank


def _star(spark, leaves):
    """Undirected star with centre 0, as a directed graph from the centre and back."""
    out = spark.range(1, leaves + 1).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    return Graph(spark.range(leaves + 1).withColumn("label", F.lit("n")),
                 out.unionByName(out.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))


def _rows_by_partition(df):
    return [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]


@pytest.mark.parametrize("key", ["src", "dst"])
def test_a_star_of_a_million_leaves_is_dealt_evenly(spark, key):
    g = _star(spark, 1_000_000)
    lay = iterate.EdgeLayout(g.edges, key, 8)
    try:
        assert [r[0] for r in lay.hubs.collect()] == [0]
        for part in (lay.heavy, lay.light):
            sizes = _rows_by_partition(part)
            assert len(sizes) == 8 and sum(sizes) == 1_000_000 and max(sizes) <= 2 * np.median(sizes)
        joined = lay.join(g.nodes.select(F.col("id").alias(key), (F.col("id") * 2).alias("v")))
        assert joined.agg(F.count(F.lit(1)), F.sum("v")).first()[:] == (2_000_000, 1_000_000 * 1_000_001)
        # the hub's side of the join is broadcast: its edges move no more
        assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        lay.unpersist()


def test_components_and_ranks_of_a_large_star(spark):
    g = _star(spark, 50_000)
    comp = connected_components(g)
    assert comp.agg(F.count(F.lit(1)), F.max("component")).first()[:] == (50_001, 0)
    ranks = pagerank(g, max_iter=3)
    top = {r["id"]: r["pagerank"] for r in ranks.where("id < 2").collect()}
    hub = leaf = 0.15
    for _ in range(3):
        hub, leaf = 0.15 + 0.85 * 50_000 * leaf, 0.15 + 0.85 * hub / 50_000
    assert top[0] == pytest.approx(hub) and top[1] == pytest.approx(leaf)


def test_hubs_give_the_same_results_as_none(spark, monkeypatch):
    rng = np.random.default_rng(5)
    pairs = {(int(a), int(b)) for a, b in zip(rng.integers(0, 8, 300), rng.integers(0, 150, 300)) if a != b}
    pairs |= {(200 + i, 201 + i) for i in range(20)}
    nodes = spark.createDataFrame([(i, "n") for i in range(230)], "id long, label string")
    edges = spark.createDataFrame([(a, b, "t") for a, b in sorted(pairs)], "src long, dst long, type string")
    g = graph_projection(Graph(nodes, edges))

    def results():
        return [{r["id"]: r[1:] for r in df.collect()}
                for df in (pagerank(g, max_iter=5), hits(g, iterations=4), connected_components(g))]

    plain = results()
    monkeypatch.setattr(iterate, "HUB_ROWS", 3)
    assert not iterate.EdgeLayout(edges, "src", 8).hubs.isEmpty()
    split = results()
    for a, b in zip(plain, split):
        assert a.keys() == b.keys()
        for k in a:
            assert a[k] == pytest.approx(b[k], rel=1e-9, abs=1e-12)


def test_rows_of_hubs_meet_the_broadcast(spark):
    rows = spark.range(10_000).select(F.when(F.col("id") < 6_000, 7).otherwise(F.col("id")).alias("k"), "id")
    values = rows.select("k").distinct().withColumn("v", F.col("k") + 1)
    hubs = spark.createDataFrame([(7,)], "k long")
    out = iterate.join_split(rows, values, hubs, "k")
    assert out.count() == 10_000 and out.where("v != k + 1").isEmpty()


def test_a_graph_without_edges(spark):
    nodes = spark.createDataFrame([(1, "n"), (2, "n")], "id long, label string")
    edges = spark.createDataFrame([], "src long, dst long, type string")
    g = Graph(nodes, edges)
    assert {r["id"]: r["component"] for r in connected_components(g).collect()} == {1: 1, 2: 2}
    assert [r["pagerank"] for r in pagerank(g).collect()] == [pytest.approx(0.15)] * 2
