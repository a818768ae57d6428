"""Metrics on classes of nodes with the same neighbours equal those on all pairs of nodes."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators.graph.build import Graph, graph_projection, mono_graph
from ledgerlens.operators.graph.classes import projection_classes
from ledgerlens.operators.graph.louvain import louvain
from ledgerlens.operators.graph.metrics import METRIC_COLUMNS, node_metrics
from ledgerlens.operators.graph.project import one_mode_projection

# Groups of accounts with the same devices; g and h share two of three, i uses one twice, z has none.
GROUPS = {"a": (3, ["x"]), "b": (4, ["x", "y"]), "c": (1, ["y"]), "g": (2, ["p", "q", "r"]), "h": (3, ["p", "q"]),
          "i": (2, ["p", "q", "q"]), "j": (2, ["r", "y"]), "z": (2, [None])}


@pytest.fixture(scope="module")
def rows(spark):
    own = [(f"{name}{i}", device) for name, (n, devices) in GROUPS.items() for i in range(n) for device in devices]
    return spark.createDataFrame(own, "start_node_id string, end_node_id string")


def graphs(rows):
    plain = mono_graph(rows, one_mode_projection(rows))
    known = mono_graph(rows, one_mode_projection(rows), device_col="end_node_id")
    return [graph_projection(g, orientation="undirected") for g in (plain, known)]


def test_classes_are_accounts_with_the_same_devices_as_often(rows):
    _, g = graphs(rows)
    found = {r["id"]: r["rep"] for r in g.classes.members.collect()}
    assert found == {f"{k}{i}": k + ("0" if k != "z" else str(i)) for k, (n, _) in GROUPS.items() for i in range(n)}


def test_every_metric_equals_that_on_all_pairs(rows):
    plain, known = ({r["id"]: [r[c] for c in METRIC_COLUMNS[:-1]] for r in node_metrics(g, include_louvain=False).collect()}
                    for g in graphs(rows))
    assert plain.keys() == known.keys()
    for k in plain:
        assert known[k] == pytest.approx(plain[k], abs=1e-9), k


def test_units_are_the_same_weighted_graph(rows):
    plain, _ = graphs(rows)
    g = graph_projection(mono_graph(rows, one_mode_projection(rows), device_col="end_node_id"),
                         orientation="undirected", weight_col="strength")
    units, adj = g.classes.units()
    whole = graph_projection(mono_graph(rows, one_mode_projection(rows)), orientation="undirected", weight_col="strength")
    a = units.select(F.col("id").alias("src"), F.col("unit").alias("u"))
    b = units.select(F.col("id").alias("dst"), F.col("unit").alias("v"))
    want = whole.edges.join(a, "src").join(b, "dst").groupBy("u", "v").agg(F.sum("weight").alias("w"))
    assert {tuple(r) for r in adj.select("src", "dst", "w").collect()} == {tuple(r) for r in want.collect()}


def test_hub_twins_are_not_put_together_beforehand(spark):
    # Two joined hubs over many leaves: k^2 > 2m, so an optimum may part them.
    own = [(h, f"d{i}") for h in ("h1", "h2") for i in range(12)] + [(f"l{i:02}", f"d{i}") for i in range(12)]
    df = spark.createDataFrame(own, "start_node_id string, end_node_id string")
    g = graph_projection(mono_graph(df, one_mode_projection(df), device_col="end_node_id"), orientation="undirected")
    assert {r["id"]: r["rep"] for r in g.classes.members.collect()}["h2"] == "h1"
    assert {r["id"]: r["unit"] for r in g.classes.units()[0].collect()}["h2"] == "h2"


def test_cliques_need_no_pairs(spark):
    """3 cliques of 4,000 nodes are 24 million edges one way; classes have 3."""
    df = spark.range(12_000).select(F.concat(F.lit("a"), F.col("id")).alias("start_node_id"),
                                    F.concat(F.lit("v"), F.col("id") % 3).alias("end_node_id"))
    g = graph_projection(mono_graph(df, one_mode_projection(df), device_col="end_node_id"), orientation="undirected")
    assert g.classes.edges.count() == 3
    got = louvain(g).groupBy("community").count().collect()
    assert {tuple(r) for r in got} == {("a0", 4000), ("a1", 4000), ("a10001", 4000)}


def test_repeating_nodes_have_no_classes(spark):
    nodes = spark.createDataFrame([(1, "n"), (1, "n"), (2, "n")], "id long, label string")
    rows = spark.createDataFrame([(1, 5), (2, 5)], "s long, d long")
    assert projection_classes(nodes, rows, "s", "d") is None
    assert projection_classes(nodes.where("id = 2"), rows, "s", "d") is None
    assert projection_classes(nodes.distinct(), rows, "s", "d").sizes.collect()[0]["n"] == 2


def test_whole_stars_are_one_community_without_a_round(spark, monkeypatch):
    from ledgerlens.operators.graph import louvain as module

    edges = spark.range(1, 400).select(F.when(F.col("id") < 200, 0).otherwise(1000).alias("dst"), F.col("id").alias("src"))
    nodes = edges.selectExpr("src as id").union(edges.selectExpr("dst as id")).distinct().withColumn("label", F.lit("n"))
    turns = []
    plain = module._Level.joint_gain
    monkeypatch.setattr(module._Level, "joint_gain", lambda *a: turns.append(1) or plain(*a))
    got = louvain(Graph(nodes, edges.select("src", "dst"))).groupBy("community").count().collect()
    assert {tuple(r) for r in got} == {(0, 200), (200, 201)}
    assert not turns


def test_tasks_of_a_projection_grow_with_its_pairs(spark, monkeypatch):
    """400 rows of one device are 79,800 pairs; few bytes go in, yet no task gets them all."""
    from pyspark.sql.functions import spark_partition_id

    from ledgerlens.operators.graph import project

    monkeypatch.setattr(project, "PAIRS", 10_000)
    df = spark.range(400).select(F.col("id").alias("start_node_id"), F.lit(1).alias("end_node_id"))
    sizes = [r["count"] for r in one_mode_projection(df, block=50).groupBy(spark_partition_id()).count().collect()]
    assert sum(sizes) == 79_800
    assert max(sizes) < 15_000
