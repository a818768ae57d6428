"""Graph operators on the literal fixtures (closed forms)."""

import numpy as np
from pyspark.sql import functions as F
import pytest

from ledgerlens.operators.graph.betweenness import betweenness
from ledgerlens.operators.graph.build import Graph, entity_signature, graph_projection
from ledgerlens.operators.graph.components import connected_components
from ledgerlens.operators.graph.degree import degree
from ledgerlens.operators.graph.hits import hits
from ledgerlens.operators.graph.louvain import louvain, modularity
from ledgerlens.operators.graph.project import one_mode_projection
from ledgerlens.operators.graph.pagerank import pagerank


def _graph(spark, edges, nodes=None):
    ids = sorted({x for e in edges for x in e} | set(nodes or []))
    n = spark.createDataFrame([(i, "n") for i in ids], "id long, label string")
    e = spark.createDataFrame([(a, b, "t") for a, b in edges], "src long, dst long, type string")
    return Graph(n, e)


def test_projection_literal(spark):
    rows = [("a1", "v1"), ("a1", "v1"), ("a1", "v2"), ("a2", "v1"), ("a3", "v2"), ("a10", "v1")]
    df = spark.createDataFrame(rows, "start_node_id string, end_node_id string")
    got = {(r["start"], r["end"]): r["strength"] for r in one_mode_projection(df).collect()}
    assert got == {("a1", "a10"): 2, ("a1", "a2"): 2, ("a10", "a2"): 1, ("a1", "a3"): 1}


def test_projection_salted_equals_plain(spark):
    rng = np.random.default_rng(0)
    rows = [(f"a{int(a)}", f"v{int(v)}") for a, v in zip(rng.integers(0, 40, 400), rng.integers(0, 5, 400))]
    df = spark.createDataFrame(rows, "start_node_id string, end_node_id string")
    plain = {tuple(r[:2]): r[2] for r in one_mode_projection(df).collect()}
    salted = {tuple(r[:2]): r[2] for r in one_mode_projection(df, block=3).collect()}
    assert plain == salted
    accts = sorted({a for a, _ in rows})
    devs = sorted({v for _, v in rows})
    m = np.zeros((len(accts), len(devs)))
    for a, v in rows:
        m[accts.index(a), devs.index(v)] += 1
    dense = m @ m.T
    expect = {(accts[i], accts[j]): int(dense[i, j]) for i in range(len(accts)) for j in range(len(accts))
              if accts[i] < accts[j] and dense[i, j] > 0}
    assert plain == expect


def test_chain_betweenness_and_components(spark):
    chain = graph_projection(_graph(spark, [(1, 2), (2, 3), (3, 4), (4, 5)]), orientation="undirected")
    bc = {r["id"]: r["betweenness"] for r in betweenness(chain).collect()}
    assert bc == {1: 0.0, 2: 3.0, 3: 4.0, 4: 3.0, 5: 0.0}
    bc2 = {r["id"]: r["betweenness"] for r in betweenness(chain, batches=3).collect()}
    assert bc2 == bc
    comp = {r["id"]: r["component"] for r in connected_components(chain).collect()}
    assert set(comp.values()) == {1}


def test_two_triangles_louvain(spark):
    g = graph_projection(_graph(spark, [(1, 2), (2, 3), (1, 3), (4, 5), (5, 6), (4, 6)]), orientation="undirected")
    comm = {r["id"]: r["community"] for r in louvain(g).collect()}
    assert comm == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4}
    from pyspark.sql import functions as F
    adj = g.edges.select("src", "dst", F.lit(1.0).alias("w"))
    singles = g.nodes.select("id", F.col("id").alias("comm"))
    found = louvain(g).withColumnRenamed("community", "comm")
    assert modularity(adj, found) >= modularity(adj, singles)
    comp = {r["id"]: r["component"] for r in connected_components(g).collect()}
    assert comp == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4}


def test_star_degree_hits_pagerank(spark):
    star = _graph(spark, [(0, 1), (0, 2), (0, 3), (0, 4)])
    deg = {r["id"]: r["degree"] for r in degree(star).collect()}
    assert deg == {0: 4.0, 1: 0.0, 2: 0.0, 3: 0.0, 4: 0.0}
    h = {r["id"]: (r["hits_auth"], r["hits_hub"]) for r in hits(star).collect()}
    assert h[0] == pytest.approx((0.0, 1.0))
    assert all(h[i] == pytest.approx((0.5, 0.0)) for i in range(1, 5))
    pr = {r["id"]: r["pagerank"] for r in pagerank(star).collect()}
    assert pr[0] == pytest.approx(0.15)
    assert pr[1] == pytest.approx(0.15 + 0.85 * 0.15 / 4)


def test_pagerank_matches_numpy(spark):
    edges = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 1), (4, 2)]
    g = _graph(spark, edges)
    got = {r["id"]: r["pagerank"] for r in pagerank(g, max_iter=20, tol=0.0).collect()}
    n = 5
    out = np.zeros(n)
    for a, _ in edges:
        out[a] += 1
    r = np.full(n, 0.15)
    for _ in range(20):
        nr = np.full(n, 0.15)
        for a, b in edges:
            nr[b] += 0.85 * r[a] / out[a]
        r = nr
    assert [got[i] for i in range(n)] == pytest.approx(list(r))


def test_null_key_signature(spark):
    df = spark.createDataFrame([(1, 10, 5), (2, None, 5), (3, 10, None)], "tx long, acc long, dev long")
    out = {r["tx"]: (r["start_node_id"], r["end_node_id"])
           for r in entity_signature(df, ["acc"], ["dev"]).collect()}
    assert out == {1: ("a0", "v0"), 2: (None, "v0"), 3: ("a0", None)}


def _union_find(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def _check_components(spark, nodes, edges):
    g = Graph(spark.createDataFrame([(n, "x") for n in nodes], "id long, label string"),
              spark.createDataFrame(edges or [(0, 0)], "src long, dst long").where("src != dst"))
    got = connected_components(graph_projection(g, orientation="undirected")).collect()
    assert sorted((r.id, r.component) for r in got) == sorted(_union_find(nodes, edges).items())


def test_components_of_a_path_with_mixed_ids(spark):
    path = [2, 3, 4, 6, 5, 1]
    _check_components(spark, sorted(path), list(zip(path, path[1:])))


def test_components_of_random_graphs(spark):
    rng = np.random.default_rng(12)
    nodes, edges = [], []
    for block in range(40):  # many small graphs at once: trees and sparse graphs, ids mixed
        ids = (block * 100 + rng.permutation(12)).tolist()
        nodes += ids
        if block % 2:
            edges += [(ids[i], ids[int(rng.integers(0, i))]) for i in range(1, 12)]
        else:
            edges += [(ids[int(a)], ids[int(b)]) for a, b in rng.integers(0, 12, (9, 2))]
    _check_components(spark, nodes, [e for e in edges if e[0] != e[1]])


def test_projection_of_a_hot_device(spark):
    n = 300
    df = spark.range(n).select(F.concat(F.lit("a"), "id").alias("start_node_id"), F.lit("v").alias("end_node_id"))
    got = one_mode_projection(df, block=20)
    assert got.count() == n * (n - 1) // 2
    assert got.agg(F.min("strength"), F.max("strength")).first() == (1, 1)


def test_projection_adds_up_without_shuffling_pairs(spark, monkeypatch):
    """Lists travel, not pairs; with hot devices and accounts of many pairs the sums are those of a dense product."""
    from ledgerlens.operators.graph import project

    monkeypatch.setattr(project, "PAIRS", 40)
    rng = np.random.default_rng(1)
    rows = [(f"a{int(a)}", int(v)) for a, v in zip(rng.integers(0, 30, 300), rng.integers(0, 12, 300))]
    rows += [("a0", 100 + i) for i in range(40)] + [(f"a{i % 30}", 100 + i) for i in range(40)]
    df = spark.createDataFrame(rows, "start_node_id string, end_node_id int")
    accts, devs = sorted({a for a, _ in rows}), sorted({v for _, v in rows})
    m = np.zeros((len(accts), len(devs)), dtype=int)
    for a, v in rows:
        m[accts.index(a), devs.index(v)] += 1
    dense = m @ m.T
    expect = {(accts[i], accts[j], int(dense[i, j])) for i in range(len(accts)) for j in range(i + 1, len(accts)) if dense[i, j]}
    for block in (1000, 4):
        got = one_mode_projection(df, block=block)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(start" not in plan
        rows_of = [tuple(r) for r in got.collect()]
        assert len(rows_of) == len(expect) and set(rows_of) == expect


def test_pair_sums_of_accounts_that_span_batches(monkeypatch):
    import pyarrow as pa

    from ledgerlens.operators.graph import project

    monkeypatch.setattr(project, "HELD", 5)
    rng = np.random.default_rng(2)
    rows = [(a, int(rng.integers(1, 4)), [int(x) for x in rng.integers(100, 104, rng.integers(0, 4))])
            for a in sorted(rng.integers(0, 6, 60).tolist())]
    expect = {}
    for a, n, who in rows:
        for b in who:
            expect[a, b] = expect.get((a, b), 0) + n * 2
    for width in (1, 3, 7, 60):
        batches = [pa.RecordBatch.from_pydict({"a1": [r[0] for r in own], "n1": pa.array([r[1] for r in own], pa.int64()),
                                               "who": pa.array([r[2] for r in own], pa.list_(pa.int64())),
                                               "often": pa.array([[2] * len(r[2]) for r in own], pa.list_(pa.int64()))})
                   for own in (rows[k:k + width] for k in range(0, len(rows), width))]
        got = [x for b in project._added(iter(batches)) for x in zip(*(c.to_pylist() for c in b.columns))]
        assert len(got) == len(expect) and {(a, b): n for a, b, n in got} == expect


def test_mostly_null_keys(spark):
    df = spark.range(4000).select("id", F.when(F.col("id") % 5 == 0, F.col("id") % 35).alias("acc"),
                                  F.col("id").cast("string").alias("dev"))
    got = entity_signature(df, ["acc"], ["dev"])
    assert got.count() == 4000
    assert got.where("start_node_id is null").count() == 3200
    assert got.where("start_node_id is not null").select("acc", "start_node_id").distinct().count() == 7


def test_edges_stay_where_they_are(spark):
    from ledgerlens.operators.graph.iterate import keyed
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges = keyed(spark.range(1000).selectExpr("id % 50 as src", "id as dst"), "src", 4)
        ranks = spark.range(50).selectExpr("id", "1.0 as pr").repartition(4, "id").persist()
        ranks.count()
        edges.count()
        plan = edges.join(ranks.withColumnRenamed("id", "src"), "src")._jdf.queryExecution().executedPlan().toString()
        head = plan.split("InMemoryTableScan")[0]
        assert "Exchange" not in head and plan.split("InMemoryRelation")[0].count("Exchange") == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        edges.unpersist()
        ranks.unpersist()


def test_undirected_projection_reads_its_edges_once(spark, tmp_path):
    spark.range(10).selectExpr("id as src", "id + 1 as dst").write.parquet(str(tmp_path / "e"))
    edges = spark.read.parquet(str(tmp_path / "e"))
    g = Graph(spark.range(11).selectExpr("id", "'x' as label"), edges)
    plan = graph_projection(g, orientation="undirected").edges._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
