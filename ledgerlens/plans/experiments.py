"""The five feature-set experiments, each scored by repeated stratified CV of class-balanced random forests:

1. ``pca_codes``: PCA of the numbers + label codes; 2. ``pca_codes_bipartite``: (1) + metrics of the account-device
graph (``acc_*``, ``dev_*``); 3. ``pca_codes_mono``: (1) + metrics of the one-mode projection; 4. ``ledger_pca``:
ledger PCA; 5. ``ledger_pca_metrics``: (4) + metrics of both endpoints.

Card rows are all transactions (account ``o_custkey``, device ``l_partkey``, target ``l_returnflag = 'R'``); ledger
rows are the order chains (``edge_training_set``). Each block of features is written once, under a row number (ids
repeat); the blocks are joined to one table for the cards and one for the ledger, whose folds and rows are written
once and read by the forests of all experiments on it, in one job.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlens.functions.scalar import affix_columns, select_by_regex
from ledgerlens.operators.encode import label_encode
from ledgerlens.operators.graph.build import Graph, bipartite_graph, entity_signature, graph_projection, mono_graph
from ledgerlens.operators.graph.metrics import (
    join_bipartite_metrics, join_edge_metrics, join_mono_metrics, node_metrics,
)
from ledgerlens.operators.graph.project import one_mode_projection
from ledgerlens.operators.model.cv import cross_validated, cross_validation_metrics
from ledgerlens.operators.model.evaluate import cv_summary
from ledgerlens.operators.model.train import RF_DEFAULTS
from ledgerlens.operators.reduce import pca_by_variance
from ledgerlens.plans import fixtures as fx
from ledgerlens.session import cut_lineage

METRIC_REGEX = [".*degree.*", ".*pagerank.*", ".*hits.*", ".*betweenness.*", ".*wcc.*", ".*community.*"]
CARD_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "o_totalprice"]
CARD_CODES = ["l_linestatus", "o_orderstatus", "o_orderpriority"]
LEDGER_NUMERIC = ["f_price_from", "f_cust_from", "f_price_to", "f_cust_to"]


def _features(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("row", "label")]


def bound(blocks: list[DataFrame]) -> DataFrame:
    """Blocks of features side by side, by the row number; no row is lost or doubled."""
    return cut_lineage(reduce(lambda a, b: a.join(b, "row"), blocks))


def card_blocks(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """``target``, ``base``, ``bipartite`` and ``mono`` blocks of the card rows, each with ``row``."""
    tx = cut_lineage(fx.transactions(spark, d).withColumn("row", F.monotonically_increasing_id())
                       .withColumn("label", (F.col("l_returnflag") == "R").cast("int")))
    pca, _, _ = pca_by_variance(tx, "row", CARD_NUMERIC, 0.95)
    codes, _ = label_encode(tx.select("row", *CARD_CODES), CARD_CODES)
    sig = cut_lineage(entity_signature(tx.select("row", "o_custkey", "l_partkey"), ["o_custkey"], ["l_partkey"])
                      .select("row", "start_node_id", "end_node_id"))
    two = bipartite_graph(sig, props=[])
    both = join_bipartite_metrics(sig, node_metrics(graph_projection(two)), two.nodes)
    one = graph_projection(mono_graph(sig, one_mode_projection(sig)), orientation="undirected")
    mono = affix_columns(join_mono_metrics(sig, node_metrics(one)).drop("id", "start_node_id", "end_node_id"),
                         prefix="mono_").withColumnRenamed("mono_row", "row")
    return {"target": tx.select("row", "label"), "base": pca.join(codes, "row"),
            "bipartite": cut_lineage(select_by_regex(both, METRIC_REGEX, keep=["row"])),
            "mono": cut_lineage(select_by_regex(mono, METRIC_REGEX, keep=["row"]))}


def ledger_blocks(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """``target``, ``base`` and ``metrics`` blocks of the ledger's edges, each with ``row``."""
    from ledgerlens.plans.q_relational import edge_training_set

    ets = cut_lineage(edge_training_set(spark, d).withColumn("row", F.monotonically_increasing_id()))
    pca, _, _ = pca_by_variance(ets, "row", LEDGER_NUMERIC, 0.95)
    nodes = fx.ledger_nodes(spark, d).select(F.col("txId").alias("id"), F.lit("node").alias("label"))
    edges = fx.ledger_edges(spark, d).select(F.col("txId1").alias("src"), F.col("txId2").alias("dst"))
    metrics = node_metrics(graph_projection(Graph(nodes, edges), orientation="undirected"))
    ends = join_edge_metrics(ets.select("row", "txId_from", "txId_to"), metrics)
    return {"target": ets.select("row", F.col("target").alias("label")), "base": pca,
            "metrics": cut_lineage(select_by_regex(ends, METRIC_REGEX, keep=["row"]))}


def _scored(blocks: dict[str, DataFrame], sets: dict[str, list[str]], k: int, repeats: int, params: dict) -> DataFrame:
    """``experiment, repeat, fold`` and its scores; ``sets``: the blocks that each experiment learns from."""
    table = bound(list(blocks.values()))
    wanted = [[c for b in own for c in _features(blocks[b])] for own in sets.values()]
    found = cross_validated(table, "row", "label", _features(table), [RF_DEFAULTS | params] * len(sets), k, repeats,
                            seed=2022, feature_sets=wanted)
    names = F.array(*map(F.lit, sets))
    return cross_validation_metrics(found).withColumn("experiment", F.get(names, F.col("setting"))).drop("setting")


def experiment_scores(spark: SparkSession, d: str, k: int = 10, repeats: int = 3, params: dict | None = None) -> DataFrame:
    """``experiment, repeat, fold, accuracy, precision, recall, f1_score``."""
    params = params or {"numTrees": 100}
    cards = _scored(card_blocks(spark, d), {
        "pca_codes": ["base"], "pca_codes_bipartite": ["base", "bipartite"], "pca_codes_mono": ["base", "mono"]},
        k, repeats, params)
    ledger = _scored(ledger_blocks(spark, d), {
        "ledger_pca": ["base"], "ledger_pca_metrics": ["base", "metrics"]}, k, repeats, params)
    return cards.unionByName(ledger)


def compare_experiments(spark: SparkSession, d: str, k: int = 10, repeats: int = 3, params: dict | None = None) -> DataFrame:
    """``experiment, metric, mean``: the mean of each score over all repeats and folds."""
    return cv_summary(cut_lineage(experiment_scores(spark, d, k, repeats, params)))
