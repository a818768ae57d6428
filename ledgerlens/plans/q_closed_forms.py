"""Model operators on inputs whose results have a closed form, so that SQL can state them:

* two standardised columns of correlation r: variance ratios (1 + |r|) / 2 and (1 - |r|) / 2, first
  component (z1 + sign(r) z2) / sqrt(2);
* two binary columns of association phi: principal inertias (1 + |phi|) / 2 and (1 - |phi|) / 2;
* a label that is one of the features: every fold scores 1, that feature has all the importance, the
  probabilities are the label;
* a column that another one determines: imputation gives back what was blanked;
* embeddings: one vector for each level, null included, of ``embedding_dim`` numbers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators.embed import learn_embedding
from ledgerlens.operators.encode import label_encode
from ledgerlens.operators.impute import iterative_impute
from ledgerlens.operators.model.importance import feature_importance, top_k_importances
from ledgerlens.operators.model.search import rf_random_search
from ledgerlens.operators.model.train import (
    assemble_features, fit_forest, model_store, predict_proba, rf_cross_validate,
)
from ledgerlens.operators.reduce import explained_variance_cumulative, mca, pca_by_variance, scree
from ledgerlens.operators.stored import apply_pca, store_pca
from ledgerlens.plans import fixtures as fx
from ledgerlens.plans.registry import register
from ledgerlens.session import cut_lineage, stage_path

PAIR = ["l_quantity", "l_extendedprice"]

PAIR_SQL = "WITH " + fx.TX_SQL + """,
st AS (SELECT avg(l_quantity) AS m1, stddev_pop(l_quantity) AS s1, avg(l_extendedprice) AS m2,
              stddev_pop(l_extendedprice) AS s2, corr(l_quantity, l_extendedprice) AS r FROM tx),
ratios AS (SELECT 0 AS component, (1 + abs(r)) / 2 AS v FROM st
           UNION ALL SELECT 1, (1 - abs(r)) / 2 FROM st)"""


def _pair(spark, d):
    return pca_by_variance(fx.transactions(spark, d).select("tx_id", *PAIR), "tx_id", PAIR, 0.95)


@register("pca_two_columns", sql=PAIR_SQL + """
SELECT tx_id, round(((l_quantity - m1) / s1 + sign(r) * (l_extendedprice - m2) / s2) / sqrt(2.0), 6) AS pca_0
FROM tx, st""")
def q_pca_two_columns(spark, d):
    return _pair(spark, d)[0].select("tx_id", F.round("pca_0", 6).alias("pca_0"))


@register("pca_store", sql=PAIR_SQL + """
SELECT tx_id, round(((l_quantity - m1) / s1 + sign(r) * (l_extendedprice - m2) / s2) / sqrt(2.0), 6) AS pca_0
FROM tx, st""")
def q_pca_store(spark, d):
    """Fitted, written, read back and applied."""
    rows = fx.transactions(spark, d).select("tx_id", *PAIR)
    path = stage_path(spark, "pca")
    store_pca(rows, "tx_id", PAIR, 0.95, path)
    return apply_pca(rows, "tx_id", spark.read.parquet(path)).select("tx_id", F.round("pca_0", 6).alias("pca_0"))


@register("scree_two_columns", sql=PAIR_SQL + """
SELECT component, round(v, 6) AS variance_ratio, round(sum(v) OVER (ORDER BY component), 6) AS cumulative FROM ratios""")
def q_scree_two_columns(spark, d):
    return scree(spark, _pair(spark, d)[2]).select(
        "component", F.round("variance_ratio", 6).alias("variance_ratio"), F.round("cumulative", 6).alias("cumulative"))


@register("explained_variance_two_columns", sql=PAIR_SQL + """
SELECT component, round(v, 6) AS variance_ratio, round(sum(v) OVER (ORDER BY component), 6) AS cumulative FROM ratios""")
def q_explained_variance_two_columns(spark, d):
    out = explained_variance_cumulative(scree(spark, _pair(spark, d)[2]).drop("cumulative"))
    return out.select("component", F.round("variance_ratio", 6).alias("variance_ratio"),
                      F.round("cumulative", 6).alias("cumulative"))


@register("mca_two_binary", sql="WITH " + fx.TX_SQL + """,
b AS (SELECT (l_linestatus = 'O')::INT AS x, (l_returnflag = 'R')::INT AS y FROM tx),
p AS (SELECT abs(corr(x, y)) AS phi FROM b)
SELECT 0 AS component, round((1 + phi) / 2, 6) AS inertia FROM p
UNION ALL SELECT 1, round((1 - phi) / 2, 6) FROM p""")
def q_mca_two_binary(spark, d):
    tx = fx.transactions(spark, d).select("tx_id", (F.col("l_linestatus") == "O").alias("x"),
                                          (F.col("l_returnflag") == "R").alias("y"))
    _, inertia = mca(tx, "tx_id", ["x", "y"])
    rows = [(i, round(float(v), 6)) for i, v in enumerate(inertia)]
    return spark.createDataFrame(rows, "component int, inertia double")


SEPARABLE = ["known", "n_chars"]
FOREST = {"numTrees": 10, "maxDepth": 3}


def separable(spark, d):
    """Labelled documents whose label is also a feature."""
    return assemble_features([fx.labelled_documents(spark, d).withColumn("known", F.col("label").cast("double"))
                              .select("doc_id", "label", *SEPARABLE)], "doc_id", SEPARABLE)


PROBA_SQL = "WITH " + fx.DOCS_SQL + """
SELECT doc_id, CAST(1 - label AS DOUBLE) AS p0, CAST(label AS DOUBLE) AS p1 FROM docs"""


@register("rf_separable_cv", sql="""
SELECT r::INT AS repeat, f::INT AS fold, 1.0::DOUBLE AS accuracy, 1.0::DOUBLE AS "precision", 1.0::DOUBLE AS recall,
       1.0::DOUBLE AS f1_score FROM range(3) a(r), range(10) b(f)""")
def q_rf_separable_cv(spark, d):
    metrics, _ = rf_cross_validate(separable(spark, d), "doc_id", params=FOREST)
    return metrics.select("repeat", "fold", "accuracy", "precision", "recall", "f1_score")


@register("rf_separable_proba", sql=PROBA_SQL)
def q_rf_separable_proba(spark, d):
    feats = separable(spark, d)
    return predict_proba(fit_forest(feats, params=FOREST), feats, "doc_id")


@register("rf_separable_store", sql=PROBA_SQL)
def q_rf_separable_store(spark, d):
    feats = separable(spark, d)
    loaded = model_store(fit_forest(feats, params=FOREST), stage_path(spark, "rf_separable"))
    return predict_proba(loaded, feats, "doc_id")


def _importances(spark, d):
    out = feature_importance(spark, fit_forest(separable(spark, d), params=FOREST), SEPARABLE)
    return out.select("feature", F.round("importance", 6).alias("importance"))


@register("rf_separable_importance", sql="""
SELECT 'known' AS feature, 1.0::DOUBLE AS importance UNION ALL SELECT 'n_chars', 0.0""")
def q_rf_separable_importance(spark, d):
    return _importances(spark, d)


@register("rf_separable_top", sql="SELECT 'known' AS feature, 1.0::DOUBLE AS importance")
def q_rf_separable_top(spark, d):
    return top_k_importances(_importances(spark, d), 1).select("feature", "importance")


@register("rf_separable_search", sql="""
SELECT i::INT AS candidate, 1.0::DOUBLE AS accuracy, 1.0::DOUBLE AS f1_score FROM range(2) t(i)""")
def q_rf_separable_search(spark, d):
    results, _, _ = rf_random_search(separable(spark, d), "doc_id", k=3, repeats=1, settings=[
        FOREST, {**FOREST, "numTrees": 5}])
    return results.select("candidate", "accuracy", "f1_score")


@register("impute_determined", sql="""
SELECT o_orderkey, o_orderstatus AS status, o_orderstatus AS twin FROM orders""")
def q_impute_determined(spark, d):
    """Every eleventh status is blanked; its twin column tells what it was."""
    blanked = F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderstatus"))
    rows = fx.table(spark, d, "orders").select("o_orderkey", blanked.alias("status"),
                                               F.col("o_orderstatus").alias("twin"))
    return iterative_impute(rows, "o_orderkey", [], ["status", "twin"], max_iter=1, num_trees=5, max_depth=4)


EMB_CATS = ["o_orderpriority", "p_brand", "p_size"]


@register("embedding_shape", sql="WITH " + fx.WIDE_SQL + """,
""" + ",\n".join(f"""n_{c} AS (SELECT count(DISTINCT {c}) AS n, bool_or({c} IS NULL) AS has_null FROM wide)"""
                 for c in EMB_CATS) + "\n" + "\nUNION ALL ".join(
    f"""SELECT '{c}' AS "column", CASE WHEN i < n THEN i::INT END AS code,
        CAST(greatest(least((n + 1) // 2, 16), 2) AS INT) AS dim
        FROM n_{c}, range(1000) t(i) WHERE i < n OR (i = n AND has_null)""" for c in EMB_CATS))
def q_embedding_shape(spark, d):
    wide = cut_lineage(fx.wide_transactions(spark, d).select("tx_id", "is_fraud", *EMB_CATS))  # read twice
    coded, _ = label_encode(wide, EMB_CATS)
    out = learn_embedding(coded, EMB_CATS, "is_fraud", max_iter=5, seed=2022)
    return out.select("column", "code", F.size("vec").alias("dim"))
