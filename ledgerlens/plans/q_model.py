"""Registered model-evaluation queries (classifier rows: documents x labels, target ``toxic``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators.model.evaluate import (
    auc_with_fallback, class_weights, classification_metrics, cv_summary, pr_points, roc_auc, roc_points,
)
from ledgerlens.operators.model.folds import folds_sql, stratified_folds
from ledgerlens.plans import fixtures as fx
from ledgerlens.plans.registry import register

def _score():
    return F.col("n_chars") / F.lit(20000.0)


SCORE_SQL = "n_chars / 20000.0"


def scored_documents(spark, d):
    return fx.labelled_documents(spark, d).withColumn("score", _score()).withColumn(
        "prediction", (F.col("score") >= 1.0).cast("int"))


SCORED_SQL = "WITH " + fx.DOCS_SQL + f""",
scored AS (SELECT doc_id, label, {SCORE_SQL} AS score,
                  CAST({SCORE_SQL} >= 1.0 AS INTEGER) AS prediction FROM docs)"""


@register("stratified_folds", sql="SELECT * FROM " + folds_sql("doc_id", "label", "docs0")
          .replace("FROM docs0", "FROM (SELECT l.doc_id, l.toxic AS label FROM documents d JOIN labels l "
                                 "ON d.doc_id = l.doc_id) docs0"))
def q_stratified_folds(spark, d):
    docs = fx.labelled_documents(spark, d)
    return stratified_folds(docs, "doc_id", "label", k=10, repeats=3, seed=2022)


@register("class_weights", sql="WITH " + fx.DOCS_SQL + """,
c AS (SELECT label, count(*) AS n FROM docs GROUP BY label)
SELECT label, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n), 6) AS weight FROM c""")
def q_class_weights(spark, d):
    w = class_weights(fx.labelled_documents(spark, d), "label")
    return w.select("label", F.round("weight", 6).alias("weight"))


def _metrics_sql(group: str, digits: int | None = 6) -> str:
    def r(e):
        return f"round({e}, {digits})" if digits is not None else e
    return f"""SELECT {group}
  {r("CASE WHEN tp + tn + fp + fn = 0 THEN 0.0 ELSE (tp + tn) / (tp + tn + fp + fn) END")} AS accuracy,
  {r("CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END")} AS precision,
  {r("CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END")} AS recall,
  {r("CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END")} AS f1_score"""


CM_SQL = """,
cm AS (SELECT {g} sum(CASE WHEN label = 1 AND prediction = 1 THEN 1 ELSE 0 END)::DOUBLE AS tp,
              sum(CASE WHEN label = 0 AND prediction = 1 THEN 1 ELSE 0 END)::DOUBLE AS fp,
              sum(CASE WHEN label = 1 AND prediction = 0 THEN 1 ELSE 0 END)::DOUBLE AS fn,
              sum(CASE WHEN label = 0 AND prediction = 0 THEN 1 ELSE 0 END)::DOUBLE AS tn
       FROM {src} {grp})"""


def _round_metrics(df, group):
    return df.select(*group, *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1_score")])


@register("classification_metrics", sql=SCORED_SQL + CM_SQL.format(g="", src="scored", grp="")
          + "\n" + _metrics_sql("") + " FROM cm")
def q_classification_metrics(spark, d):
    return _round_metrics(classification_metrics(scored_documents(spark, d), "label", "prediction"), [])


FOLD_PRED_SQL = SCORED_SQL + """,
fp0 AS """ + folds_sql("doc_id", "label", "scored") + """,
fpred AS (SELECT f.repeat, f.fold, s.label, s.prediction FROM fp0 f JOIN scored s ON f.doc_id = s.doc_id)"""


@register("cv_summary", sql=FOLD_PRED_SQL + CM_SQL.format(g="repeat, fold,", src="fpred", grp="GROUP BY repeat, fold")
          + """,
m AS (""" + _metrics_sql("repeat, fold,", None) + """ FROM cm),
lng AS (SELECT 'score_rule' AS experiment, 'accuracy' AS metric, accuracy AS value FROM m
        UNION ALL SELECT 'score_rule', 'precision', precision FROM m
        UNION ALL SELECT 'score_rule', 'recall', recall FROM m
        UNION ALL SELECT 'score_rule', 'f1_score', f1_score FROM m)
SELECT experiment, metric, round(avg(value), 6) AS mean FROM lng GROUP BY 1, 2""")
def q_cv_summary(spark, d):
    scored = scored_documents(spark, d)
    folds = stratified_folds(scored, "doc_id", "label", k=10, repeats=3, seed=2022)
    pred = folds.join(scored.select("doc_id", "prediction"), "doc_id")
    m = classification_metrics(pred, "label", "prediction", ["repeat", "fold"]).withColumn(
        "experiment", F.lit("score_rule"))
    return cv_summary(m).select("experiment", "metric", F.round("mean", 6).alias("mean"))


CURVE_SQL = SCORED_SQL + """,
sc AS (SELECT score, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END)::DOUBLE AS pos,
              sum(CASE WHEN label = 1 THEN 0 ELSE 1 END)::DOUBLE AS neg FROM scored GROUP BY score),
tot AS (SELECT sum(pos) AS p, sum(neg) AS n FROM sc),
cum AS (SELECT score, pos, neg, sum(pos) OVER (ORDER BY score DESC) AS pos_cum,
               sum(neg) OVER (ORDER BY score DESC) AS neg_cum FROM sc)"""


@register("roc_points", sql=CURVE_SQL + """
SELECT CAST(NULL AS DOUBLE) AS threshold, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr
UNION ALL SELECT score, round(neg_cum / n, 6), round(pos_cum / p, 6) FROM cum, tot""")
def q_roc_points(spark, d):
    pts = roc_points(scored_documents(spark, d), "label", "score")
    return pts.select("threshold", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


@register("pr_points", sql=CURVE_SQL + """
SELECT score AS threshold, round(pos_cum / (pos_cum + neg_cum), 6) AS precision, round(pos_cum / p, 6) AS recall
FROM cum, tot WHERE pos_cum - pos < p
UNION ALL SELECT CAST(NULL AS DOUBLE), 1.0::DOUBLE, 0.0::DOUBLE""")
def q_pr_points(spark, d):
    pts = pr_points(scored_documents(spark, d), "label", "score")
    return pts.select("threshold", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


AUC_SQL = CURVE_SQL + """,
asc_cum AS (SELECT score, pos, neg, sum(neg) OVER (ORDER BY score) AS neg_cum FROM sc)
SELECT round(CASE WHEN p = 0 OR n = 0 THEN 0.5
                  ELSE (SELECT sum(pos * (neg_cum - neg + neg / 2)) FROM asc_cum) / (p * n) END, 6) AS auc
FROM tot"""


@register("roc_auc", sql=AUC_SQL)
def q_roc_auc(spark, d):
    return roc_auc(scored_documents(spark, d), "label", "score").select(F.round("auc", 6).alias("auc"))


@register("auc_with_fallback", sql=SCORED_SQL + """,
sc AS (SELECT s.doc_id, d.source, s.label, s.score FROM scored s JOIN docs d ON s.doc_id = d.doc_id),
c AS (SELECT source, score, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END)::DOUBLE AS pos,
             sum(CASE WHEN label = 1 THEN 0 ELSE 1 END)::DOUBLE AS neg FROM sc GROUP BY source, score),
r AS (SELECT *, sum(neg) OVER (PARTITION BY source ORDER BY score) AS neg_cum FROM c)
SELECT source, round(CASE WHEN sum(pos) = 0 OR sum(neg) = 0 THEN 0.5
                          ELSE sum(pos * (neg_cum - neg + neg / 2)) / (sum(pos) * sum(neg)) END, 6) AS auc
FROM r GROUP BY source""")
def q_auc_with_fallback(spark, d):
    """The area of each source over all its rows; a source with one class falls back to 0.5."""
    out = auc_with_fallback(scored_documents(spark, d), "label", "score", group="source")
    return out.select("source", F.round("auc", 6).alias("auc"))


# ------------------------------------------------------------------ forests (rows-only)
from ledgerlens.operators.encode import label_encode  # noqa: E402
from ledgerlens.operators.model.importance import feature_importance, top_k_importances  # noqa: E402
from ledgerlens.operators.model.search import rf_random_search  # noqa: E402
from ledgerlens.operators.model.train import (  # noqa: E402
    assemble_features, fit_forest, model_store, predict_proba, rf_cross_validate,
)
from ledgerlens.session import stage_path  # noqa: E402

DOC_FEATURES = ["n_chars", "n_words", "n_lines", "lang", "source"]


def document_features(spark, d):
    """Classifier rows with text statistics over whole texts and label-encoded categories."""
    docs = fx.table(spark, d, "documents")
    lab = fx.table(spark, d, "labels").select("doc_id", F.col("toxic").alias("label"))
    base = docs.select("doc_id", "n_chars", F.size(F.split("text", r"\s+")).alias("n_words"),
                       F.size(F.split("text", "\n")).alias("n_lines"), "lang", "source")
    coded, _ = label_encode(base, ["lang", "source"])
    return assemble_features([coded, lab], "doc_id", DOC_FEATURES)


@register("rf_cross_validate")
def q_rf_cross_validate(spark, d):
    metrics, _ = rf_cross_validate(document_features(spark, d), "doc_id", "label", "features",
                                   params={"numTrees": 100}, k=10, repeats=3, seed=2022)
    return metrics


@register("predict_proba")
def q_predict_proba(spark, d):
    feats = document_features(spark, d)
    return predict_proba(fit_forest(feats, params={"numTrees": 100}), feats, "doc_id")


def _importances(spark, d):
    feats = document_features(spark, d)
    return feature_importance(spark, fit_forest(feats, params={"numTrees": 100}), DOC_FEATURES)


@register("feature_importance")
def q_feature_importance(spark, d):
    return _importances(spark, d)


@register("top_k_importances")
def q_top_k_importances(spark, d):
    return top_k_importances(_importances(spark, d), 30)


@register("model_store")
def q_model_store(spark, d):
    feats = document_features(spark, d)
    model = fit_forest(feats, params={"numTrees": 100})
    loaded = model_store(model, stage_path(spark, "rf_model"))
    return predict_proba(loaded, feats, "doc_id")


@register("rf_random_search")
def q_rf_random_search(spark, d):
    results, _, _ = rf_random_search(document_features(spark, d), "doc_id", n_iter=20, k=10, repeats=3, seed=2022)
    return results


@register("compare_experiments")
def q_compare_experiments(spark, d):
    from ledgerlens.plans.experiments import compare_experiments
    return compare_experiments(spark, d)
