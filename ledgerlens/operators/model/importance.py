"""Impurity-based feature importances with the spread across trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlens.operators.model import forest


def feature_importance(spark: SparkSession, model, feature_names: list[str]) -> DataFrame:
    """``(feature, importance, std)``: forest importance and std of per-tree importances, each tree's adding up to 1
    (0 if it has no split)."""
    gains = forest.gains(model.trees, model.top)
    whole = gains.groupBy("tree").agg(F.sum("gain").alias("whole"))
    share = gains.join(whole, "tree").select(
        "predictor", F.when(F.col("whole") > 0, F.col("gain") / F.col("whole")).otherwise(0.0).alias("share"))
    each = share.groupBy("predictor").agg(F.avg("share").alias("importance"), F.stddev_pop("share").alias("std"))
    total = each.agg(F.sum("importance").alias("total"))  # one row
    names = spark.createDataFrame(list(enumerate(feature_names)), "predictor int, feature string")
    return (names.join(each, "predictor", "left").crossJoin(F.broadcast(total))
                 .select("feature", F.when(F.col("total") > 0, F.col("importance") / F.col("total")).otherwise(0.0)
                         .alias("importance"), F.coalesce("std", F.lit(0.0)).alias("std")))


def top_k_importances(importances: DataFrame, k: int = 30) -> DataFrame:
    """The k most important features (a top-k report: the limit is the feature)."""
    return importances.orderBy(F.col("importance").desc(), F.col("feature")).limit(k)
