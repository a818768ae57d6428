"""Blocks of features side by side, and experiments that share rows and folds."""

from pyspark.sql import functions as F

from ledgerlens.plans.experiments import _scored, bound


def blocks(spark):
    rows = spark.range(240).select(F.col("id").alias("row"))
    label = (F.col("row") % 3 == 0).cast("int")
    return {"target": rows.select("row", label.alias("label")),
            "base": rows.select("row", F.pmod(F.xxhash64("row"), F.lit(97)).cast("double").alias("noise")),
            "graph": rows.select("row", (label * 2.0).alias("told"))}


def test_blocks_keep_every_row_once(spark):
    own = blocks(spark)
    table = bound(list(own.values()))
    assert table.columns == ["row", "label", "noise", "told"]
    assert table.count() == 240 and table.select("row").distinct().count() == 240
    assert table.where("told != 2 * label").isEmpty()


def test_each_experiment_learns_from_its_own_blocks(spark):
    scores = _scored(blocks(spark), {"plain": ["base"], "with_graph": ["base", "graph"]}, 3, 2, {"numTrees": 10}).collect()
    assert sorted((r["experiment"], r["repeat"], r["fold"]) for r in scores) == [
        (e, r, f) for e in ("plain", "with_graph") for r in range(2) for f in range(3)]
    assert all(r["f1_score"] > 0.95 for r in scores if r["experiment"] == "with_graph")
    assert all(r["f1_score"] < 0.7 for r in scores if r["experiment"] == "plain")
