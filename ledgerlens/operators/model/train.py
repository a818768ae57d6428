"""Class-balanced random forests: feature assembly, cross-validation, probabilities, storage.

Models that are kept are tables of trees, written by the tasks that grew them; cross-validation, which only needs
predictions, grows all its forests in one job (``cv``).
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerlens.operators.model import forest
from ledgerlens.operators.model.cv import _balanced, as_fit, cross_validated
from ledgerlens.operators.model.evaluate import class_weights, classification_metrics
from ledgerlens.session import cut_lineage

RF_DEFAULTS = {"numTrees": 100, "maxDepth": 30, "featureSubsetStrategy": "sqrt", "minInstancesPerNode": 1,
               "bootstrap": True}


def assemble_features(blocks: list[DataFrame], key: str, feature_cols: list[str],
                      out_col: str = "features") -> DataFrame:
    """Column-bind feature blocks by an inner join on the row key, then assemble a vector."""
    from pyspark.ml.feature import VectorAssembler

    joined = reduce(lambda a, b: a.join(b, key, "inner"), blocks)
    return VectorAssembler(inputCols=feature_cols, outputCol=out_col, handleInvalid="keep").transform(joined)


MAX_CLASSES = 1000


def _weight_column(weights: dict, label: str):
    """Class -> weight as a column; a label with more than ``MAX_CLASSES`` values is no class label."""
    if len(weights) > MAX_CLASSES:
        raise ValueError(f"{label} has more than {MAX_CLASSES} classes")
    pairs = [F.lit(x) for c, w in weights.items() for x in (c, w)]
    return F.create_map(*pairs)[F.col(label)] if pairs else F.lit(None).cast("double")


def with_class_weights(df: DataFrame, label: str = "label", out_col: str = "weight") -> DataFrame:
    rows = class_weights(df, label).limit(MAX_CLASSES + 1).collect()  # one row per class
    weights = {r[label]: float(r["weight"]) for r in rows if r[label] is not None}
    return df.where(F.col(label).isNotNull()).withColumn(out_col, _weight_column(weights, label))


def feature_columns(df: DataFrame, features: str = "features") -> tuple[DataFrame, list[str]]:
    """``df`` with the vector column as one double column for each place."""
    from pyspark.ml.functions import vector_to_array

    first = df.select(F.size(vector_to_array(features)).alias("n")).first()  # one number
    names = [f"_f{i}" for i in range(first["n"] if first else 0)]
    wide = df.withColumn("_v", vector_to_array(features))
    return wide.select(*[c for c in df.columns if c != features], *[F.col("_v")[i].alias(c) for i, c in enumerate(names)]), names


def rf_cross_validate(df: DataFrame, id_col: str, label: str = "label", features: str = "features",
                      params: dict | None = None, k: int = 10, repeats: int = 3,
                      seed: int = 2022) -> tuple[DataFrame, DataFrame]:
    """Repeated stratified CV. Returns per-(repeat, fold) metrics and the stacked predictions.

    Class weights come from the training rows of each fold alone; all folds are fitted in one job."""
    wide, names = feature_columns(df, features)
    stacked = cross_validated(wide, id_col, label, names, [RF_DEFAULTS | (params or {})], k, repeats, seed).drop("setting")
    return classification_metrics(stacked, label, "prediction", ["repeat", "fold"]), stacked


@dataclass(frozen=True)
class Forest:
    """A kept forest: its trees are rows of arrays (``forest.fit_trees``), its settings, bins and top are small."""
    trees: DataFrame
    fit: forest.Fit
    borders: list
    top: object
    batch_trees: int
    features: str

    @property
    def getNumTrees(self) -> int:
        return self.fit.trees


def fit_forest(df: DataFrame, label: str = "label", features: str = "features", params: dict | None = None,
               seed: int = 2022) -> Forest:
    """Class-balanced forest of the rows with a label (0, 1, ..). Its trees are grown and stay in the tasks' groups: the
    driver never holds them."""
    wide, names = feature_columns(df.where(F.col(label).isNotNull()), features)
    counts = {r[0]: r[1] for r in wide.groupBy(F.col(label).cast("int")).count().limit(MAX_CLASSES + 1).collect()}
    if max(counts, default=0) >= MAX_CLASSES:
        raise ValueError(f"{label} has a class above {MAX_CLASSES - 1}")
    if not counts:
        raise ValueError(f"no row has a {label}")
    rows = cut_lineage(wide.select(F.monotonically_increasing_id().alias("_row"), F.col(label).cast("int").alias("_y"),
                                   F.lit(0).alias("_held"), *names))
    blocks = cut_lineage(forest.to_blocks(rows, "_row", [*names, "_y", "_held"]))
    weights = _balanced({0: counts}, -1)
    weights = weights + (0.0,) * (2 - len(weights))
    fit = as_fit(RF_DEFAULTS | (params or {}), target=len(names), predictors=tuple(range(len(names))),
                 mask=len(names) + 1, classes=len(weights), weights=weights, seed=seed)
    borders = forest.bin_borders(rows, names) + [np.zeros(0)] * 2
    trees, top, batch_trees = forest.fit_trees(blocks, len(names) + 2, borders, fit)
    return Forest(cut_lineage(trees), fit, borders, top, batch_trees, features)


def predict_proba(model: Forest, df: DataFrame, id_col: str) -> DataFrame:
    """``(id, p0, p1)`` class probabilities."""
    wide, names = feature_columns(df, model.features)
    base = cut_lineage(wide.select(F.monotonically_increasing_id().alias("_row"), id_col, *names))
    if len(names) != len(model.fit.predictors):
        return base.select(id_col, *[F.lit(None).cast("double").alias(c) for c in ("p0", "p1")])  # no rows
    numbers = base.select("_row", *names, F.lit(0).alias("_y"), F.lit(0).alias("_held")).repartition(
        int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_row")
    blocks = cut_lineage(forest.to_blocks(numbers, "_row", [*names, "_y", "_held"]))
    answers = forest.answer(blocks, len(names) + 2, model.borders, model.fit, model.trees, model.top, model.batch_trees)
    schema, classes = "_row long, p0 double, p1 double", model.fit.classes
    target = forest._schema(schema)

    def rows_of(batches):
        for batch in batches:
            for at, p, keys in zip(*(c.to_pylist() for c in batch.columns)):
                at, p = np.frombuffer(at, dtype=np.int32), np.frombuffer(p).reshape(-1, classes)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(keys, dtype=np.int64)[at]), pa.array(p[:, 0]),
                                                  pa.array(p[:, 1])], schema=target)

    found = answers.join(blocks, "block").select("rows", "answers", "keys").mapInArrow(rows_of, schema)
    return base.select("_row", id_col).join(found, "_row").select(id_col, "p0", "p1")


def model_store(model: Forest, path: str) -> Forest:
    """Save (overwrite) and load back a fitted forest: trees as Parquet, the rest as one row of JSON."""
    spark = model.trees.sparkSession
    model.trees.write.mode("overwrite").parquet(f"{path}/trees")
    splits = [[*key, node, *rule] for key, own in model.top.splits.items() for node, rule in own.items()]
    rest = json.dumps({"fit": asdict(model.fit), "borders": [b.tolist() for b in model.borders], "splits": splits,
                       "gains": model.top.gains, "batch_trees": model.batch_trees, "features": model.features})
    spark.createDataFrame([(rest,)], "model string").write.mode("overwrite").parquet(f"{path}/model")
    return load_forest(spark, path)


def load_forest(spark, path: str) -> Forest:
    kept = json.loads(spark.read.parquet(f"{path}/model").first()["model"])  # one row
    fit = forest.Fit(**{k: tuple(v) if isinstance(v, list) else v for k, v in kept["fit"].items()})
    top = forest._Top(gains=[tuple(g) for g in kept["gains"]])
    for number, tree, node, *rule in kept["splits"]:
        top.splits.setdefault((number, tree), {})[node] = tuple(rule)
    return Forest(spark.read.parquet(f"{path}/trees"), fit, [np.array(b, dtype=np.float64) for b in kept["borders"]],
                  top, kept["batch_trees"], kept["features"])
