"""Encoding, numbering, profiling and evaluation on literals."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators.encode import label_encode
from ledgerlens.operators.model.evaluate import roc_auc, roc_points
from ledgerlens.operators.model.folds import stratified_folds
from ledgerlens.operators.numbering import global_positions, group_number, ordered_split
from ledgerlens.operators.profile import profile_is_boolean, profile_is_constant, profile_nunique


def test_numeric_category_order(spark):
    df = spark.createDataFrame([(1, 10), (2, 2), (3, 1), (4, None)], "id long, c int")
    enc, _ = label_encode(df, ["c"])
    got = {r["id"]: r["c"] for r in enc.collect()}
    assert got == {1: 2, 2: 1, 3: 0, 4: None}


def test_group_number_many_partitions(spark):
    df = spark.range(0, 1000).select((F.col("id") % 37).alias("k"), "id")
    got = {r["k"]: r["g"] for r in group_number(df, ["k"], "g", num_partitions=7).collect()}
    assert got == {k: k for k in range(37)}


def test_positions_and_split(spark):
    df = spark.range(0, 100).select(((F.col("id") * 7919) % 100).alias("x"))
    pos = sorted((r["x"], r["p"]) for r in global_positions(df, ["x"], "p", num_partitions=5).collect())
    assert pos == [(i, i) for i in range(100)]
    s = {r["x"]: r["split"] for r in ordered_split(df, ["x"]).collect()}
    assert sum(v == "validation" for v in s.values()) == 33
    assert all(s[i] == "validation" for i in range(67, 100))


def test_profiles(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "b", 1.0), (3, None, float("nan"))], "id long, s string, d double")
    nu = {r["column"]: r["nunique"] for r in profile_nunique(df).collect()}
    assert nu == {"id": 3, "s": 2, "d": 1}
    const = {r["column"]: r["is_constant"] for r in profile_is_constant(df).collect()}
    assert const == {"id": False, "s": False, "d": True}
    boolean = {r["column"]: r["is_boolean"] for r in profile_is_boolean(df).collect()}
    assert boolean == {"id": False, "s": True, "d": False}


def test_auc_literal(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1)], "score double, label int")
    assert roc_auc(df).first()["auc"] == pytest.approx(0.75)
    one = df.where("label = 1")
    assert roc_auc(one).first()["auc"] == 0.5
    pts = sorted((r["fpr"], r["tpr"]) for r in roc_points(df).collect())
    assert pts[0] == (0.0, 0.0) and pts[-1] == (1.0, 1.0)


def test_folds_invariants(spark):
    df = spark.range(0, 500).select("id", (F.col("id") % 5 == 0).cast("int").alias("label"))
    f = stratified_folds(df, "id", "label", k=10, repeats=3, seed=1)
    per = f.groupBy("repeat", "id").count().agg(F.max("count")).first()[0]
    assert per == 1 and f.count() == 1500
    counts = f.groupBy("repeat", "fold", "label").count().groupBy("repeat", "label").agg(
        (F.max("count") - F.min("count")).alias("spread")).agg(F.max("spread")).first()[0]
    assert counts <= 1


def test_downcast_keeps_large_keys(spark):
    from ledgerlens.operators.encode import downcast_types
    df = spark.createDataFrame([(1, 3_000_000_000, 1.5), (2, None, None)], "a long, b long, c double")
    out = downcast_types(df)
    assert dict(out.dtypes) == {"a": "int", "b": "bigint", "c": "float"}
    assert {r.b for r in out.collect()} == {3_000_000_000, None}


def test_encode_mostly_null_column(spark):
    from ledgerlens.operators.encode import label_encode
    df = spark.range(1000).selectExpr("id", "if(id % 10 = 0, cast(id % 30 as string), null) as c")
    out, _ = label_encode(df, ["c"])
    assert out.where("c is null").count() == 900
    assert {r.c for r in out.where("c is not null").collect()} == {0, 1, 2}


def test_scan_imputations_by_file_name(spark, tmp_path):
    from ledgerlens.sources.stages import scan_imputations, write_imputations
    df = spark.range(20).selectExpr("id", "cast(id % 2 as int) as imputation").coalesce(1)
    path = write_imputations(df, str(tmp_path / "imp"))
    assert scan_imputations(spark, path).count() == 20
    assert scan_imputations(spark, path, r"part-.*\.parquet").count() == 20
    assert scan_imputations(spark, path, "part").count() == 0  # whole names


def test_fold_weights_use_training_rows_only(spark):
    from ledgerlens.operators.model.cv import _balanced
    counts = {0: {1: 3, 0: 1}, 1: {0: 4}, 2: {1: 2}}
    assert _balanced(counts, 0) == (6 / (2 * 4), 6 / (2 * 2))
    assert _balanced(counts, 1) == (6 / (2 * 1), 6 / (2 * 5))
    assert _balanced({0: {0: 2}, 1: {2: 1}}, 1) == (1.0, 0.0, 0.0)


def test_embedding_keeps_every_row(spark):
    from ledgerlens.operators.embed import apply_embedding, learn_embedding
    df = spark.range(300).selectExpr("id", "if(id % 7 = 0, null, cast(id % 5 as int)) as a",
                                     "cast(id % 3 as int) as b", "cast(id % 2 as int) as y")
    emb = learn_embedding(df, ["a", "b"], "y", max_iter=3)
    sizes = {(r.column, r.code): len(r.vec) for r in emb.collect()}
    assert sizes == {("a", c): 3 for c in (0, 1, 2, 3, 4, None)} | {("b", c): 2 for c in (0, 1, 2)}
    assert apply_embedding(df, emb, ["a", "b"]).count() == 300


def _counted(spark, df):
    """``df`` with an accumulator of the rows that were computed."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(len(b))
            yield b
    return df.mapInPandas(run, df.schema), seen


def test_embedding_equals_the_factorization_machine_of_spark(spark):
    import numpy as np
    from pyspark.ml.classification import FMClassifier
    from pyspark.ml.feature import OneHotEncoder, VectorAssembler
    from ledgerlens.operators.embed import learn_embedding
    df = spark.range(500).selectExpr("if(id % 11 = 0, null, cast(id * id % 40 as int)) as a",
                                     "cast(id % 3 as int) as b", "cast(id % 7 < 3 as int) as y")
    emb = {(r.column, r.code): r.vec for r in learn_embedding(df, ["a", "b"], "y", max_iter=30, seed=5).collect()}
    top = df.agg({"a": "max"}).first()[0]
    data = df.fillna({"a": top + 1}).withColumn("y", df.y.cast("double"))
    hot = OneHotEncoder(inputCols=["a", "b"], outputCols=["ha", "hb"], dropLast=False).fit(data).transform(data)
    model = FMClassifier(featuresCol="x", labelCol="y", factorSize=len(emb["a", 0]), maxIter=30, seed=5,
                         stepSize=0.05).fit(VectorAssembler(inputCols=["ha", "hb"], outputCol="x").transform(hot))
    want = model.factors.toArray()[:top + 2]
    got = np.array([emb.get(("a", c), emb["a", 0]) for c in [*range(top + 1), None]])
    kept = [c for c in range(top + 1) if ("a", c) in emb] + [top + 1]
    assert np.allclose(got[kept] @ got[kept].T, (want @ want.T)[kept][:, kept], atol=1e-4)


def test_embedding_reads_its_input_once(spark):
    from ledgerlens.operators.embed import learn_embedding
    df, seen = _counted(spark, spark.range(90).selectExpr("cast(id % 4 as int) as a", "cast(id % 2 as int) as y").coalesce(1))
    learn_embedding(df, ["a"], "y", max_iter=2).collect()
    assert seen.value == 90


def test_embedding_of_bad_labels_is_refused(spark):
    import pytest
    from ledgerlens.operators.embed import learn_embedding
    for y in (None, 2, -1):
        with pytest.raises(Exception):
            learn_embedding(spark.createDataFrame([(0, 1), (1, y)], "a int, y int"), ["a"], "y", max_iter=1).collect()


def test_a_small_dictionary_does_not_shuffle_the_rows(spark):
    from ledgerlens.operators.encode import label_encode
    df = spark.createDataFrame([(1, "x", None), (2, "y", 7), (3, None, 5), (4, "x", 7)], "id int, a string, b int")
    coded, _ = label_encode(df, ["a", "b"])
    plan = coded._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert sorted(map(tuple, coded.collect())) == [(1, 0, None), (2, 1, 1), (3, None, 0), (4, 0, 1)]
