"""Stored PCA, embeddings and catalogs: read back and applied to other rows."""
import numpy as np
import pytest
from pyspark.sql import functions as F


def test_stored_pca_equals_the_fitted_one_and_numpy(spark, tmp_path):
    from ledgerlens.operators.reduce import pca_by_variance
    from ledgerlens.operators.stored import apply_pca, store_pca
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 4)) @ rng.normal(size=(4, 4))
    cols = list("abcd")
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], ["id", *cols])
    path = str(tmp_path / "pca")
    store_pca(df, "id", cols, 0.9, path)
    stored = spark.read.parquet(path)
    want = {r[0]: r[1:] for r in pca_by_variance(df, "id", cols, 0.9)[0].collect()}
    got = {r[0]: r[1:] for r in apply_pca(df, "id", stored).collect()}
    assert set(got) == set(want) and all(got[i] == pytest.approx(want[i], abs=1e-9) for i in want)
    z = (x - x.mean(0)) / x.std(0)
    values, vectors = np.linalg.eigh(np.corrcoef(z.T))
    vectors = vectors[:, ::-1][:, :len(got[0])]
    vectors *= np.sign(vectors[np.abs(vectors).argmax(0), range(vectors.shape[1])])
    assert np.array([got[i] for i in range(200)]) == pytest.approx(z @ vectors, abs=1e-6)
    new = spark.createDataFrame([(1, 0.0, 1.0, 2.0, 3.0), (2, None, 1.0, 1.0, 1.0)], ["id", *cols])
    rows = {r[0]: r[1:] for r in apply_pca(new, "id", stored).collect()}
    assert rows[1] == pytest.approx(((np.arange(4) - x.mean(0)) / x.std(0)) @ vectors, abs=1e-6)
    assert all(v is None for v in rows[2])


def test_stored_embedding_equals_the_learned_one(spark, tmp_path):
    from ledgerlens.operators.embed import apply_embedding
    from ledgerlens.operators.encode import label_encode
    from ledgerlens.operators.stored import apply_stored_embedding, store_embedding
    df = spark.range(300).selectExpr("id", "if(id % 7 = 0, null, concat('l', id % 5)) as a", "cast(id % 3 as int) as b",
                                     "cast(id % 2 as int) as y")
    path = str(tmp_path / "emb")
    store_embedding(df, ["a", "b"], "y", path, max_iter=3, seed=1)
    stored = spark.read.parquet(path)
    got = {r.id: r for r in apply_stored_embedding(df, stored, ["a", "b"]).collect()}
    coded = label_encode(df, ["a", "b"])[0]
    want = {r.id: r for r in apply_embedding(coded, stored, ["a", "b"]).collect()}
    assert len(got) == 300 and set(got[1].asDict()) == set(want[1].asDict())
    assert all(got[i].asDict() == want[i].asDict() for i in want)
    new = spark.createDataFrame([(1, "l1", 0), (2, "other", 1), (3, None, None)], "id long, a string, b int")
    rows = {r.id: r for r in apply_stored_embedding(new, stored, ["a", "b"]).collect()}
    known = got[1].asDict()
    assert all(rows[1][c] == known[c] for c in known if c.startswith("a_"))
    assert not any(rows[2][c] for c in known if c.startswith("a_"))
    null = got[0].asDict()
    assert all(rows[3][c] == null[c] for c in null if c.startswith("a_"))
    assert not any(rows[3][c] for c in null if c.startswith("b_"))  # no nulls were seen there


def test_scan_with_catalog(spark, tmp_path):
    from ledgerlens.operators.encode import build_dictionary
    from ledgerlens.sources.stages import scan_with_catalog, schema_catalog
    df = spark.createDataFrame([(1, "x", 2.5, 10), (2, "y", None, 9), (3, None, 0.0, 10)], "id long, s string, d double, n int")
    at = str(tmp_path / "cat")
    catalog = schema_catalog(df, dictionary=build_dictionary(df, ["s", "n"]), path=at)
    labels = spark.read.parquet(f"{at}-labels")
    path = str(tmp_path / "csv")
    df.select("n", "d", F.lit("more").alias("extra"), "s", "id").coalesce(1).write.option("header", True).csv(path)
    back = scan_with_catalog(spark, path, catalog)
    assert back.columns == ["n", "d", "s", "id"]
    back = back.select(*df.columns)
    assert back.dtypes == df.dtypes and sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)
    coded = {r.id: (r.s, r.d, r.n) for r in scan_with_catalog(spark, path, catalog, labels).collect()}
    assert coded == {1: (0, 2.5, 1), 2: (1, None, 0), 3: (None, 0.0, 1)}  # 9 before 10: native order
    other = str(tmp_path / "other")
    with open(other, "w") as f:
        f.write("id,s,n\n7,z,10\n8,x,bad\n")
    rows = {r.id: (r.s, r.d, r.n) for r in scan_with_catalog(spark, other, catalog, labels).collect()}
    assert rows == {7: (-1, None, 1), 8: (0, None, None)}
