"""The distributed forest: against a plain tree grower, top against bottom, classes, and exact numbers of rows."""
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators.model import forest
from ledgerlens.session import cut_lineage


def plain_tree(fit, number, tree, codes, y, w, asked):
    """The same tree by recursion over rows."""
    least = max(1, fit.min_leaf)

    def impurity(rows):
        s = forest._stats(fit, y[rows], w[rows]).sum(axis=0)
        return float(forest._impurity(fit, s)), s

    def answer(rows):
        _, s = impurity(rows)
        return s[:-1] / s[:-1].sum() if fit.classes else s[:1] / s[2:]

    def go(rows, want, name, level):
        best = None
        if level < fit.depth:
            found = []
            for p in range(len(codes)):
                for cut in range(int(codes.max()) + 1):
                    left = rows[codes[p, rows] <= cut]
                    right = rows[codes[p, rows] > cut]
                    if w[left].sum() >= least and w[right].sum() >= least:
                        gain = impurity(rows)[0] - impurity(left)[0] - impurity(right)[0]
                        found.append((gain, p, cut, left, right))
            tried = forest._order(fit, number, np.array([tree]), np.array([name], dtype=np.uint64))[0].tolist()
            able = [p for p in tried if any(f[1] == p for f in found)]
            allowed = [p for p in tried[:fit.draws()] if p in able] or able[:1]
            top = np.abs(impurity(rows)[1]).max()
            found = [f for f in found if f[1] in allowed and w[rows].sum() >= fit.min_split]
            if found and max(f[0] for f in found) > 1e-12 * max(1, top):
                gain = max(f[0] for f in found)
                best = min((f for f in found if f[0] > gain - 1e-9 * max(1, abs(gain))),
                           key=lambda f: (tried.index(f[1]), f[2]))
        if best is None:
            out[want] = answer(rows)
            return
        _, p, cut, left, right = best
        side = asked[p, want] <= cut
        go(left, want[side], 2 * name, level + 1)
        go(right, want[~side], 2 * name + 1, level + 1)

    out = np.zeros((asked.shape[1], max(1, fit.classes)))
    go(np.flatnonzero(w > 0), np.arange(asked.shape[1]), 1, 0)
    return out


@pytest.mark.parametrize("settings", [{}, {"depth": 2}, {"min_leaf": 5}, {"min_split": 12}, {"candidates": 1, "bootstrap": False},
                                      {"classes": 3}, {"classes": 3, "weights": (1.0, 2.5, 0.5), "candidates": 2, "depth": 4}])
def test_trees_equal_a_plain_grower(settings):
    rng = np.random.default_rng(11)
    codes = rng.integers(0, 5, (3, 90)).astype(np.uint8)
    y = rng.integers(0, 3, 90).astype(float) if settings.get("classes") else np.round(rng.normal(size=90) + codes[0], 1)
    keys = np.arange(90)
    f = forest.Fit(0, (0, 1, 2), 3, seed=4, **settings)
    for tree in range(3):
        w = forest._bag(keys, 2, tree, 4) if f.bootstrap else np.ones(90)
        got = forest.grow_and_predict(f, 2, range(tree, tree + 1), 1, codes, y, keys, codes)
        assert got == pytest.approx(plain_tree(f, 2, tree, codes, y, w, codes), abs=1e-9)
    some = forest.grow_and_predict(f, 2, range(3), 1, codes, y, keys, codes)
    each = sum(forest.grow_and_predict(f, 2, range(t, t + 1), 1, codes, y, keys, codes) for t in range(3))
    assert some == pytest.approx(each, abs=1e-9)


def test_bags_are_poisson():
    w = forest._bag(np.arange(200_000), 3, 5, 7)
    assert [(w == k).mean() for k in range(4)] == pytest.approx([0.3679, 0.3679, 0.1839, 0.0613], abs=0.005)
    assert abs(np.corrcoef(w, forest._bag(np.arange(200_000), 3, 6, 7))[0, 1]) < 0.01


def table(spark, n=900, seed=1):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=n), rng.integers(0, 4, n)
    y, k = a * 3 + b + rng.normal(size=n) * 0.1, ((a > 0) + 2 * (b > 1)).astype(float)
    rows = [(i, float(a[i]), float(b[i]), float(y[i]), float(k[i]), float(i % 5)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, a double, b double, y double, k double, fold double")


COLUMNS = ["a", "b", "y", "k", "fold"]


def answers(df, fits, local_rows=forest.LOCAL_ROWS, rows=128, borders=None):
    blocks = forest.to_blocks(df, "id", COLUMNS, rows=rows)
    from ledgerlens.session import cut_lineage
    blocks = cut_lineage(blocks)
    keys = {r.block: np.frombuffer(r.keys, dtype=np.int64) for r in blocks.collect()}
    got = {}
    for r in forest.fit_predict(blocks, 5, borders or forest.bin_borders(df, COLUMNS), fits, local_rows).collect():
        width = max(1, fits[r.fit].classes)
        for at, v in zip(np.frombuffer(r.rows, dtype=np.int32), np.frombuffer(r.answers).reshape(-1, width)):
            assert (r.fit, keys[r.block][at]) not in got
            got[r.fit, keys[r.block][at]] = v
    return got


def test_held_rows_are_predicted_once_and_well(spark):
    df = table(spark)
    fits = [forest.Fit(2, (0, 1), 4, held=(float(f),), trees=20) for f in range(5)]
    fits += [forest.Fit(3, (0, 1), 4, held=(0.0, 1.0), classes=4, trees=20)]
    got = answers(df, fits)
    rows = {r.id: r for r in df.collect()}
    assert {i for f, i in got if f < 5} == set(rows) and sum(f < 5 for f, _ in got) == len(rows)
    error = [got[int(r.fold), i][0] - r.y for i, r in rows.items()]
    assert np.std(error) < 0.25 * np.std([r.y for r in rows.values()])
    right = [got[5, i].argmax() == r.k for i, r in rows.items() if r.fold < 2]
    assert np.mean(right) > 0.97 and all(got[5, i].sum() == pytest.approx(1) for i, r in rows.items() if r.fold < 2)


def test_top_and_bottom_make_the_same_trees(spark):
    """Whatever the largest group and however rows lie in blocks and partitions."""
    df = table(spark, 600, 3)
    fits = [forest.Fit(2, (0, 1), 4, trees=4, seed=5), forest.Fit(3, (0, 1, 2), 4, classes=4, trees=4, seed=6, everyone=True)]
    borders = forest.bin_borders(df, COLUMNS)
    want = answers(df.repartition(2), fits, borders=borders)
    for local, rows in ((100, 64), (20, 1000)):
        got = answers(df.repartition(5), fits, local, rows, borders)
        assert set(got) == set(want)
        assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_blocks_round_trip_and_nulls(spark):
    df = spark.createDataFrame([(1, 1.5, None), (2, None, 3), (-9, 0.0, 4)], "id long, a double, b int")
    back = forest.from_blocks(forest.to_blocks(df, "id", ["a", "b"], rows=2), "id", ["a", "b"])
    assert sorted(map(tuple, back.collect())) == [(-9, 0.0, 4.0), (1, 1.5, None), (2, None, 3.0)]


def test_unknown_targets_masks_and_empty_tables(spark):
    df = table(spark, 200)
    df = df.withColumn("y", F.when(F.col("id") % 3 == 0, F.col("y"))).withColumn("fold", F.when(F.col("id") % 2 == 0, F.col("fold")))
    got = answers(df, [forest.Fit(2, (0, 1), 4, held=(1.0,), trees=5)])
    assert {i for _, i in got} == {i for i in range(200) if i % 2 == 0 and i % 5 == 1}
    assert answers(df.limit(0), [forest.Fit(2, (0, 1), 4)]) == {}


def test_cross_validation_predicts_every_row_once_a_repeat(spark):
    from ledgerlens.operators.model.cv import cross_validated, cross_validation_metrics
    df = table(spark, 300).withColumn("label", F.when(F.col("id") % 50 != 7, (F.col("a") > 0.3).cast("int")))
    df = df.withColumn("a", F.when(F.col("id") % 20 != 3, F.col("a"))).withColumn("id", F.col("id").cast("string"))
    settings = [{"numTrees": 15, "maxDepth": 90}, {"numTrees": 5, "maxDepth": 1, "bootstrap": False, "featureSubsetStrategy": "all"}]
    got = cross_validated(df, "id", "label", ["a", "b"], settings, k=4, repeats=2).cache()
    labelled = df.where("label is not null").count()
    assert got.count() == 2 * 2 * labelled
    assert got.groupBy("setting", "repeat", "id").count().where("count <> 1").isEmpty()
    scores = {(r.setting, r.repeat, r.fold): r.accuracy for r in cross_validation_metrics(got).collect()}
    assert len(scores) == 16 and np.mean(list(scores.values())) > 0.9
    assert got.where("abs(probability[0] + probability[1] - 1) > 1e-9").isEmpty()
    assert cross_validated(df.limit(0), "id", "label", ["a", "b"], settings).isEmpty()


def test_search_covers_the_grid_and_ranks_by_f1(spark):
    from pyspark.ml.feature import VectorAssembler

    from ledgerlens.operators.model.search import GRID, rf_random_search, sample_settings
    some = sample_settings(20)
    assert len({str(s) for s in some}) == 20 and all(s[k] in GRID[k] for s in some for k in GRID)
    df = table(spark, 200).withColumn("label", (F.col("a") > 0).cast("int"))
    df = VectorAssembler(inputCols=["b", "a"], outputCol="features").transform(df)
    weak = {"numTrees": 3, "maxDepth": 1, "minInstancesPerNode": 90}
    results, best, model = rf_random_search(df, "id", k=3, repeats=1, settings=[weak, {"numTrees": 20, "minInstancesPerSplit": 4}])
    rows = {r.candidate: r for r in results.collect()}
    assert rows[1].f1_score > 0.95 > rows[0].f1_score and best["numTrees"] == 20 and model.getNumTrees == 20


def test_auc_of_groups(spark):
    from ledgerlens.operators.model.evaluate import auc_with_fallback
    rng = np.random.default_rng(2)
    rows = [(g, int(rng.random() < 0.4), float(rng.integers(0, 9))) for g in ["x"] * 150 + ["y"] * 40 + [None] * 20]
    rows += [("one", 1, 0.3), ("one", 1, 0.1), ("none", 0, 2.0)]
    got = {r.g: r.auc for r in auc_with_fallback(spark.createDataFrame(rows, "g string, y int, s double"), "y", "s", "g").collect()}
    for g in ("x", "y", None, "one", "none"):
        pos = [s for k, y, s in rows if k == g and y]
        neg = [s for k, y, s in rows if k == g and not y]
        want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg)) if pos and neg else 0.5
        assert got[g] == pytest.approx(want)


@pytest.mark.parametrize("local", [1_000, 40])
def test_kept_trees_answer_like_those_finished_at_once(spark, tmp_path, monkeypatch, local):
    from ledgerlens.operators.model import train
    from ledgerlens.operators.model.importance import feature_importance
    rng = np.random.default_rng(3)
    x = rng.integers(0, 9, (200, 3)).astype(float)
    y = (x[:, 0] + rng.integers(0, 4, 200) > 6).astype(int)
    rows = [(int(i), int(v), *map(float, r)) for i, (v, r) in enumerate(zip(y, x))]
    df = spark.createDataFrame(rows, "id long, label int, a double, b double, c double")
    feats = train.assemble_features([df], "id", ["a", "b", "c"])
    real_fit, real_predict = forest.fit_trees, forest.fit_predict
    monkeypatch.setattr(forest, "fit_trees", lambda *a, **k: real_fit(*a, **(k | {"local_rows": local})))
    model = train.fit_forest(feats, params={"numTrees": 12, "maxDepth": 40})
    assert bool(model.top.splits) == (local == 40)
    loaded = train.model_store(model, str(tmp_path / "model"))
    got = {r["id"]: (r["p0"], r["p1"]) for r in train.predict_proba(model, feats, "id").collect()}
    assert got == {r["id"]: (r["p0"], r["p1"]) for r in train.predict_proba(loaded, feats, "id").collect()}
    keyed = cut_lineage(df.select(F.monotonically_increasing_id().alias("_row"), "id", "label", F.lit(0).alias("m"), "a", "b", "c"))
    blocks = cut_lineage(forest.to_blocks(keyed, "_row", ["a", "b", "c", "label", "m"]))
    once = real_predict(blocks, 5, model.borders, [replace(model.fit, everyone=True)], local)
    names = {r["_row"]: r["id"] for r in keyed.collect()}
    keys = {r["block"]: np.frombuffer(r["keys"], dtype=np.int64) for r in blocks.collect()}
    seen = 0
    for r in once.collect():
        p = np.frombuffer(r["answers"]).reshape(-1, 2)
        for at, own in zip(np.frombuffer(r["rows"], dtype=np.int32), p):
            assert got[names[keys[r["block"]][at]]] == pytest.approx(tuple(own))
            seen += 1
    assert seen == 200
    shares = {r["feature"]: r["importance"] for r in feature_importance(spark, loaded, ["a", "b", "c"]).collect()}
    assert sum(shares.values()) == pytest.approx(1) and max(shares, key=shares.get) == "a"

