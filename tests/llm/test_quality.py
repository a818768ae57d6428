import random

import numpy as np

from ledgerlens.llm import quality
from tests.llm.util import CLASHING, ODD_TEXTS, docs, fold

SMALL = quality.Settings(bits=14, shards=3, epochs=6)


def made(n):
    rng = random.Random(6)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randint(3, 80))]
        good = rng.random() < 0.8
        rows.append((i, " ".join(words) if good else " | ".join(words) if i % 2 else " ".join(w + "!!" for w in words)))
        if i % 3:
            labels.append((i, int(good), 0))
    return rows, labels, {i: int(" | " not in (t or "") and "!!" not in t) for i, t in rows}


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    rows, labels, truth = made(900)
    df, lab = docs(spark, rows), labels_of(spark, labels)
    got = quality.score(df, quality.train(df, lab, SMALL), SMALL).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (fold(r.doc_id, 5) == 0) and 0 <= r.score <= 1
        assert r.predicted == int(r.score >= 0.3)
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out]
    assert np.mean([a == b for a, b in held]) > 0.95


def test_given_documents(spark):
    from ledgerlens.llm.queries import op1_quality
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(r.predicted, truth[r.doc_id]) for r in op1_quality(spark, sf).collect()
            if r.held_out and r.doc_id in truth]
    assert np.mean([a == b for a, b in held]) > 0.95


def test_labels_of_held_out_rows_are_not_learnt(spark):
    rows, labels, _ = made(300)
    df = docs(spark, rows)
    flipped = [(i, 1 - q if fold(i, 5) == 0 else q, t) for i, q, t in labels]
    a = quality.train(df, labels_of(spark, labels), SMALL)
    b = quality.train(df, labels_of(spark, flipped), SMALL)
    assert np.array_equal(a, b)


def test_sample_bound(spark):
    rows, labels, _ = made(900)
    s = quality.Settings(bits=14, max_train=100)
    n = quality._sample(docs(spark, rows), labels_of(spark, labels), s, 5).count()
    assert 50 < n < 150


def test_odd_rows(spark):
    rows, labels, _ = made(100)
    rows += [(1000 + k, t) for k, t in enumerate(ODD_TEXTS)] + [(None, "x y"), (1, rows[1][1])]
    labels += [(1, 1, 0), (2, None, None), (None, 1, 0), (1005, 0, 0)]
    df = docs(spark, rows, CLASHING)
    w = quality.train(df, labels_of(spark, labels), SMALL)
    got = quality.score(df, w, SMALL).collect()
    assert len(got) == len(rows)
    kept = quality.score(df, w, SMALL, keep=True)
    assert kept.schema.names == df.schema.names
    assert kept.count() == sum(r.predicted for r in got)


def test_empty_tables(spark):
    rows, labels, _ = made(50)
    df = docs(spark, rows)
    w = quality.train(df, labels_of(spark, labels).limit(0), SMALL)
    assert {r.score for r in quality.score(df, w, SMALL).collect()} == {0.5}
    assert quality.score(df.limit(0), w, SMALL).count() == 0


def test_model_does_not_depend_on_the_order_of_rows(spark):
    """Also where ids repeat with other texts."""
    from ledgerlens.llm import quality
    rows = [(i % 40, f"word{i % 7} sign!! {'x ' * (i % 11)}", "en", "s", 1) for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    schema = "doc_id long, text string, lang string, source string, n_chars int"
    first = quality.train(spark.createDataFrame(rows, schema).coalesce(1), labels)
    again = quality.train(spark.createDataFrame(rows[::-1], schema).repartition(5), labels)
    assert (first == again).all() and first.any()
