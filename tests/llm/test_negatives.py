"""Strassen products against plain integers, heaps and mined negatives against brute force."""
import math

import numpy as np
import pytest

from ledgerlens.llm import negatives as N

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 200, 5), (65, 65, 65), (130, 131, 129), (257, 64, 300)])
@pytest.mark.parametrize("size", [900, 2 ** 29, 2 ** 62])
def test_strassen_is_exact(shape, size):
    rng = np.random.default_rng(sum(shape))
    a, b = rng.integers(-size, size, shape[:2]), rng.integers(-size, size, shape[1:])
    with np.errstate(over="ignore"):
        assert (N.strassen(a, b, leaf=16) == a @ b).all()  # modulo 2^64


def test_heaps_merge_in_any_grouping():
    rng = np.random.default_rng(1)
    score, ids = rng.integers(0, 6, (4, 200)), np.arange(200)
    want = [sorted(zip((-s).tolist(), ids.tolist()))[:5] for s in score]
    for cuts in ([0, 200], [0, 3, 50, 51, 200]):
        heaps = N.Heaps(4, 5)
        for lo, hi in reversed(list(zip(cuts, cuts[1:]))):
            heaps.merge(slice(None), *N._first(score[:, lo:hi], ids[lo:hi], 5))
        assert [list(zip((-s).tolist(), i.tolist())) for s, i in zip(heaps.score, heaps.id)] == want


def test_windows_are_whole_number_comparisons():
    for p in range(-50, 300):
        lo, hi = (int(x[0]) for x in N.windows(np.array([p])))
        for s in range(-60, 310):
            assert (lo <= s <= hi) == (50 * p <= 100 * s <= 95 * p)


def brute(rows, anchor=50):
    use = {}
    rows = [(i, [math.floor(256 * float(np.float32(x))) for x in v], k) for i, v, k in rows
            if i is not None and k is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for i, v, k in rows:
        if i % anchor == 0 and (i not in use or (k, v) < use[i]):
            use[i] = (k, v)
    out = []
    for a, (label, v) in use.items():
        def score(u):
            return sum(x * y for x, y in zip(v, u))
        pos = sorted((-score(u), i) for i, u, k in rows if k == label and i != a)[:5]
        for negative_score, p in pos:
            top = -negative_score
            inside = sorted((-score(u), i) for i, u, k in rows
                            if k != label and 50 * top <= 100 * score(u) <= 95 * top)[:3]
            out += [(a, p, n, i, top, -s) for n, (s, i) in enumerate(inside, 1)]
    return sorted(out)


def mined(df, **kwargs):
    return sorted(tuple(r) for r in N.hard_negatives(df, **kwargs).collect())


def vectors(n, seed, width=5, labels=3, step=10):
    rng = np.random.default_rng(seed)
    return [(int(i), [float(x) for x in np.round(rng.normal(0.6, 0.6, width) * 4) / 4], int(rng.integers(labels)))
            for i in rng.permutation(n) * step]


def test_against_brute_force_with_ties_hot_labels_and_odd_rows(spark):
    rows = vectors(300, 5)
    rows = [(i, v, 0 if i % 30 else k) for i, v, k in rows]  # one label holds most rows
    rows += [(None, [1.0] * 5, 0), (7, None, 1), (9, [1.0] * 5, None), (11, [1.0, None, 1.0, 1.0, 1.0], 0),
             (13, [float("nan")] * 5, 0), (17, [float("inf")] * 5, 1), (19, [], 1), (21, [3.0], 2)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    want = brute(rows)
    assert want and mined(df) == want
    # Several blocks of anchors give the same, as do clashing columns.
    from pyspark.sql import functions as F
    assert mined(df.withColumn("_owner", F.lit(1)).withColumn("score", F.lit("x")), block_bytes=8 * 5 * 9) == want


def test_repeated_ids(spark):
    rows = [(0, [1.0, 1.0], 1), (0, [2.0, 1.0], 1), (5, [1.0, 0.5], 1), (5, [1.0, 0.5], 1), (6, [1.0, 0.0], 2),
            (6, [1.0, 0.0], 2)]
    got = mined(spark.createDataFrame(rows, SCHEMA))
    assert set(got) == set(brute(rows)) and got


def test_components_too_large_for_a_long_take_no_part(spark):
    rows = [(0, [1.0, 2.0], 1), (1, [1e30, 1.0], 1), (2, [1.0, 1.0], 1), (3, [0.5, 1.0], 0)]
    assert mined(spark.createDataFrame(rows, SCHEMA)) == brute([r for r in rows if r[0] != 1])


def test_empty(spark):
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    assert mined(spark.createDataFrame([(1, [1.0], 0)], SCHEMA)) == []


def test_relabel(spark):
    df = spark.createDataFrame([(0, [1.0], 9), (7, [1.0], 3), (8, [1.0], 3), (14, [1.0], None)], SCHEMA)
    assert {r.vec_id: r.label for r in N.relabel(df).collect()} == {0: 0, 7: 4, 8: 3, 14: None}
