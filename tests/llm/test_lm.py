import math
import random
from collections import Counter

import pytest

from ledgerlens.llm import lm
from tests.llm.util import CLASHING, ODD_TEXTS, docs, fold, space_words


class Model:
    def __init__(self, rows, order, mu):
        self.order, self.mu = order, mu
        self.count = Counter()
        self.hist = Counter()
        for i, t in rows:
            if fold(i, 10):
                seq = ["<s>", *space_words(t), "</s>"]
                for p in range(1, len(seq)):
                    for k in range(1, order + 1):
                        if p - k + 1 >= 0:
                            self.count[tuple(seq[p - k + 1:p + 1])] += 1
                            self.hist[tuple(seq[p - k + 1:p])] += 1
        own = {g: c for g, c in self.count.items() if len(g) == 1}
        self.n, self.v = sum(own.values()), len(own)

    def p(self, h, w):
        if not h:
            return (self.count[(w,)] + 0.1) / (self.n + 0.1 * (self.v + 1))
        return (self.count[(*h, w)] + self.mu * self.p(h[1:], w)) / (self.hist[h] + self.mu)

    def row(self, i, t):
        seq = ["<s>", *space_words(t), "</s>"]
        base = sum(math.log10(self.p((), w)) for w in seq[1:])
        score = sum(math.log10(self.p(tuple(seq[max(0, p - self.order + 1):p]), seq[p])) for p in range(1, len(seq)))
        return (i, fold(i, 10) == 0, len(seq) - 1, sum(self.count[(w,)] > 0 for w in seq[1:]), self.n, base, score)


def rows_of(n=200):
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(30)] + ["É", "The"]
    rows = list(enumerate(ODD_TEXTS))
    rows += [(100 + k, " ".join(rng.choice(vocab[:rng.randint(2, 32)]) for _ in range(rng.randint(0, 40))))
             for k in range(n)]
    return rows + [(None, "w1 w2"), (101, rows[-1][1]), (101, rows[-1][1])]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_brute_force(spark, order):
    rows = rows_of()
    s = lm.Settings(order=order, chunk_bytes=3000, bucket_bytes=4000)
    got = sorted(map(tuple, lm.score(docs(spark, rows, CLASHING).repartition(5), s).collect()), key=repr)
    model = Model(rows, order, s.mu)
    want = sorted([model.row(i, t) for i, t in rows], key=repr)
    assert len(got) == len(want)
    # Long sums round differently, so rows are matched by their exact columns.
    key = lambda r: (repr(r[0]), *r[1:5], round(r[5], 4), round(r[6], 4))
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_states_add_up_to_one():
    rows = [(1, "a b a c"), (2, "b b a"), (3, "c a b a")]
    model = Model(rows, 3, lm.Settings().mu)
    words = ["a", "b", "c", "</s>", "<unk>"]
    for h in [(), ("<s>",), ("a",), ("<s>", "a"), ("a", "b"), ("z",), ("b", "z")]:
        assert sum(model.p(h, w) for w in words) == pytest.approx(1)


def test_beats_the_base_on_held_out_text(spark):
    from ledgerlens.llm.queries import op3_lm_score
    held = [r for r in op3_lm_score(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_planes_round_trip():
    import numpy as np
    rng = np.random.default_rng(3)
    for top in (1, 200, 70000, 2**63):
        v = rng.integers(0, top, 50, dtype=np.uint64)
        assert (lm._unplanes(lm._planes(v), 50) == v).all()


def test_empty_and_all_held_out(spark):
    assert lm.score(docs(spark, []).limit(0)).count() == 0
    held = next(i for i in range(100) if fold(i, 10) == 0)
    r = lm.score(docs(spark, [(held, "a b")])).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.score) == (3, 0, 0, r.base_score)


def test_buckets_of_keys():
    import numpy as np
    rng = np.random.default_rng(5)
    keys = np.unique(np.concatenate((rng.integers(0, 2 ** 64 - 1, 300, dtype=np.uint64),
                                     np.array([0, 1, 2 ** 64 - 1], dtype=np.uint64))))
    for buckets in (1, 2, 7, 1000, 2 ** 31):
        want = [int(k) * buckets >> 64 for k in keys]
        got = [b for b, lo, hi in lm._occupied(keys, buckets) for _ in range(lo, hi)]
        assert got == want
    assert lm._occupied(keys[:0], 5) == []
