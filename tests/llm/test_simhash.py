import random

import numpy as np
import xxhash

from ledgerlens.llm import simhash
from tests.llm.util import CLASHING, ODD_TEXTS, docs, space_words


def brute_fingerprint(text):
    w = space_words(text)
    if not w:
        return 0
    sh = [" ".join(w[j:j + 4]) for j in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, tau):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    own = sorted(parent)
    for i, a in enumerate(own):
        for b in own[:i]:
            if (a ^ b).bit_count() <= tau:
                parent[find(a)] = find(b)
    return {f: find(f) for f in own}


def near(rng, base, most):
    return base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, most)))


def test_documents_equal_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(50)]
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)]
    for g in range(30):
        words = [rng.choice(vocab) for _ in range(rng.randint(1, 300))]
        for _ in range(rng.randint(1, 5)):
            own = list(words)
            own[rng.randrange(len(own))] = rng.choice(vocab)
            rows.append((len(rows), " ".join(own)))
    rows += [(7, rows[20][1]), (None, rows[20][1]), (None, "nothing like it at all in here")]
    got = simhash.near_duplicates(docs(spark, rows, CLASHING)).collect()
    fp = {t: brute_fingerprint(t) for _, t in rows}
    group = components(list(fp.values()), 4)
    least = {}
    for i, t in rows:
        g = group[fp[t]]
        least[g] = min((x for x in (least.get(g), i) if x is not None), default=None)
    want = [(i, f"{fp[t]:016x}", least[group[fp[t]]]) for i, t in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    kept = simhash.keep_one(docs(spark, rows, CLASHING))
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == {i for i in least.values() if i is not None}


def test_links_of_clouds_chains_and_noise(spark):
    rng = random.Random(9)
    fps = {rng.getrandbits(64) for _ in range(500)}
    for _ in range(3):  # clouds
        base = rng.getrandbits(64)
        fps |= {near(rng, base, 5) for _ in range(150)}
    x = rng.getrandbits(64)  # a chain whose ends are far apart
    for _ in range(20):
        x = x ^ sum(1 << b for b in rng.sample(range(64), 4))
        fps.add(x)
    fps |= {rng.getrandbits(64) & 0xFFFF for _ in range(100)}  # few bits in use
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    for m in (2, 3, 5):
        got = {r.id & (1 << 64) - 1: r.component for r in simhash.links(
            spark.createDataFrame([(f,) for f in signed], "_fp long"), 4, m).collect()}
        want = components(fps, 4)
        assert set(got) == set(fps)
        pairs = {(got[f], want[f]) for f in fps}
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_thresholds_satisfy_the_pigeonhole():
    rng = np.random.default_rng(1)
    fp = rng.integers(-2**63, 2**63 - 1, 2000)
    fp[:600] &= 0xFFFFFF  # a frequent value of some parts
    pairs = simhash.bits_of(fp).astype(float)
    for m in (2, 3, 4):
        parts = simhash.group_bits(pairs.T @ pairs, len(fp), m)
        assert sorted(b for p in parts for b in p) == list(range(64))
        empty = simhash.Plan(parts, [np.zeros(1 << min(len(p), 16)) for p in parts], 4)
        counts = [np.bincount(v & 0xFFFF, minlength=1 << min(len(p), 16)).astype(float)
                  for p, v in zip(parts, empty.values(fp))]
        t = simhash.Plan(parts, counts, 4).thresholds(empty.values(fp))
        assert (t.sum(axis=1) == 4 - m + 1).all() and (t >= -1).all()
        assert len({tuple(x) for x in t.tolist()}) > 1


def test_correlated_bits_share_a_part():
    rng = np.random.default_rng(2)
    bits = rng.integers(0, 2, (3000, 64))
    bits[:, 40] = bits[:, 3]
    bits[:, 17] = bits[:, 3]
    parts = simhash.group_bits((bits.T @ bits).astype(float), 3000, 4)
    assert any({3, 17, 40} <= set(p) for p in parts)


def test_empty_table(spark):
    df = docs(spark, []).limit(0)
    assert simhash.near_duplicates(df).count() == 0
    assert simhash.keep_one(df).count() == 0


def test_probes_are_not_broadcast(spark, monkeypatch):
    """A fingerprint makes many probes: a plan that goes by their input's bytes would send them all to the driver."""
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = {f - (1 << 64) if f >> 63 else f for b in base for f in (b, near(rng, b, 4))}
    seen, real = [], simhash.star_components
    monkeypatch.setattr(simhash, "star_components", lambda e: seen.append(e) or real(e))
    got = simhash.links(spark.createDataFrame([(f,) for f in fps], "_fp long")).collect()
    assert len(got) == len(fps)
    seen[0].collect()
    plan = seen[0]._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "SortMergeJoin [_key" in plan and "BroadcastHashJoin [_key" not in plan
