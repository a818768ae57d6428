"""The projection's accounts as numbers and steps: any account is a name, and a pair is a few bytes."""

from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from ledgerlens.operators.graph import project
from ledgerlens.operators.graph.project import one_mode_projection


def _brute(rows):
    count, by = {}, {}
    for a, d in rows:
        if a is not None and d is not None:
            count[a, d] = count.get((a, d), 0) + 1
            by.setdefault(d, set()).add(a)
    out = {}
    for d, own in by.items():
        for a, b in combinations(sorted(own, key=lambda x: x.encode() if isinstance(x, str) else x), 2):
            out[a, b] = out.get((a, b), 0) + count[a, d] * count[b, d]
    return out


@pytest.mark.parametrize("kind, ids", [
    ("string", ["a9", "a10", "a0", "a123456789012345678", "a2", "a11"]),
    ("string", ["a1", "a01", "b1", "", "a", "7", "a-3", "a1234567890123456789", "x\n5", "ä1"]),
    ("string", ["1", "2", "10", "33"]),
    ("bigint", [-(1 << 63), (1 << 63) - 1, 0, -1, 1, 300, 70_000, 1 << 40]),
    ("int", [5, -5, 2_000_000_000, 7]),
    ("double", [0.5, -1.0, 1e300]),
])
def test_accounts_of_any_kind(spark, kind, ids):
    rng = np.random.default_rng(3)
    rows = [(ids[int(a)], f"v{int(v)}") for a, v in zip(rng.integers(0, len(ids), 60), rng.integers(0, 6, 60))]
    rows += [(None, "v1"), (ids[0], None)]
    df = spark.createDataFrame(rows, f"start_node_id {kind}, end_node_id string")
    for block in (250, 2):
        got = one_mode_projection(df, block=block)
        assert dict(got.dtypes) == {"start": kind, "end": kind, "strength": "bigint"}
        assert {tuple(r)[:2]: r.strength for r in got.collect()} == _brute(rows) and got.count() == len(_brute(rows))


def test_numbers_of_any_size_come_back():
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.integers(0, 1 << k, 50, dtype=np.uint64) for k in (1, 7, 8, 14, 31, 63)] + [np.array([0, 127, 128, (1 << 64) - 1], dtype=np.uint64)])
    data, size = project._varints(v)
    assert size.max() == 10 and (project._numbers(data)[0] == v).all()


def test_a_pair_travels_as_one_byte_where_accounts_are_near():
    code = list(range(1000, 1200))
    batch = pa.RecordBatch.from_pydict({"code": pa.array([code], pa.list_(pa.int64())), "exist": pa.array([[1] * 200], pa.list_(pa.int64()))})
    out = list(project._packer({})(iter([batch])))
    assert sum(len(x) for b in out for x in b.column("who").to_pylist()) == 200 * 199 // 2
    assert not any(x for b in out for x in b.column("often").to_pylist())
    got = [tuple(r.values()) for b in project._added(project._unpacked(iter(out))) for r in b.to_pylist()]
    assert sorted(got) == [(a, b, 1) for a, b in combinations(code, 2)]
