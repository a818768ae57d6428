"""Bipartite -> one-mode projection as a sparse self-join (never a dense matrix).

strength(a1, a2) = sum over shared devices d of c(a1, d) * c(a2, d), only a1 < a2 in
string order, zero strengths absent. Cost is sum_d deg(d)^2: each pair is looked at
once per shared device. The accounts of a device are dealt into blocks of about ``block`` by hash, each written as
one sorted list; every pair of blocks ``i < j`` is a join key of its own, so no key stands for more than
``block ** 2`` pairs. An account travels with the rest of the list, not pair by pair, to the task that adds up all
its pairs; an account with more than ``PAIRS`` of them is dealt over several tasks by the other account.

Accounts are numbers on the way (``_coded``), and the rest of a list travels as the steps from each number to the next,
each step in as few bytes as it needs (7 bits a byte), with counts only where one is not 1.

Pairs are many more than the rows they come from, so the sizes of what is joined say nothing of the work: the number
of tasks is set by the number of pairs, about ``PAIRS`` for each. A task reads its rows in the order of their account
and holds some accounts at a time (``HELD`` pairs, or one account), so that what it holds does not grow with the
input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegralType, StringType

from ledgerlens.operators.graph.iterate import partitions
from ledgerlens.operators.numbering import positions_with_total
from ledgerlens.session import cut_lineage, write_stage

BLOCK = 250
PAIRS = 2_000_000
HELD = 1 << 19
#: A name as what stands before its last number, and that number.
_NAME = r"\A(?s)(.*?)(0|[1-9][0-9]{0,17})?\z"


def pivot_sum(df: DataFrame, account: str = "start_node_id", device: str = "end_node_id") -> DataFrame:
    """Account x device transaction counts in long (sparse) form; absent cells mean 0."""
    return (df.where(F.col(account).isNotNull() & F.col(device).isNotNull())
              .groupBy(F.col(account).alias("account"), F.col(device).alias("device"))
              .agg(F.count(F.lit(1)).cast("bigint").alias("exist")))


def one_mode_projection(df: DataFrame, account: str = "start_node_id", device: str = "end_node_id",
                        block: int = BLOCK) -> DataFrame:
    # (account, device, exist) is read again and again below: write it once instead of recomputing the
    # input plan per branch.
    return projected_pairs(write_stage(pivot_sum(df, account, device), "cells"), block)


def projected_pairs(cells: DataFrame, block: int = BLOCK) -> DataFrame:
    """``start, end, strength`` of written ``cells(account, device, exist)``."""
    coded, named = _coded(cells)
    # partial agg per map task; one row a device
    shared = coded.groupBy("device").agg(F.count(F.lit(1)).alias("k"))
    n, most = shared.agg(F.sum(F.col("k").cast("double") * (F.col("k") - 1) / 2), F.max("k")).first()
    parts = max(partitions(cells), int((n or 0) // PAIRS) + 1)
    many = (most or 0) > block
    if many:
        shared = cut_lineage(shared)
        blocks = F.greatest(F.ceil(F.col("k") / F.lit(block)), F.lit(1)).cast("int")
        sized = coded.join(shared.hint("merge"), "device").withColumn("blocks", blocks)
        sized = sized.withColumn("b", F.pmod(F.xxhash64("code"), F.col("blocks")).cast("int"))
        key = ["device", "b", "blocks"]
    else:
        sized, key = coded, ["device"]
    lists = (sized.repartition(parts, *key[:2]).groupBy(*key)
                  .agg(F.sort_array(F.collect_list(F.struct("code", "exist"))).alias("own")))
    lists = cut_lineage(lists) if many else lists  # read three times
    pack = _packer(_ways(coded, shared, most or 0))
    rows = lists.select("own.code", "own.exist").mapInArrow(pack, _ROW)
    if many:
        rows = rows.unionByName(_across(lists.where("blocks > 1"), parts).mapInArrow(pack, _ROW))
    pairs = (rows.repartition(parts, "a1", "t").sortWithinPartitions("a1").select("a1", "who", "often")
                 .mapInArrow(lambda batches: _added(_unpacked(batches)), "p long, q long, strength long"))
    return named(pairs)


def _coded(cells: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``code, device, exist`` with a number for each account, and what turns pairs ``p, q, strength`` of such numbers into
    ``start, end, strength``. Whole numbers stand for themselves, names that differ in the number at their end
    only for that number; other accounts are numbered, and named again by a join."""
    kind = cells.schema["account"].dataType
    if isinstance(kind, IntegralType):
        return (cells.select(F.col("account").cast("long").alias("code"), "device", "exist"),
                lambda pairs: pairs.select(F.col("p").cast(kind).alias("start"), F.col("q").cast(kind).alias("end"), "strength"))
    if kind == StringType():
        front, digits = (F.regexp_extract("account", _NAME, k) for k in (1, 2))
        first, last, shortest = cells.agg(F.min(front), F.max(front), F.min(F.length(digits))).first()
        if first == last and shortest:
            start, end = (F.concat(F.lit(first), F.col(c).cast("string")) for c in ("p", "q"))
            return (cells.select(digits.cast("long").alias("code"), "device", "exist"),
                    lambda pairs: pairs.select(F.least(start, end).alias("start"), F.greatest(start, end).alias("end"), "strength"))
    ids = cut_lineage(positions_with_total(cells.select("account").distinct(), ["account"], "code")[0])
    # Compressed cells and packed pairs are more than their bytes say: neither is to be broadcast.
    first, second = (ids.select(F.col("code").alias(c), F.col("account").alias(name)).hint("merge")
                     for c, name in (("p", "start"), ("q", "end")))
    return (cells.join(ids.hint("merge"), "account").select("code", "device", "exist"),
            lambda pairs: pairs.join(first, "p").join(second, "q").select("start", "end", "strength"))


def _across(lists: DataFrame, parts: int) -> DataFrame:
    """``code, exist`` of each block of a device and ``code, exist`` of each other one."""
    left = lists.where("b < blocks - 1").select("device", F.col("b").alias("i"), F.col("own").alias("own_i"),
                                                F.explode(F.sequence(F.col("b") + 1, F.col("blocks") - 1)).alias("j"))
    right = lists.where("b > 0").select("device", F.col("b").alias("j"), F.col("own").alias("own_j"),
                                        F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("i"))
    left, right = (side.repartition(parts, "device", "i", "j") for side in (left, right))
    ways = F.stack(F.lit(2), "own_i", "own_j", "own_j", "own_i").alias("own", "others")
    return left.join(right, ["device", "i", "j"]).select(ways).select(
        "own.code", "own.exist", F.col("others.code").alias("who"), F.col("others.exist").alias("often"))


def _ways(coded: DataFrame, shared: DataFrame, most: int) -> dict[int, int]:
    """The accounts of more than ``PAIRS`` pairs, fewer than two for every ``PAIRS`` pairs, and to how many tasks each goes."""
    devices = coded.groupBy("code").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if devices * most <= PAIRS:
        return {}
    busy = coded.join(shared.hint("merge"), "device").groupBy("code").agg(F.sum(F.col("k").cast("double")).alias("n")).where(F.col("n") > PAIRS)
    return {r.code: r.ways for r in busy.select("code", F.ceil(F.col("n") / F.lit(PAIRS)).cast("int").alias("ways")).collect()}


_ROW = "a1 long, t int, who binary, often binary"


def _packer(ways: dict[int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows ``a1, t, who, often`` of lists ``code, exist``, each account with those after it, or of lists and others
    ``who, often``, each account with the larger ones of them. ``t``: the share of an account's pairs, 0 but for ``ways``."""
    busy = np.sort(np.fromiter(ways, dtype=np.int64, count=len(ways)))

    def shares(row: tuple, out: list) -> None:
        x, n, y, m = row
        t = (y.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(ways[int(x)])
        for k in np.unique(t):
            out.append((x, k, n, y[t == k], m[t == k]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, other = _lists(batch, 0), _lists(batch, 2) if batch.num_columns > 2 else None
            at, lo, hi = own[2], own[2][:-1], own[2][1:]
            place = np.arange(at[0], at[-1])
            if other is None:
                y, m, begin, end = own[0], own[1], place + 1, np.repeat(hi, hi - lo)
            else:
                y, m, first, last = other[0], other[1], other[2][:-1], other[2][1:]
                begin = np.concatenate([a + np.searchsorted(y[a:b], own[0][c:d], "right") for a, b, c, d in
                                        zip(first, last, lo, hi)] or [place])
                end = np.repeat(last, hi - lo)
            place, begin, end = (c[begin < end] for c in (place, begin, end))
            x, n = own[0][place], own[1][place]
            if len(busy):
                split = np.isin(x, busy)
                out: list = []
                for k in np.flatnonzero(split):
                    shares((x[k], n[k], y[begin[k]:end[k]], m[begin[k]:end[k]]), out)
                for a1, t, often, who, counts in out:
                    yield _steps(np.array([a1]), np.array([often]), who, counts, np.array([0]), np.array([len(who)]), int(t))
                x, n, begin, end = (c[~split] for c in (x, n, begin, end))
            cuts = np.unique(np.concatenate(([0], np.searchsorted(np.cumsum(end - begin), np.arange(HELD, (end - begin).sum(), HELD)),
                                             [len(x)]))).tolist()
            for a, b in zip(cuts, cuts[1:]):
                yield _steps(x[a:b], n[a:b], y, m, begin[a:b], end[a:b])

    return run


def _lists(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two columns of lists of equal lengths: the values of both, and where the lists begin and end."""
    first, second = batch.column(k), batch.column(k + 1)
    at = np.concatenate(([0], np.cumsum(first.value_lengths().to_numpy()))).astype(np.int64)
    return first.flatten().to_numpy(), second.flatten().to_numpy(), at


def _steps(x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray, begin: np.ndarray, end: np.ndarray, t: int = 0) -> pa.RecordBatch:
    """Rows of the accounts ``x``, ``n`` times each, with those at ``begin`` to ``end`` of the sorted ``y``, ``m`` times each."""
    size = end - begin
    first = np.cumsum(size) - size
    at = np.repeat(begin - first, size) + np.arange(size.sum())
    to, times = y[at], np.repeat(n, size) * m[at]
    before = np.roll(to, 1)
    before[first] = x
    data, length = _varints((to.view(np.uint64) - before.view(np.uint64)))
    where = np.concatenate(([0], np.cumsum(length)))[np.concatenate((first, [len(to)]))]
    odd = np.repeat(np.maximum.reduceat(times, first) != 1, size) if len(first) else np.zeros(0, dtype=bool)
    counts, length = _varints(times[odd].view(np.uint64))
    full = np.zeros(len(to), dtype=np.int64)
    full[odd] = length
    often = np.concatenate(([0], np.cumsum(full)))[np.concatenate((first, [len(to)]))]
    return pa.RecordBatch.from_arrays([pa.array(x), pa.array(np.full(len(x), t, dtype=np.int32)),
                                       _binary(where, data), _binary(often, counts)], names=["a1", "t", "who", "often"])


def _binary(at: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32).tobytes()),
                                                            pa.py_buffer(data.tobytes())])


def _varints(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the numbers, 7 bits in each, the lowest first, and how many bytes each has; all but the last one's are above 127."""
    size = np.ones(len(v), dtype=np.int64)
    for k in range(1, 10):
        more = v >= np.uint64(1 << 7 * k)
        if not more.any():
            break
        size += more
    at = np.cumsum(size) - size
    out = np.empty(int(size.sum()), dtype=np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        out[at[has] + k] = ((v[has] >> np.uint64(7 * k)) & np.uint64(127)) | np.where(size[has] > k + 1, np.uint64(128), np.uint64(0))
    return out, size


def _numbers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of ``_varints``, and where each one's last byte is."""
    last = np.flatnonzero(data < 128)
    first = np.concatenate(([0], last[:-1] + 1))[:len(last)]
    size = last - first + 1
    v = np.zeros(len(last), dtype=np.uint64)
    for k in range(int(size.max(initial=0))):
        has = size > k
        v[has] |= (data[first[has] + k].astype(np.uint64) & np.uint64(127)) << np.uint64(7 * k)
    return v, last


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column, and where each row's begin and end."""
    at = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[at[0]:at[-1]]
    return data, at - at[0]


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``a1, who, often`` with lists of accounts and counts, and a count ``n1`` that is in theirs."""
    for batch in batches:
        if not batch.num_rows:
            continue
        a1, (data, at), (counts, at_counts) = batch.column("a1"), _bytes(batch.column("who")), _bytes(batch.column("often"))
        step, last = _numbers(data)
        first = np.searchsorted(last, at[:-1])  # a row's first number
        size = np.diff(np.append(first, len(step)))
        run = np.cumsum(step)
        who = run + np.repeat(a1.to_numpy().view(np.uint64) - run[first] + step[first], size)
        often = np.ones(len(who), dtype=np.int64)
        often[np.repeat(np.diff(at_counts) > 0, size)] = _numbers(counts)[0].view(np.int64)
        cuts = pa.array(np.append(first, len(step)).astype(np.int32))
        yield pa.RecordBatch.from_arrays([a1, pa.array(np.ones(len(a1), dtype=np.int64)),
                                          pa.ListArray.from_arrays(cuts, pa.array(who.view(np.int64))),
                                          pa.ListArray.from_arrays(cuts, pa.array(often))], names=["a1", "n1", "who", "often"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``p, q, strength`` of rows ``a1, n1, who, often`` that come in the order of ``a1``."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += len(batch.column("who").flatten())
        if size < HELD:
            continue
        # The last account may go on in the next batch.
        codes = batch.column("a1").dictionary_encode().indices.to_numpy()
        last = int(np.flatnonzero(codes != codes[-1])[-1]) + 1 if codes[0] != codes[-1] else 0
        if last:
            yield _sums([*held[:-1], batch.slice(0, last)])
            held = [batch.slice(last)]
            size = len(held[0].column("who").flatten())
        elif len(held) > 1 and held[-2].column("a1")[-1] != batch.column("a1")[0]:
            yield _sums(held[:-1])
            held = [batch]
            size = len(batch.column("who").flatten())
    if held:
        yield _sums(held)


def _sums(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    a1, n1, who, often = (pa.concat_arrays([b.column(c) for b in batches]) for c in ("a1", "n1", "who", "often"))
    length = who.value_lengths().to_numpy()
    code, p = np.unique(a1.to_numpy(), return_inverse=True)
    q = who.flatten().to_numpy()
    low, high = (int(q.min()), int(q.max())) if len(q) else (0, 0)
    names = None
    if len(code) * (high - low + 1) >= 1 << 62:  # far apart: by rank
        names, q = np.unique(q, return_inverse=True)
        low, high = 0, len(names) - 1
    span = high - low + 1
    key = np.repeat(p, length) * span + (q - low)
    n = np.repeat(n1.to_numpy(), length) * often.flatten().to_numpy()
    if (n == 1).all():
        key.sort()
    else:
        order = np.argsort(key)
        key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))[:len(key)])
    pair = key[first]
    end = pair % span + low
    return pa.RecordBatch.from_arrays([pa.array(code[pair // span]), pa.array(end if names is None else names[end]),
                                       pa.array(np.add.reduceat(n, first) if len(first) else n)], names=["p", "q", "strength"])
