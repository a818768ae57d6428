"""Hard negatives by Strassen multiplication of integer tiles and mergeable heaps.

Components become ``floor(256 * x)``. Tiles of anchors and candidates are int64 matrices, padded with
zeros to even sides and multiplied by Strassen's seven products, recursively; additions are exact
(modulo 2^64, and true scores fit, see below). A leaf whose terms are small enough to be exact in
doubles is multiplied in doubles, any other in int64.

1. Positives: anchors meet the candidates of their own label. A task keeps, for each anchor, a heap of its
   best ``positives`` scores; the tasks' heaps of an anchor are merged into its positives.
2. Negatives: each positive opens a window ``[low, high]`` of scores. Anchors meet all candidates; a task
   keeps, for each positive, a heap of the best ``negatives`` scores inside its window, of other labels;
   the heaps are merged.

A heap holds the first few of all pairs it has seen, by score and then id, so heaps merge in any order and
grouping. Anchors go out in blocks of at most ``BLOCK_BYTES``, one after the other; candidates are read
where they lie and never shuffled, whatever labels they have.

Defined results: rows with a null id, label or vector, or a null or non-finite component, take no part, nor
do rows with a component so large that an inner product might not fit a long (``|floor(256 x)|`` above
``isqrt(2^63 / d)`` for ``d`` components in the longest vector); shorter vectors end in zeros. Repeated ids:
of an anchor the row of smallest label and vector counts, "another row" is one with another id, and
repeated candidates each count. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerlens.operators.numbering import positions_with_total
from ledgerlens.session import cut_lineage

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95  # per cent of the positive's score
#: Bytes of anchors that are sent out at a time.
BLOCK_BYTES = 16_000_000
#: Anchors and candidates of a tile.
TILE = 1024
#: Sides up to which a product is made directly.
LEAF = 64
_NONE = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The int64 product of two int64 matrices (modulo 2^64)."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf // 2 or max(m, k, n) <= leaf:
        top = _bound(a) * _bound(b) * k
        if top < 2 ** 53:
            return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
        return a @ b
    a, b = _even(a), _even(b)
    (i, j), l = (a.shape[0] // 2, a.shape[1] // 2), b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    c = np.empty((2 * i, 2 * l), dtype=np.int64)
    c[:i, :l] = p1 + p4 - p5 + p7
    c[:i, l:] = p3 + p5
    c[i:, :l] = p2 + p4
    c[i:, l:] = p1 - p2 + p3 + p6
    return c[:m, :n]


def _bound(a: np.ndarray) -> int:
    return max(int(a.max()), -int(a.min())) if a.size else 0


def _even(a: np.ndarray) -> np.ndarray:
    rows, cols = a.shape[0] % 2, a.shape[1] % 2
    return np.pad(a, ((0, rows), (0, cols))) if rows or cols else a


class Heaps:
    """For each of ``n`` owners the first ``size`` of the (score, id) pairs seen: higher scores first, ties by
    smaller id."""

    def __init__(self, n: int, size: int):
        self.score = np.full((n, size), _NONE, dtype=np.int64)
        self.id = np.zeros((n, size), dtype=np.int64)

    def merge(self, owners: np.ndarray | slice, score: np.ndarray, ids: np.ndarray) -> None:
        """``score`` has a row for each owner; ``_NONE`` marks what takes no part."""
        size = self.score.shape[1]
        s = np.concatenate([self.score[owners], score], axis=1)
        i = np.concatenate([self.id[owners], ids], axis=1)
        order = np.lexsort((i, ~s), axis=1)[:, :size]  # ~s falls as s rises, without overflow
        self.score[owners] = np.take_along_axis(s, order, axis=1)
        self.id[owners] = np.take_along_axis(i, order, axis=1)


def _first(score: np.ndarray, ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``size`` best of each row by score, then id; columns are in id order."""
    if score.shape[1] > 4 * size:
        # The size-th best score of a row; what is above it, and the leftmost of what equals it, are the first.
        cut = np.partition(score, score.shape[1] - size, axis=1)[:, -size][:, None]
        above = score > cut
        equal = score == cut
        spare = size - above.sum(axis=1, keepdims=True)
        tied = np.flatnonzero(equal.sum(axis=1) > spare[:, 0])
        if len(tied):
            equal[tied] &= np.cumsum(equal[tied], axis=1) <= spare[tied]
        at = np.nonzero(above | equal)[1].reshape(len(score), size)
        return np.take_along_axis(score, at, axis=1), ids[at]
    return score, np.broadcast_to(ids, score.shape)


def _falling(score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row in falling order, and the columns it comes from, ties by column."""
    bits, least = TILE.bit_length(), -(1 << 50)
    if score.size and int(score.max()) < -least and int(np.where(score == _NONE, 0, score).min()) > least:
        # Score and column in one number: a plain sort does both. What takes no part becomes the least.
        key = np.sort(~((np.maximum(score, least) << bits) | ((1 << bits) - 1 - np.arange(score.shape[1]))), axis=1)
        key = ~key
        return key >> bits, (1 << bits) - 1 - (key & ((1 << bits) - 1))
    order = np.argsort(~score, axis=1, kind="stable")
    return np.take_along_axis(score, order, axis=1), order


class Candidates:
    """Ids, labels and integer vectors of a batch, in id order, in tiles."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]

    def tiles(self, rows: np.ndarray | None = None) -> Iterator[tuple]:
        rows = np.arange(len(self.ids)) if rows is None else rows
        for lo in range(0, len(rows), TILE):
            r = rows[lo:lo + TILE]
            yield self.ids[r], self.labels[r], self.vectors[r]


def _matrix(column: pa.ListArray, width: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Integer vectors of the rows that take part, and their row numbers."""
    n = len(column)
    flat = column.flatten()
    sizes = column.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    x = np.floor(SCALE * flat.to_numpy(zero_copy_only=False).astype(np.float64))
    with np.errstate(invalid="ignore"):
        bad = ~(np.abs(x) <= limit)  # null (read as NaN), not finite, or too large
    owner = np.repeat(np.arange(n), sizes)
    use = column.is_valid().to_numpy(zero_copy_only=False).copy()
    use[owner[bad]] = False
    out = np.zeros((n, width), dtype=np.int64)
    fit = ~bad
    place = np.arange(len(x)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[owner[fit], place[fit]] = x[fit].astype(np.int64)
    keep = np.flatnonzero(use)
    return out[keep], keep


def _batches(batches: Iterator[pa.RecordBatch], width: int, limit: int) -> Iterator[Candidates]:
    for batch in batches:
        ids, labels = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
        vectors, keep = _matrix(batch.column(2), width, limit)
        if len(keep):
            yield Candidates(ids[keep].astype(np.int64), labels[keep].astype(np.int64), vectors)


def _own_label_heaps(anchors: dict, batches: Iterator[Candidates], size: int) -> Heaps:
    heaps = Heaps(len(anchors["id"]), size)
    of_label = {x: np.flatnonzero(anchors["label"] == x) for x in np.unique(anchors["label"])}
    for c in batches:
        for label, rows in of_label.items():
            for ids, _, vectors in c.tiles(np.flatnonzero(c.labels == label)):
                for lo in range(0, len(rows), TILE):
                    own = rows[lo:lo + TILE]
                    s = strassen(anchors["vector"][own], vectors.T)
                    s[anchors["id"][own][:, None] == ids[None, :]] = _NONE
                    heaps.merge(own, *_first(s, ids, size))
    return heaps


def _window_heaps(anchors: dict, batches: Iterator[Candidates], positives: int, size: int) -> Heaps:
    """Heaps of the windows ``low, high`` (anchors x positives; an empty window takes nothing)."""
    low, high = anchors["low"], anchors["high"]
    heaps = Heaps(low.size, size)
    for c in batches:
        for ids, labels, vectors in c.tiles():
            for lo in range(0, len(low), TILE):
                own = slice(lo, lo + TILE)
                s = strassen(anchors["vector"][own], vectors.T)
                s[anchors["label"][own][:, None] == labels[None, :]] = _NONE
                # Each row once in falling order (ties by id): a window is then a stretch of it.
                s, order = _falling(s)
                for j in range(positives):
                    begin = (s > high[own, j][:, None]).sum(axis=1)
                    at = begin[:, None] + np.arange(size)
                    inside = at < s.shape[1]
                    at = np.minimum(at, s.shape[1] - 1)
                    score = np.take_along_axis(s, at, axis=1)
                    inside &= score >= low[own, j][:, None]
                    rows = np.arange(lo, lo + len(s)) * positives + j
                    heaps.merge(rows, np.where(inside, score, _NONE), ids[np.take_along_axis(order, at, axis=1)])
    return heaps


def windows(score: np.ndarray, low: int = LOW, high: int = HIGH) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest whole score ``s`` with ``low * p <= 100 * s <= high * p``, in Python's whole numbers."""
    lo = [-(-low * int(p) // 100) for p in score]
    hi = [high * int(p) // 100 for p in score]
    return np.array(lo, dtype=np.int64), np.array(hi, dtype=np.int64)


def hard_negatives(vectors: DataFrame, anchor: str = "vec_id % 50 = 0", positives: int = POSITIVES,
                   negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
                   block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each anchor and each of its positives, the best negatives inside the positive's window:
    ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vectors`` has ``vec_id`` (integer), ``embedding`` (array of numbers) and ``label`` (integer)."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"),
                          F.col("embedding").cast("array<double>").alias("embedding")).where(
        "vec_id is not null and label is not null and embedding is not null")
    width = max(1, rows.agg(F.max(F.size("embedding"))).first()[0] or 0)  # one number
    limit = isqrt((2 ** 63 - 1) // width)
    fits = F.forall("embedding", lambda x: F.coalesce((x * SCALE >= -limit) & (x * SCALE < limit + 1), F.lit(False)))
    one = rows.where(anchor).where(fits).groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("_v"))
    numbered, total = positions_with_total(one.select("vec_id", "_v.label", "_v.embedding"), ["vec_id"], "_at")
    step = max(1, block_bytes // (8 * width))
    parts = [_block(rows, numbered.where(F.col("_at").between(lo, lo + step - 1)), width, limit,
                    positives, negatives, low, high) for lo in range(0, total, step)]
    if not parts:
        return vectors.sparkSession.createDataFrame([], RESULT)
    if len(parts) > 1:
        parts = [cut_lineage(p) for p in parts]
    return reduce(DataFrame.unionByName, parts)


RESULT = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, "
          "negative_score long")


def _heap_rows(rows: DataFrame, run_block, sent) -> DataFrame:
    """A task's heaps as rows ``_owner, score, id``."""
    schema = "_owner int, score long, id long"

    def run(batches):
        heaps = run_block(sent.value, batches)
        owner, place = np.nonzero(heaps.score != _NONE)
        if len(owner):
            yield pa.RecordBatch.from_arrays([pa.array(owner.astype(np.int32)), pa.array(heaps.score[owner, place]),
                                              pa.array(heaps.id[owner, place])], names=["_owner", "score", "id"])

    return rows.mapInArrow(run, schema)


def _merged(heaps: DataFrame, size: int) -> DataFrame:
    """Heaps of the same owner as one: ``_owner, rank (from 1), score, id``. A task brings at most ``size``
    rows for an owner."""
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("_neg"), "id"))), 1, size)
    return (heaps.groupBy("_owner").agg(best.alias("_best")).select("_owner", F.posexplode("_best").alias("rank", "_b"))
                 .select("_owner", (F.col("rank") + 1).alias("rank"), (-F.col("_b._neg")).alias("score"), "_b.id"))


def _block(rows: DataFrame, anchors: DataFrame, width: int, limit: int, positives: int, negatives: int,
           low: int, high: int) -> DataFrame:
    sc = rows.sparkSession.sparkContext
    table = anchors.orderBy("vec_id").select("vec_id", "label", "embedding").toArrow()  # BLOCK_BYTES at most
    lists = table.column("embedding").combine_chunks()
    vector, _ = _matrix(lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists, width, limit)
    sent = {"id": table.column("vec_id").to_numpy(), "label": table.column("label").to_numpy(), "vector": vector}
    n = len(sent["id"])

    heaps = _heap_rows(rows, lambda a, b: _own_label_heaps(a, _batches(b, width, limit), positives), sc.broadcast(sent))
    found = _merged(heaps, positives).collect()  # at most ``positives`` rows for each anchor of the block
    lo, hi = np.ones((n, positives), dtype=np.int64), np.zeros((n, positives), dtype=np.int64)
    owner, place = (np.array([r[k] for r in found], dtype=np.int64) for k in ("_owner", "rank"))
    score, ids = (np.array([r[k] for r in found], dtype=np.int64) for k in ("score", "id"))
    lo[owner, place - 1], hi[owner, place - 1] = windows(score, low, high)
    sent = {**sent, "low": lo, "high": hi}
    heaps = _heap_rows(rows, lambda a, b: _window_heaps(a, _batches(b, width, limit), positives, negatives),
                       sc.broadcast(sent))
    key = pa.table({"_owner": pa.array((owner * positives + place - 1).astype(np.int32)),
                    "anchor_id": sent["id"][owner] if len(owner) else pa.array([], pa.int64()),
                    "positive_id": ids, "positive_score": score})
    known = rows.sparkSession.createDataFrame(key)
    return (_merged(heaps, negatives).join(known, "_owner")
            .select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
                    F.col("score").alias("negative_score")))


def relabel(vectors: DataFrame, every: int = 7, labels: int = 10) -> DataFrame:
    """``label`` moved on by one (modulo ``labels``) where ``vec_id`` is divisible by ``every``."""
    moved = F.pmod(F.col("vec_id"), F.lit(every)) == 0
    return vectors.withColumn("label", F.when(moved, F.pmod(F.col("label") + 1, F.lit(labels))).otherwise(F.col("label")))
