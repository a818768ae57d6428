"""Forests whose trees are finished where their rows meet (after PLANET, Panda et al., VLDB 2009).

A table is held as blocks: one row of at most ``BLOCK_ROWS`` rows' keys and numbers as arrays. Any number of
forests (``Fit``) are grown and applied in one go; each has its own target, predictors, training rows, rows to
predict and settings.

1. *Top*: while a node of a tree holds more than ``local_rows`` rows, all such nodes are split together. Each
   task adds up the histograms of its blocks' rows (node x predictor x bin x statistic), partial sums are
   combined by Spark, and the best split of a node is chosen from its sum. The driver holds the splits of
   such nodes only: at most ``trees * rows / local_rows`` of them.
2. *Bottom*: the rows of the other nodes, as bin codes, travel to one group for each tree and node, at most
   about ``local_rows`` rows each (where no tree has a top, some trees of a fit share a group). The group grows the rest of the tree from the same histograms and at
   once predicts the rows that ask for it. No tree is put together anywhere, no model passes the driver,
   and trees as deep as the rows allow cost no further pass over the data.
3. The trees' answers are added up for each block: means (regression) or class shares (classification).

A forest that is kept (``fit_trees``) writes each group's subtrees as one row of arrays instead; ``answer`` sends
other rows to the groups of their nodes, where the subtrees are read in a stream before the rows. The driver holds
the splits of the top only, as above.

Bootstrap weights are Poisson(1) numbers drawn from a hash of row key, fit, tree and seed; the predictors
that a split may use are drawn from a hash of fit, tree and node. So results depend, but for the rounding
of sums and given the bins' borders, neither on the partitioning nor on lost and repeated tasks. Predictors are cut into at most ``max_bins`` bins; a null (NaN)
predictor is in the lowest. A split must lower the weighted variance or Gini impurity.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

BLOCK_ROWS = 16_384
LOCAL_ROWS = 500_000
MAX_BINS = 64


@dataclass(frozen=True)
class Fit:
    """One forest. ``target`` and ``predictors`` are column numbers. Rows are learned from where the mask
    column ``mask`` is not in ``held``, and predicted where it is (``everyone``: all rows are predicted).
    ``classes`` = 0 is regression."""
    target: int
    predictors: tuple[int, ...]
    mask: int
    held: tuple[float, ...] = (1.0,)
    classes: int = 0
    trees: int = 100
    depth: int = 30
    min_leaf: int = 1
    min_split: int = 2
    candidates: int = 0  # predictors that a split may use; 0: all (regression) or the root of their number
    bootstrap: bool = True
    weights: tuple[float, ...] = ()  # of the classes
    seed: int = 0
    everyone: bool = False

    def draws(self) -> int:
        n = len(self.predictors)
        return self.candidates or (max(1, int(np.sqrt(n))) if self.classes else n)


def _schema(text: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    return to_arrow_schema(_parse_datatype_string(text))


BLOCKS = "block long, keys binary, x binary"


def to_blocks(df: DataFrame, key: str, columns: list[str], rows: int = BLOCK_ROWS) -> DataFrame:
    """``block, keys, x``: long keys and the columns as doubles (null: NaN), column after column."""
    schema = _schema(BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                keys = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                x = np.concatenate([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in part.columns[1:]])
                yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([keys.tobytes()]), pa.array([x.tobytes()])],
                                                 schema=schema)
                at += 1

    numbers = [F.col(c).cast("double").alias(c) for c in columns]
    return df.select(F.col(key).cast("long"), *numbers).mapInArrow(run, BLOCKS)


def from_blocks(blocks: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The rows of blocks again, columns as doubles (NaN: null)."""
    text = f"`{key}` long, " + ", ".join(f"`{c}` double" for c in columns)
    schema = _schema(text)

    def run(batches):
        for batch in batches:
            for keys, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys, x = np.frombuffer(keys, dtype=np.int64), _matrix(x, len(columns))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), *[pa.array(c, from_pandas=True) for c in x]], schema=schema)

    return blocks.select("keys", "x").mapInArrow(run, text)


def _matrix(data: bytes, columns: int) -> np.ndarray:
    return np.frombuffer(data, dtype=np.float64).reshape(columns, -1)


def bin_borders(df: DataFrame, columns: list[str], max_bins: int = MAX_BINS) -> list[np.ndarray]:
    """Borders of each column's bins: half way between its values if they are few, else approximate quantiles."""
    numbers = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    shares = [k / max_bins for k in range(max_bins + 1)]
    out = []
    for values in numbers.approxQuantile(columns, shares, 1 / (4 * max_bins)):  # max_bins + 1 numbers a column
        v = np.unique(np.array(values, dtype=np.float64))
        v = v[~np.isnan(v)]
        out.append((v[:-1] + v[1:]) / 2 if len(v) <= max_bins // 2 else v[1:])
    return out


def _codes(x: np.ndarray, borders: np.ndarray, kind: np.dtype) -> np.ndarray:
    out = np.searchsorted(borders, x, side="left").astype(kind)
    out[np.isnan(x)] = 0
    return out


def _kind(borders: list[np.ndarray]) -> np.dtype:
    return np.dtype(np.uint8 if max(map(len, borders), default=0) < 256 else np.uint16)


def _mix(a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray:
    """A hash of 64-bit numbers (the finaliser of splitmix64)."""
    step = np.uint64(0x9E3779B97F4A7C15)
    b = np.asarray(b % 2 ** 64 if isinstance(b, int) else b, dtype=np.uint64)
    with np.errstate(over="ignore"):
        z = np.asarray(a, dtype=np.uint64) + b * step + step
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


_POISSON = np.cumsum([np.exp(-1.0) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320)])


def _bag(keys: np.ndarray, fit: int, tree: int, seed: int) -> np.ndarray:
    """How often each row is in a tree's bag."""
    unit = (_mix(_mix(keys.view(np.uint64), fit * 1_000_003 + tree), seed) >> np.uint64(11)) / 2.0 ** 53
    return np.searchsorted(_POISSON, unit).astype(np.float64)


def _order(fit: Fit, number: int, trees: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """In which order each node tries the predictors (nodes x predictors): it stops after ``fit.draws()`` of
    them if one can split it, else at the first one that can."""
    n = len(fit.predictors)
    if fit.draws() >= n:
        return np.broadcast_to(np.arange(n), (len(nodes), n))
    base = _mix(_mix(nodes, np.uint64(number * 1_000_003) + trees.astype(np.uint64)), fit.seed + 7)
    return np.argsort(np.stack([_mix(base, k) for k in range(n)], axis=1), axis=1, kind="stable")


def _stats(fit: Fit, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Statistics of rows: (y, y^2) or a weight for each class, times the weight in the bag; last that weight."""
    own = np.zeros((len(y), fit.classes + 1 if fit.classes else 3))
    if fit.classes:
        k = y.astype(np.int64)
        own[np.arange(len(y)), k] = w * (np.array(fit.weights)[k] if fit.weights else 1.0)
    else:
        own[:, 0], own[:, 1] = w * y, w * y * y
    own[:, -1] = w
    return own


def _impurity(fit: Fit, s: np.ndarray) -> np.ndarray:
    """Weighted impurity of summed statistics (last axis): n times Gini or variance."""
    if fit.classes:
        total = s[..., :-1].sum(-1)
        return total - (s[..., :-1] ** 2).sum(-1) / np.where(total > 0, total, 1)
    return s[..., 1] - s[..., 0] ** 2 / np.where(s[..., 2] > 0, s[..., 2], 1)


def _worth(gain: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Is a gain more than what rounding may feign?"""
    return gain > 1e-12 * np.maximum(1, np.abs(whole).max(axis=-1))


def _gains(fit: Fit, left: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Loss of impurity of splits with these sums on the left; -inf where a side is too small."""
    right = whole - left
    gain = _impurity(fit, whole) - _impurity(fit, left) - _impurity(fit, right)
    least = max(fit.min_leaf, 1)
    return np.where((left[..., -1] < least) | (right[..., -1] < least), -np.inf, gain)


def histogram_split(fit: Fit, number: int, tree: int, node: int, hist: np.ndarray) -> tuple[int, int]:
    """Best predictor and bin (rows up to it go left; -1: a leaf) of a node from its histogram ``(predictors,
    bins, statistics)``; of equal splits the first tried."""
    left = np.cumsum(hist, axis=1)
    whole = left[0, -1]
    if whole[-1] < fit.min_split:
        return -1, 0
    gain = _gains(fit, left, whole)
    best, found, cut = -np.inf, -1, 0
    for k, p in enumerate(_order(fit, number, np.array([tree]), np.array([node], dtype=np.uint64))[0]):
        if k >= fit.draws() and found >= 0:
            break
        at = int(gain[p].argmax())
        if gain[p, at] > best:
            best, found, cut = gain[p, at], int(p), at
    return (found, cut) if found >= 0 and _worth(best, whole) else (-1, 0)


def _best_cuts(fit: Fit, own: np.ndarray, code: np.ndarray, stats: np.ndarray, whole: np.ndarray, bins: int) -> tuple:
    """Best gain and cut of each node by one predictor; ``own`` and ``code`` are the rows' nodes and bins."""
    n, k = len(whole), stats.shape[1]
    key = own * bins + code
    if n * bins <= 4 * len(own) + 1024:
        hist = np.stack([np.bincount(key, weights=c, minlength=n * bins) for c in stats.T], axis=1).reshape(n, bins, k)
        gain = _gains(fit, np.cumsum(hist, axis=1), whole[:, None, :])
        cut = gain.argmax(axis=1)
        return gain[np.arange(n), cut], cut
    # Many small nodes: costs by rows, not by bins.
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sums = np.cumsum(np.add.reduceat(stats[order], first, axis=0), axis=0)
    node, code = key[first] // bins, key[first] % bins
    starts = np.searchsorted(node, np.arange(n))
    before = np.concatenate([np.zeros((1, k)), sums])[starts]
    gain = _gains(fit, sums - before[node], whole[node])
    best, cut = np.full(n, -np.inf), np.zeros(n, dtype=np.int64)
    here = np.unique(node)
    best[here] = np.maximum.reduceat(gain, starts[here])
    top = np.flatnonzero(gain == best[node])
    cut[here] = code[top[np.searchsorted(node[top], here)]]
    return best, cut


def _splits(fit: Fit, number: int, trees: np.ndarray, nodes: np.ndarray, own: np.ndarray, rows: np.ndarray,
            codes: np.ndarray, stats: np.ndarray, bins: int) -> tuple:
    """Predictor (-1: a leaf), cut and sums of each node of a level; ``rows`` are the live rows, ``own`` their
    nodes."""
    n = len(nodes)
    whole = np.stack([np.bincount(own, weights=c, minlength=n) for c in stats.T], axis=1)
    tried = _order(fit, number, trees, nodes)
    best, predictor, cut = np.full(n, -np.inf), np.full(n, -1), np.zeros(n, dtype=np.int64)
    open_ = (whole[:, -1] >= fit.min_split) & _worth(_impurity(fit, whole), whole)
    for slot in range(len(fit.predictors)):
        if slot >= fit.draws():
            open_ &= predictor < 0
        if not open_.any():
            break
        if open_.all():
            which, o, s, r = slice(None), own, stats, rows
        else:
            which = np.flatnonzero(open_)
            use = open_[own]
            o, s, r = (np.cumsum(open_) - 1)[own[use]], stats[use], rows[use]
        gain, at = _best_cuts(fit, o, codes[tried[which, slot][o], r].astype(np.int64), s, whole[which], bins)
        better = gain > best[which]
        name = np.arange(n)[which][better]
        best[name], cut[name], predictor[name] = gain[better], at[better], tried[name, slot]
    return np.where(_worth(best, whole), predictor, -1), cut, whole


def _histogram(codes: np.ndarray, place: np.ndarray, n: int, bins: int, stats: np.ndarray) -> np.ndarray:
    """Summed statistics ``(nodes, predictors, bins, statistics)``; ``place`` is each row's node."""
    out = np.empty((n, len(codes), bins, stats.shape[1]))
    for p, code in enumerate(codes):
        at = place * bins + code
        for k in range(stats.shape[1]):
            out[:, p, :, k] = np.bincount(at, weights=stats[:, k], minlength=n * bins).reshape(n, bins)
    return out


def _distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct columns of ``codes``, and which of them each column is."""
    key = np.zeros(codes.shape[1], dtype=np.int64)
    for c in codes:
        names, own = np.unique(c, return_inverse=True)
        key, _ = np.unique(key * len(names) + own, return_inverse=True)[::-1]
    _, first, place = np.unique(key, return_index=True, return_inverse=True)
    return codes[:, first], place


#: Rows of all trees that are grown together.
TOGETHER = 200_000


def grow_and_predict(fit: Fit, number: int, trees: range, root: int, codes: np.ndarray, y: np.ndarray,
                     keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Grow the subtrees of node ``root`` (1 is a tree's root, 2n and 2n+1 are children) of some trees from
    rows' bin codes (predictors x rows), targets and keys, and return the answers of the rows ``asked``
    (predictors x rows), added up over the trees: a mean, or a share for each class.

    Rows of equal codes go one way: they are one row, found once for all trees. Small trees are grown
    together, level by level."""
    asked, back = _distinct(asked)
    total = np.zeros((asked.shape[1], max(1, fit.classes)))
    for some, codes, stats in _together(fit, number, trees, codes, y, keys, asked.shape[1]):
        total += _grow(fit, number, np.array(some), root, codes, stats, asked)
    return total[back]


def _together(fit: Fit, number: int, trees: range, codes: np.ndarray, y: np.ndarray, keys: np.ndarray,
              asked: int) -> Iterator[tuple[range, np.ndarray, np.ndarray]]:
    """Trees that are grown together, the distinct codes and their statistics (trees, rows, statistics)."""
    codes, place = _distinct(codes)
    step = max(1, TOGETHER // max(1, codes.shape[1], asked))
    for lo in range(trees.start, trees.stop, step):
        some = range(lo, min(trees.stop, lo + step))
        stats = []
        for tree in some:
            w = _bag(keys, number, tree, fit.seed) if fit.bootstrap else np.ones(len(keys))
            stats.append(np.stack([np.bincount(place, weights=c, minlength=codes.shape[1]) for c in _stats(fit, y, w).T], axis=1))
        yield some, codes, np.stack(stats)


def _grow(fit: Fit, number: int, trees: np.ndarray, root: int, codes: np.ndarray, stats: np.ndarray,
          asked: np.ndarray, record: list | None = None) -> np.ndarray:
    """Answers of some trees, added up; ``stats`` is (trees, rows, statistics). ``record`` takes, level by level,
    the nodes' trees (by place), predictors (-1: a leaf), cuts, values and impurities."""
    level, t, (m, q) = root.bit_length() - 1, len(trees), (codes.shape[1], asked.shape[1])
    bins = int(codes.max(initial=0)) + 1
    answers = np.zeros((t * q, max(1, fit.classes)))
    # A row of a tree is a row number and its tree; nodes of all trees are numbered together.
    used = np.flatnonzero(stats[:, :, -1].reshape(-1) > 0)
    own, rows, stats = used // max(1, m), used % max(1, m), stats.reshape(t * m, -1)[used]
    want, where = np.arange(t * q), np.repeat(np.arange(t), q)
    names, tree_of = np.full(t, root, dtype=np.uint64), trees
    while len(names):
        predictor, cut, total = _splits(fit, number, tree_of, names, own, rows, codes, stats, bins)
        if level >= fit.depth:
            predictor[:] = -1
        leaf = predictor < 0
        weight = total[:, :-1].sum(1, keepdims=True) if fit.classes else total[:, 2:]
        value = total[:, :max(1, fit.classes)] / np.where(weight > 0, weight, 1)
        if record is not None:
            record.append((np.searchsorted(trees, tree_of), predictor, cut, value, _impurity(fit, total)))
        done = leaf[where]
        answers[want[done]] = value[where[done]]
        index = np.cumsum(~leaf) - 1  # of the nodes that go on
        stay = ~leaf[own]
        own, rows, stats = own[stay], rows[stay], stats[stay]
        own = 2 * index[own] + (codes[predictor[own], rows] > cut[own])
        want, where = want[~done], where[~done]
        where = 2 * index[where] + (asked[predictor[where], want % max(1, q)] > cut[where])
        # Only their hash is used, so it does not matter that numbers outgrow 64 bits in very deep trees.
        on = names[~leaf] << np.uint64(1)
        names, tree_of = np.stack([on, on | np.uint64(1)], axis=1).reshape(-1), np.repeat(tree_of[~leaf], 2)
        level += 1
    return answers.reshape(t, q, answers.shape[1]).sum(axis=0)


@dataclass(frozen=True)
class Trees:
    """Subtrees as arrays: ``child`` is the left child (the right one follows), the first ``len(gains)`` nodes are the
    roots. ``gains``: loss of impurity by tree and predictor."""
    predictor: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    value: np.ndarray
    gains: np.ndarray

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, self.predictor.astype(np.int16), self.cut.astype(np.uint16), self.child.astype(np.int32),
                 self.value, self.gains)
        return out.getvalue()

    @staticmethod
    def load(data: bytes) -> Trees:
        found = np.load(io.BytesIO(data))
        return Trees(*(found[f"arr_{k}"] for k in range(5)))

    def answers(self, asked: np.ndarray) -> np.ndarray:
        """Answers of rows (predictors x rows), added up over the trees."""
        asked, back = _distinct(asked)
        total = np.zeros((asked.shape[1], self.value.shape[1]))
        for tree in range(len(self.gains)):
            at = np.full(asked.shape[1], tree)
            open_ = np.flatnonzero(self.predictor[at] >= 0)
            while len(open_):
                node = at[open_]
                at[open_] = self.child[node] + (asked[self.predictor[node], open_] > self.cut[node])
                open_ = open_[self.predictor[at[open_]] >= 0]
            total += self.value[at]
        return total[back]


def grow_trees(fit: Fit, number: int, trees: range, root: int, codes: np.ndarray, y: np.ndarray,
               keys: np.ndarray) -> Iterator[tuple[int, Trees]]:
    """The subtrees that ``grow_and_predict`` grows, to be kept: the first tree's number and some trees."""
    nobody = codes[:, :0]
    for some, own, stats in _together(fit, number, trees, codes, y, keys, 0):
        record: list = []
        _grow(fit, number, np.array(some), root, own, stats, nobody, record)
        tree, predictor, cut, value, impurity = (np.concatenate(c) for c in zip(*record))
        inner = np.flatnonzero(predictor >= 0)
        child = np.zeros(len(predictor), dtype=np.int64)
        child[inner] = len(some) + 2 * np.arange(len(inner))  # levels follow each other, children in their parents' order
        loss = impurity[inner] - impurity[child[inner]] - impurity[child[inner] + 1]
        width = len(fit.predictors)
        gains = np.bincount(tree[inner] * width + predictor[inner], loss, len(some) * width).reshape(len(some), width)
        yield some.start, Trees(predictor, cut, child, value, gains)


@dataclass
class _Top:
    """Splits of the large nodes: (fit, tree) -> node -> (predictor, bin); nodes without one are open.
    ``gains``: (fit, tree, predictor, loss of impurity) of each split."""
    splits: dict = field(default_factory=dict)
    gains: list = field(default_factory=list)

    def route(self, key: tuple[int, int], codes: np.ndarray) -> np.ndarray:
        node = np.ones(codes.shape[1], dtype=np.int64)
        own = self.splits.get(key)
        if not own:
            return node
        open_ = np.arange(len(node))
        while len(open_):
            at = node[open_]
            names, place = np.unique(at, return_inverse=True)
            has = np.array([n in own for n in names.tolist()])
            rule = np.array([own.get(n, (0, 0)) for n in names.tolist()])
            go = has[place]
            open_, place = open_[go], place[go]
            node[open_] = 2 * node[open_] + (codes[rule[place, 0], open_] > rule[place, 1])
        return node


def _prepared(fits: list[Fit], borders: list[np.ndarray], x: np.ndarray):
    """Codes of all columns that some fit reads, once for each block."""
    used = sorted({p for f in fits for p in f.predictors})
    return {p: _codes(x[p], borders[p], _kind(borders)) for p in used}


def _pack(codes: np.ndarray, y: np.ndarray, keys: np.ndarray) -> bytes:
    return codes.tobytes() + y.tobytes() + keys.tobytes()


def _unpack(data: bytes, predictors: int, kind: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(data) // (kind.itemsize * predictors + 16)
    codes = np.frombuffer(data, dtype=kind, count=n * predictors).reshape(predictors, n)
    y = np.frombuffer(data, dtype=np.float64, count=n, offset=codes.nbytes)
    return codes, y, np.frombuffer(data, dtype=np.int64, count=n, offset=codes.nbytes + 8 * n)


TRAVEL = "fit int, tree int, node long, block long, learn binary, ask binary, rows binary"
ANSWER = "block long, fit int, tree int, node long, rows binary, answers binary"


def _tasks(df: DataFrame) -> int:
    """Few bytes, much work: the planner would put the groups into very few tasks."""
    return 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _batch_trees(fits: list[Fit], tasks: int) -> int:
    """Trees without a top read the same rows: so many of them share a group, and its rows travel once."""
    return -(-sum(f.trees for f in fits) // (4 * tasks))


def _dealt(blocks: DataFrame, columns: int, sent, routes, batch_trees: int, learning: bool = True,
           asking: bool = True) -> DataFrame:
    """Rows to learn from and rows that ask, on their way to the group of their tree and node."""
    travel_schema = _schema(TRAVEL)

    def deal(batches):
        fits, borders = sent.value
        for batch in batches:
            for block, keys, x in zip(*(c.to_pylist() for c in batch.columns)):
                keys, x = np.frombuffer(keys, dtype=np.int64), _matrix(x, columns)
                coded = _prepared(fits, borders, x)
                for number, f in enumerate(fits):
                    codes = np.stack([coded[p] for p in f.predictors])
                    y = x[f.target] if learning else np.zeros(0)
                    held = np.isin(x[f.mask], f.held)
                    learn = (np.flatnonzero(~held & ~np.isnan(y) & ~np.isnan(x[f.mask])) if learning
                             else np.zeros(0, dtype=np.int64))
                    asked = np.arange(len(keys)) if f.everyone else np.flatnonzero(held)
                    asked = asked if asking else asked[:0]
                    whole = [(number, lo, 1, block, _pack(codes[:, learn], y[learn], keys[learn]), codes[:, asked].tobytes(),
                              asked.astype(np.int32).tobytes()) for lo in range(0, f.trees, batch_trees)
                             if not routes.value.splits]
                    for row in whole:
                        yield _arrow([row], travel_schema)
                    for tree in range(f.trees if routes.value.splits else 0):
                        w = _bag(keys[learn], number, tree, f.seed) if f.bootstrap else np.ones(len(learn))
                        rows = learn[w > 0]
                        node, at = (routes.value.route((number, tree), codes[:, r]) for r in (rows, asked))
                        out = []
                        for name in np.union1d(node, at).tolist():
                            r, a = rows[node == name], asked[at == name]
                            out.append((number, tree, name, block, _pack(codes[:, r], y[r], keys[r]), codes[:, a].tobytes(),
                                        a.astype(np.int32).tobytes()))
                        yield _arrow(out, travel_schema)

    return blocks.mapInArrow(deal, TRAVEL)


def _group(table: pa.Table, sent, routes, batch_trees: int):
    """A group's travelling rows in the order of their blocks, its forest, trees and rows to learn from."""
    rows = sorted(table.to_pylist(), key=lambda r: r["block"])
    number, tree = rows[0]["fit"], rows[0]["tree"]
    f = sent.value[0][number]
    parts = [_unpack(r["learn"], len(f.predictors), _kind(sent.value[1])) for r in rows]
    codes = np.concatenate([c for c, _, _ in parts], axis=1)
    y, keys = (np.concatenate([part[k] for part in parts]) for k in (1, 2))
    trees = range(tree, tree + 1 if routes.value.splits else min(f.trees, tree + batch_trees))
    return rows, f, trees, codes, y, keys


def _added_up(answers: DataFrame, sent) -> DataFrame:
    """``block, fit, rows, answers``: the mean over the trees of a fit."""
    total = "block long, fit int, rows binary, answers binary"
    total_schema = _schema(total)

    def add_up(table: pa.Table) -> pa.Table:
        block, number = table.column("block")[0].as_py(), table.column("fit")[0].as_py()
        f = sent.value[0][number]
        width = max(1, f.classes)
        places, values = [], []
        # In the order of the trees: sums of floats depend on it.
        for r in table.sort_by([("tree", "ascending"), ("node", "ascending")]).to_pylist():
            places.append(np.frombuffer(r["rows"], dtype=np.int32))
            values.append(np.frombuffer(r["answers"], dtype=np.float64).reshape(-1, width))
        at, values = np.concatenate(places), np.concatenate(values)
        names, place = np.unique(at, return_inverse=True)
        out = np.stack([np.bincount(place, weights=values[:, k]) for k in range(width)], axis=1) / f.trees
        return pa.Table.from_batches([_arrow([(block, number, names.astype(np.int32).tobytes(), out.tobytes())],
                                             total_schema)], schema=total_schema)

    return answers.groupBy("block", "fit").applyInArrow(add_up, total)


def fit_predict(blocks: DataFrame, columns: int, borders: list[np.ndarray], fits: list[Fit],
                local_rows: int = LOCAL_ROWS) -> DataFrame:
    """``block, fit, rows, answers``: per block and fit, the numbers (in the block) of the rows that were asked
    for and, row by row, their answers: a mean, or a share for each class."""
    sc = blocks.sparkSession.sparkContext
    bins = max([len(b) for b in borders] + [0]) + 1
    sent = sc.broadcast((fits, borders))  # settings and at most ``max_bins`` borders a column
    top = _grow_top(blocks, columns, bins, sent, local_rows)
    routes = sc.broadcast(top)  # the splits of nodes of more than ``local_rows`` rows
    tasks = _tasks(blocks)
    batch_trees = _batch_trees(fits, tasks)
    answer_schema = _schema(ANSWER)

    def grow(table: pa.Table) -> pa.Table:
        rows, f, trees, codes, y, keys = _group(table, sent, routes, batch_trees)
        number, tree, node = rows[0]["fit"], rows[0]["tree"], rows[0]["node"]
        asked = [np.frombuffer(r["ask"], dtype=_kind(sent.value[1])).reshape(len(f.predictors), -1) for r in rows]
        got = grow_and_predict(f, number, trees, node, codes, y, keys, np.concatenate(asked, axis=1))
        ends = np.cumsum([0, *(a.shape[1] for a in asked)])
        return pa.Table.from_batches([_arrow(
            [(r["block"], number, tree, node, r["rows"], got[lo:hi].tobytes()) for r, lo, hi in zip(rows, ends, ends[1:])
             if hi > lo], answer_schema)], schema=answer_schema)

    return _added_up(_dealt(blocks, columns, sent, routes, batch_trees).repartition(tasks, "fit", "tree", "node")
                     .groupBy("fit", "tree", "node").applyInArrow(grow, ANSWER), sent)


TREES = "tree int, node long, first int, trees binary"


def fit_trees(blocks: DataFrame, columns: int, borders: list[np.ndarray], fit: Fit,
              local_rows: int = LOCAL_ROWS) -> tuple[DataFrame, _Top, int]:
    """One forest to be kept: ``tree, node, first, trees`` (a group's ``Trees`` in parts, and the number of a part's first
    tree), the splits above them, and how many trees a group has at most."""
    sc = blocks.sparkSession.sparkContext
    bins = max([len(b) for b in borders] + [0]) + 1
    sent = sc.broadcast(([fit], borders))
    top = _grow_top(blocks, columns, bins, sent, local_rows)
    routes = sc.broadcast(top)
    tasks = _tasks(blocks)
    batch_trees = _batch_trees([fit], tasks)
    schema = _schema(TREES)

    def grow(table: pa.Table) -> pa.Table:
        rows, f, trees, codes, y, keys = _group(table, sent, routes, batch_trees)
        own = grow_trees(f, 0, trees, rows[0]["node"], codes, y, keys)
        return pa.Table.from_batches([_arrow([(rows[0]["tree"], rows[0]["node"], first, t.dump()) for first, t in own],
                                             schema)], schema=schema)

    return (_dealt(blocks, columns, sent, routes, batch_trees, asking=False).repartition(tasks, "fit", "tree", "node")
            .groupBy("fit", "tree", "node").applyInArrow(grow, TREES), top, batch_trees)


def answer(blocks: DataFrame, columns: int, borders: list[np.ndarray], fit: Fit, trees: DataFrame, top: _Top,
           batch_trees: int) -> DataFrame:
    """``block, fit, rows, answers`` of all rows by the trees of ``fit_trees``. In a task the trees of a group come
    before the blocks of rows that ask for them, which then pass one by one."""
    sc = blocks.sparkSession.sparkContext
    sent, routes = sc.broadcast(([replace(fit, everyone=True)], borders)), sc.broadcast(top)
    tasks, schema = _tasks(blocks), _schema(ANSWER)
    kind, width = _kind(borders), len(fit.predictors)

    def run(batches):
        at, own = None, []
        for batch in batches:
            for tree, node, block, k, data, rows in zip(*(c.to_pylist() for c in batch.columns)):
                if (tree, node) != at:
                    at, own = (tree, node), []
                if block is None:
                    own.append(Trees.load(data))
                elif rows and own:
                    asked = np.frombuffer(data, dtype=kind).reshape(width, -1)
                    yield _arrow([(block, 0, tree, node, rows, sum(t.answers(asked) for t in own).tobytes())], schema)

    none = F.lit(None)
    kept = trees.select("tree", "node", none.cast("long").alias("block"), F.col("first").cast("long").alias("k"),
                        F.col("trees").alias("data"), none.cast("binary").alias("rows"))
    asks = (_dealt(blocks, columns, sent, routes, batch_trees, learning=False)
            .select("tree", "node", "block", F.lit(0).cast("long").alias("k"), F.col("ask").alias("data"), "rows"))
    order = ["tree", "node", F.col("block").asc_nulls_first(), "k"]
    return _added_up(kept.unionByName(asks).repartition(tasks, "tree", "node").sortWithinPartitions(*order)
                     .mapInArrow(run, ANSWER), sent)


def gains(trees: DataFrame, top: _Top) -> DataFrame:
    """``tree, predictor, gain``: loss of impurity by all splits of a tree that use a predictor."""
    text = "tree int, predictor int, gain double"
    schema = _schema(text)

    def run(batches):
        for batch in batches:
            for first, data in zip(*(c.to_pylist() for c in batch.columns)):
                own = Trees.load(data).gains
                tree, predictor = np.indices(own.shape)
                yield pa.RecordBatch.from_arrays([pa.array((tree.reshape(-1) + first).astype(np.int32)),
                                                  pa.array(predictor.reshape(-1).astype(np.int32)),
                                                  pa.array(own.reshape(-1))], schema=schema)

    found = trees.select("first", "trees").mapInArrow(run, text)
    above = [(t, p, g) for _, t, p, g in top.gains]  # one row for each split of the top
    if above:
        found = found.unionByName(trees.sparkSession.createDataFrame(above, text))
    return found.groupBy("tree", "predictor").agg(F.sum("gain").alias("gain"))


def _arrow(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(columns, schema)], schema=schema)


def _grow_top(blocks: DataFrame, columns: int, bins: int, sent, local_rows: int) -> _Top:
    """Splits of all nodes that hold more than ``local_rows`` rows of a bag, level by level."""
    fits, top = sent.value[0], _Top()
    sizes = blocks.select(F.sum(F.octet_length("keys") / 8)).first()[0] or 0  # one number
    if sizes <= local_rows:
        return top
    open_ = {(k, t): {1} for k, f in enumerate(fits) for t in range(f.trees)}
    sc = blocks.sparkSession.sparkContext
    part = "fit int, tree int, node long, hist binary"
    part_schema = _schema(part)
    while open_:
        routes = sc.broadcast((top, open_))

        def count(batches, routes=routes):
            (fits, borders), (top, open_) = sent.value, routes.value
            sums: dict[tuple, np.ndarray] = {}
            for batch in batches:
                for _, keys, x in zip(*(c.to_pylist() for c in batch.columns)):
                    keys, x = np.frombuffer(keys, dtype=np.int64), _matrix(x, columns)
                    coded = _prepared(fits, borders, x)
                    for (number, tree), nodes in open_.items():
                        f = fits[number]
                        codes, y = np.stack([coded[p] for p in f.predictors]), x[f.target]
                        use = ~np.isin(x[f.mask], f.held) & ~np.isnan(y) & ~np.isnan(x[f.mask])
                        w = _bag(keys, number, tree, f.seed) if f.bootstrap else np.ones(len(keys))
                        rows = np.flatnonzero(use & (w > 0))
                        at = top.route((number, tree), codes[:, rows])
                        for name in nodes:
                            r = rows[at == name]
                            h = _histogram(codes[:, r], np.zeros(len(r), dtype=np.int64), 1, bins, _stats(f, y[r], w[r]))
                            key = (number, tree, name)
                            sums[key] = sums[key] + h if key in sums else h
            for lo in range(0, len(sums), 64):
                yield _arrow([(*k, h.tobytes()) for k, h in list(sums.items())[lo:lo + 64]], part_schema)

        choice = "fit int, tree int, node long, n double, predictor long, cut long, left double, gain double"
        choice_schema = _schema(choice)

        def choose(table: pa.Table) -> pa.Table:
            rows = table.to_pylist()
            number, tree, node = rows[0]["fit"], rows[0]["tree"], rows[0]["node"]
            f = sent.value[0][number]
            shape = (1, len(f.predictors), bins, f.classes + 1 if f.classes else 3)
            hist = sum(np.frombuffer(r["hist"]).reshape(shape) for r in rows)
            p, cut = histogram_split(f, number, tree, node, hist[0])
            left = float(hist[0, p, :cut + 1, -1].sum())
            gain = float(_gains(f, hist[0, p, :cut + 1].sum(axis=0), hist[0, p].sum(axis=0)))
            return pa.Table.from_batches([_arrow([(number, tree, node, float(hist[0, 0, :, -1].sum()), p, cut, left, gain)],
                                                 choice_schema)], schema=choice_schema)

        found = blocks.mapInArrow(count, part).groupBy("fit", "tree", "node").applyInArrow(choose, choice).collect()
        open_ = {}
        for r in found:  # one row for each large node
            if r.n > local_rows and r.predictor >= 0 and r.node.bit_length() <= fits[r.fit].depth:
                top.splits.setdefault((r.fit, r.tree), {})[r.node] = (r.predictor, r.cut)
                top.gains.append((r.fit, r.tree, r.predictor, r.gain))
                for child, size in ((2 * r.node, r.left), (2 * r.node + 1, r.n - r.left)):
                    if size > local_rows:
                        open_.setdefault((r.fit, r.tree), set()).add(child)
    return top
