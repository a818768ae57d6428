"""Quality classifier: hashed word n-gram logistic regression, FTRL-proximal updates.

Features: tokens are runs of letters and digits (any non-ASCII character counts as a letter) or runs
of other signs, case kept. Two sequences are read: the tokens, and their shapes (case, digits, signs,
or how many tokens back the same token stood). The 1- to ``ngrams``-grams of both are hashed into
``2**bits`` buckets; an n-gram's value is the square root of its share, so every sequence and n has
length 1. No other column is an input.

Training: a bounded, hash-chosen sample of at most about ``max_train`` labelled documents (the bound
is a parameter; the texts are whole) is dealt over ``shards`` tasks. Each runs FTRL-proximal over its
share; the weights are then averaged (parameter mixing). The model is one array of ``2**bits``
floats, its size fixed, which is sent to the scoring tasks.

Defined results: null and empty texts score the bias; a document with several labels takes the
largest; null labels and labels of a null ``doc_id`` are not learnt from; with no usable label every
score is 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from ledgerlens.llm.text import fold, map_rows, slices, utf8, worker_state

HELD_OUT_FOLDS = 5
THRESHOLD = 0.3
_TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x00-\x20]+")
_CACHE_TOKENS = 200_000


@dataclass(frozen=True)
class Settings:
    bits: int = 18
    ngrams: int = 2
    max_train: int = 20_000
    shards: int = 4
    epochs: int = 8
    alpha: float = 4.0
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.0
    back: int = 3


def _shape(word: bytes) -> int:
    first = word[:1]
    if not (first.isalnum() or first >= b"\x80"):
        return 0
    if word.isdigit():
        return 1
    return 2 if word.islower() else 3 if word.isupper() and len(word) > 1 else 4


class _Hashes(dict):
    """Token hashes; the lower three bits hold the shape."""

    def __missing__(self, word):
        if len(self) > _CACHE_TOKENS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word) & ~7 | _shape(word)
        return h


class Features:
    """Sparse hashed n-gram vectors."""

    def __init__(self, settings: Settings):
        self.s = settings
        self.hashes = _Hashes()

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words = _TOKEN.findall(utf8(text))
        h = np.fromiter(map(self.hashes.__getitem__, words), dtype=np.uint64, count=len(words))
        shapes = h & np.uint64(7)
        for d in range(self.s.back, 0, -1):
            shapes[d:][h[d:] == h[:-d]] = 7 + d
        shift, at, values = np.uint64(64 - self.s.bits), [], []
        for sequence in (h, shapes + np.uint64(1)):
            grams = sequence
            for n in range(self.s.ngrams):
                if n:
                    grams = grams[:-1] * np.uint64(0x9E3779B97F4A7C15) + sequence[n:]
                if not len(grams):
                    break
                # A multiplicative hash: its upper bits pick the bucket.
                buckets = (grams * np.uint64(0xD6E8FEB86659FD93)) >> shift
                k, counts = np.unique(buckets.astype(np.int64), return_counts=True)
                at.append(k)
                values.append(np.sqrt(counts / len(grams)))
        if not at:
            return np.zeros(0, dtype=np.int64), np.zeros(0)
        at, place = np.unique(np.concatenate(at), return_inverse=True)
        return at, np.bincount(place, weights=np.concatenate(values))


class Ftrl:
    """FTRL-proximal logistic regression (McMahan et al. 2013); the last weight is the bias."""

    def __init__(self, s: Settings):
        self.s = s
        self.z = np.zeros((1 << s.bits) + 1)
        self.n = np.zeros((1 << s.bits) + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        s, z, n = self.s, self.z[at], self.n[at]
        w = -(z - np.sign(z) * s.l1) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2)
        return np.where(np.abs(z) > s.l1, w, 0.0)

    def update(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        at, x = np.append(at, len(self.z) - 1), np.append(x, 1.0)
        w = self.weights(at)
        g = (1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.s.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def _features(settings: Settings) -> Features:
    return worker_state(("quality", settings), lambda: Features(settings))


def _sample(docs: DataFrame, labels: DataFrame, s: Settings, folds: int) -> DataFrame:
    own = (labels.select("doc_id", F.col("quality").alias("_y"))
                 .where(F.col("doc_id").isNotNull() & F.col("_y").isNotNull() & (fold("doc_id", folds) != 0))
                 .groupBy("doc_id").agg(F.max("_y").alias("_y")))
    n = own.count()
    if n > s.max_train:  # a fixed share by id hash; max_train bounds what is sent out
        own = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1e6 * s.max_train / n))
    return docs.select("doc_id", "text").join(F.broadcast(own), "doc_id").select("doc_id", "text", "_y")


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(),
          folds: int = HELD_OUT_FOLDS) -> np.ndarray:
    """Averaged weights of the shards, ``2**bits`` features and then the bias."""
    s = settings

    def sparse(columns, features):
        return [(*rest, at.astype(np.int32).tobytes(), x.astype(np.float32).tobytes())
                for *rest, t in zip(*columns) for at, x in [features(t)]]

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        # Of rows that share an id, the one with the smallest text digest is learned from.
        pdf = pdf.sort_values(["_order", "doc_id", "_digest"]).drop_duplicates("doc_id")
        model = Ftrl(s)
        rows = [(np.frombuffer(a, dtype=np.int32), np.frombuffer(x, dtype=np.float32))
                for a, x in zip(pdf["_at"], pdf["_x"])]
        labels_ = pdf["_y"].to_numpy(dtype=float)
        for _ in range(s.epochs):
            for (at, x), y in zip(rows, labels_):
                model.update(at, x, y)
        return pd.DataFrame({"n": [len(pdf)], "w": [model.weights().astype("<f4").tobytes()]})

    h = F.xxhash64("doc_id", F.lit("quality"))
    columns = ["doc_id", "_y", "_order", "_shard", "_digest"]
    dealt = _sample(docs, labels, s, folds).select(
        "doc_id", F.col("_y").cast("double").alias("_y"), h.alias("_order"),
        F.pmod(h, F.lit(s.shards)).alias("_shard"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("_digest"), "text")
    # Texts become sparse features, of at most 4 * 2**bits numbers, where they are read.
    dealt = map_rows(dealt, sparse, f"doc_id {dict(docs.dtypes)['doc_id']}, _y double, _order long, _shard long, "
                     "_digest string, _at binary, _x binary", [*columns, "text"], before=lambda: _features(s))
    shares = dealt.groupBy("_shard").applyInPandas(shard, "n long, w binary").collect()
    total = sum(r.n for r in shares)
    w = np.zeros((1 << s.bits) + 1)
    for r in shares:
        w += np.frombuffer(r.w, dtype="<f4") * (r.n / total)
    return w


def score(docs: DataFrame, weights: np.ndarray, settings: Settings = Settings(),
          folds: int = HELD_OUT_FOLDS, threshold: float = THRESHOLD, keep: bool = False) -> DataFrame:
    """``doc_id, held_out, score, predicted``; with ``keep``, all columns of ``docs`` whose score
    reaches the threshold instead."""
    sent = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def probability(features: Features, text: str | None) -> float:
        at, x = features(text)
        w = sent.value
        return float(1.0 / (1.0 + np.exp(-np.clip(w[at] @ x + w[-1], -35, 35))))

    if keep:
        def scored(batches):
            import pyarrow as pa
            features = _features(settings)
            for batch in slices(batches):
                p = [probability(features, t) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
                yield batch.filter(pa.array([v >= threshold for v in p], type=pa.bool_()))
        return docs.mapInArrow(scored, docs.schema)

    def rows(columns, features):
        return [(i, h, p, int(p >= threshold))
                for i, h, t in zip(*columns) for p in [probability(features, t)]]

    id_type = dict(docs.dtypes)["doc_id"]
    return map_rows(docs.select("doc_id", (fold("doc_id", folds) == 0).alias("_held"), "text"), rows,
                    f"doc_id {id_type}, held_out boolean, score double, predicted int",
                    ["doc_id", "_held", "text"], before=lambda: _features(settings))
