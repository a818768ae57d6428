"""Language-model scoring with a weighted backoff automaton.

Model: n-gram counts of all training documents, smoothed by a Dirichlet prior on the next lower order,

    P1(w)     = (c(w) + 0.1) / (N + 0.1 * (V + 1))
    P(w | h)  = (c(hw) + mu * P(w | h')) / (c(h) + mu)

where ``h'`` is ``h`` without its first word. As an automaton: every history seen in training is a
state; a seen n-gram ``hw`` is an arc of weight ``log10 P(w | h)``; all other words leave ``h`` by its
failure arc to ``h'``, of weight ``log10(mu / (c(h) + mu))``. The root has an arc for every word, known
or not. A text starts in the state of the text start; one traversal from left to right carries the
state and adds up the weights. Probabilities of each state add up to 1.

The model has as many n-grams as the corpus and fits on no machine, so it is never gathered:

1. Documents are gathered into chunks of about ``chunk_bytes`` of text, one row each (written once).
2. Each chunk sends its distinct n-grams (sorted 64-bit hashes and training counts) to buckets, which
   are ranges of the hash: a frequent history is spread over all buckets, and an n-gram comes once a
   chunk at most, however often it occurs.
3. A bucket adds up the counts and answers each chunk, in the order of its question.
4. Each chunk builds the automaton's part that its texts can reach, and traverses it.

Words and n-grams are told apart by 64-bit hashes; two of a billion words collide with probability
0.03.

Defined results: null and empty texts are the end token alone; a null ``doc_id`` is held out (its id
counts as the empty text); repeated rows count as often as they come; without training documents
every word is unknown and the scores still add up; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ledgerlens.llm.text import fold, space_words, utf8
from ledgerlens.session import stage_path

HELD_OUT_FOLDS = 10
PRIOR = 0.1
_MIX = np.uint64(0x9E3779B97F4A7C15)
_CACHE_WORDS = 300_000
# No word contains white space.
START = xxhash.xxh64_intdigest(b"\n\n")
END = xxhash.xxh64_intdigest(b"\n")


@dataclass(frozen=True)
class Settings:
    order: int = 2
    mu: float = 200.0
    chunk_bytes: int = 10 << 20
    bucket_bytes: int = 4 << 20


class _Words(dict):
    def __missing__(self, word):
        if len(self) > _CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


class Grams:
    """N-gram keys of a list of texts; position 0 of every text is the first word (or the end)."""

    def __init__(self, texts: list[bytes | str | None], order: int, words: _Words):
        rows = []
        for t in texts:
            w = space_words(t) if not isinstance(t, bytes) else t.lower().split()
            own = np.empty(len(w) + 2, dtype=np.uint64)
            own[0], own[-1] = START, END
            own[1:-1] = np.fromiter(map(words.__getitem__, w), dtype=np.uint64, count=len(w))
            rows.append(own)
        self.lengths = np.array([len(r) - 1 for r in rows], dtype=np.int64)
        flat = np.concatenate(rows) if rows else np.zeros(0, dtype=np.uint64)
        begins = np.concatenate(([0], np.cumsum(self.lengths + 1)))[:-1]
        token = np.ones(len(flat), dtype=bool)
        token[begins] = False
        depth = np.arange(len(flat)) - np.repeat(begins, self.lengths + 1)  # words before, the start included
        self.keys: list[np.ndarray] = []
        key = flat
        for k in range(1, order + 1):
            if k > 1:
                key = np.concatenate((key[:1], _scramble(key[:-1]) + flat[1:]))
                key = np.where(depth >= k - 1, key, np.uint64(0))
            self.keys.append(key[token])
        self.begins = np.concatenate(([0], np.cumsum(self.lengths)))[:-1]


def _scramble(key: np.ndarray) -> np.ndarray:
    key = key * _MIX
    return key ^ (key >> np.uint64(29))


def _planes(values: np.ndarray) -> bytes:
    """Unsigned numbers as their low bytes, then the next ones, as far as the largest needs."""
    width = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
    return bytes([width]) + np.ascontiguousarray(
        values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplanes(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), dtype=np.uint8)
    width = data[0]
    out[:, :width] = np.frombuffer(data, dtype=np.uint8, offset=1, count=width * n).reshape(width, n).T
    return out.view("<u8").reshape(-1)


def _pack_keys(keys: np.ndarray) -> bytes:
    return _planes(np.diff(keys, prepend=keys[:1])) if len(keys) else b"\0"


def _occupied(keys: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """``(bucket, begin, end)`` of the buckets that the sorted keys fall into; bucket = key * buckets / 2**64."""
    if not len(keys):
        return []
    low, high, n = keys & np.uint64(0xFFFFFFFF), keys >> np.uint64(32), np.uint64(buckets)
    own = (high * n + (low * n >> np.uint64(32))) >> np.uint64(32)
    begins = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    return list(zip(own[begins].tolist(), begins.tolist(), [*begins[1:].tolist(), len(keys)]))


def _chunks(docs: DataFrame, s: Settings, folds: int, path: str) -> DataFrame:
    """One row per chunk: ``chunk, ids, held, sizes, body, n_train, n_bytes``."""
    id_type = dict(docs.dtypes)["doc_id"]
    schema = (f"chunk long, ids array<{id_type}>, held array<boolean>, sizes array<int>, body binary, "
              "n_train long, n_bytes long")
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        base, done = TaskContext.get().partitionId() << 24, 0
        ids, held, texts, size = [], [], [], 0

        def row():
            return pa.RecordBatch.from_pydict({
                "chunk": [base + done], "ids": [ids], "held": [held], "sizes": [[len(t) for t in texts]],
                "body": [zstandard.ZstdCompressor(level=3).compress(b"".join(texts))],
                "n_train": [len(held) - sum(held)], "n_bytes": [size]}, schema=target)

        for batch in batches:
            for i, h, t in zip(*(c.to_pylist() for c in batch.columns)):
                raw = utf8(t)
                ids.append(i)
                held.append(h)
                texts.append(raw)
                size += len(raw)
                if size >= s.chunk_bytes or len(ids) >= 1 << 20:
                    yield row()
                    done += 1
                    ids, held, texts, size = [], [], [], 0
        if ids:
            yield row()

    docs.select("doc_id", (fold("doc_id", folds) == 0).alias("held"), "text").mapInArrow(run, schema).write.option(
        "compression", "none").parquet(path)
    return docs.sparkSession.read.parquet(path)


def _texts(sizes, body) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(body)
    ends = np.cumsum(np.asarray(sizes, dtype=np.int64))
    return [raw[e - n:e] for n, e in zip(sizes, ends.tolist())]


def _questions(chunks: DataFrame, s: Settings, buckets: int) -> DataFrame:
    """Distinct n-grams of every chunk by bucket: ``chunk, bucket, gram, n, first, keys, counts``."""
    schema = "chunk long, bucket int, gram int, n int, first binary, keys binary, counts binary"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        words = _Words()
        for batch in batches:
            for chunk, held, sizes, body in zip(*(c.to_pylist() for c in batch.columns)):
                grams = Grams(_texts(sizes, body), s.order, words)
                train = np.repeat(~np.asarray(held, dtype=bool), grams.lengths)
                for k, keys in enumerate(grams.keys, 1):
                    every, counts = np.unique(keys, return_counts=True)
                    if not train.all():
                        seen, times = np.unique(keys[train], return_counts=True)
                        counts = np.zeros(len(every), dtype=np.uint64)
                        counts[np.searchsorted(every, seen)] = times
                    rows = {n: [] for n in target.names}
                    for b, lo, hi in _occupied(every, buckets):
                        for name, v in zip(target.names, (
                                chunk, b, k, hi - lo, every[lo:lo + 1].astype("<u8").tobytes(),
                                _pack_keys(every[lo:hi]), _planes(counts[lo:hi]))):
                            rows[name].append(v)
                    yield pa.RecordBatch.from_pydict(rows, schema=target)

    return chunks.select("chunk", "held", "sizes", "body").mapInArrow(run, schema)


def _answers(questions: DataFrame, path: str) -> DataFrame:
    """Counts over all chunks, in the order of each question; ``total`` and ``types`` of the 1-grams
    of a bucket stand in one of its rows."""
    def merge(table: pa.Table) -> pa.Table:
        out = []
        for gram in pc.unique(table["gram"]).to_pylist():
            own = table.filter(pc.equal(table["gram"], gram))
            sizes = own["n"].to_pylist()
            keys = [np.cumsum(np.concatenate((np.frombuffer(f, dtype="<u8"), _unplanes(d, n)[1:])), dtype=np.uint64)
                    for f, d, n in zip(own["first"].to_pylist(), own["keys"].to_pylist(), sizes)]
            counts = np.concatenate([_unplanes(d, n) for d, n in zip(own["counts"].to_pylist(), sizes)])
            _, place = np.unique(np.concatenate(keys), return_inverse=True)
            sums = np.bincount(place, weights=counts).astype(np.uint64)
            ends = np.cumsum(sizes).tolist()
            words = [(int(sums.sum()), int((sums > 0).sum())) if gram == 1 else (0, 0)] + [(0, 0)] * (len(sizes) - 1)
            out.append(pa.Table.from_pydict({
                "chunk": own["chunk"], "bucket": own["bucket"], "gram": own["gram"], "n": own["n"],
                "counts": [_planes(sums[place[e - n:e]]) for n, e in zip(sizes, ends)],
                "total": [t for t, _ in words], "types": [v for _, v in words]}, schema=target))
        return pa.concat_tables(out)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    schema = "chunk long, bucket int, gram int, n int, counts binary, total long, types long"
    target = to_arrow_schema(_parse_datatype_string(schema))
    questions.groupBy("bucket").applyInArrow(merge, schema).write.parquet(path)
    return questions.sparkSession.read.parquet(path)


def traverse(arcs: list[list[float | None]], fails: list[list[float]], states: list[list[bool]]) -> float:
    """One text's log10 probability.

    Per position: ``arcs[k]`` is the weight of the arc from the history of ``k`` words (None: no arc),
    ``fails[k]`` the weight of that history's failure arc, ``states[k]`` whether the history of ``k``
    words that the position ends is a state.
    """
    top = len(arcs) - 1
    total, level = 0.0, min(1, top)
    for arc, fail, state in zip(zip(*arcs), zip(*fails), zip(*states)):
        while arc[level] is None:
            total += fail[level]
            level -= 1
        total += arc[level]
        level = min(level + 1, top)
        while not state[level]:
            level -= 1
    return total


def chunk_scores(texts: list[bytes], counts_of: list[np.ndarray], grams: Grams, s: Settings,
                 total: int, types: int, n_train: int) -> tuple[list[int], list[float], list[float]]:
    """Known tokens, base scores and scores of a chunk's texts.

    ``counts_of[k - 1]`` holds the training counts of the chunk's distinct k-grams, by key.
    """
    n = len(grams.keys[0])
    starts = np.zeros(n, dtype=bool)
    starts[grams.begins] = True
    count = []
    for keys, counts in zip(grams.keys, counts_of):
        distinct, place = np.unique(keys, return_inverse=True)
        if len(distinct) != len(counts):
            raise RuntimeError("answers do not fit the chunk")
        count.append(np.where(keys == 0, 0.0, counts[place].astype(np.float64)))
    # History counts per position: hist[k][p] is the count of the k words before p.
    p = (count[0] + PRIOR) / (total + PRIOR * (types + 1))
    base = np.log10(p)
    arcs, fails, states = [base], [np.zeros(n)], [np.ones(n, dtype=bool)]
    end = np.zeros(n, dtype=bool)
    end[grams.begins + grams.lengths - 1] = True
    for k in range(1, s.order):
        before = np.concatenate(([0.0], count[k - 1][:-1]))
        if k == 1:
            before[starts] = n_train
        else:
            before[starts] = 0.0
        lower = p
        with np.errstate(divide="ignore"):
            p = (count[k] + s.mu * lower) / (before + s.mu)
            arcs.append(np.where(count[k] > 0, np.log10(p), np.nan))
            fails.append(np.log10(s.mu / (before + s.mu)))
        states.append((count[k - 1] > 0) & ~end)
    known = np.add.reduceat(count[0] > 0, grams.begins, dtype=np.int64).tolist()
    base_sum = np.add.reduceat(base, grams.begins).tolist()
    scores = []
    for lo, size in zip(grams.begins.tolist(), grams.lengths.tolist()):
        own = slice(lo, lo + size)
        lists = [a[own].tolist() for a in arcs]
        for k in range(1, s.order):
            lists[k] = [None if w != w else w for w in lists[k]]
        scores.append(traverse(lists, [f[own].tolist() for f in fails], [t[own].tolist() for t in states]))
    return known, base_sum, scores


def score(docs: DataFrame, settings: Settings = Settings(), folds: int = HELD_OUT_FOLDS) -> DataFrame:
    """Per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``."""
    s, spark = settings, docs.sparkSession
    id_type = dict(docs.dtypes)["doc_id"]
    chunks = _chunks(docs, s, folds, stage_path(spark, "lm-chunks"))
    size = chunks.agg(F.sum("n_bytes").alias("b"), F.sum("n_train").alias("d")).first()
    buckets = max(1, -(-(size.b or 0) // s.bucket_bytes))
    answers = _answers(_questions(chunks, s, buckets), stage_path(spark, "lm-answers"))
    sums = answers.agg(F.sum("total").alias("n"), F.sum("types").alias("v")).first()
    total, types, n_train = sums.n or 0, sums.v or 0, size.d or 0

    schema = (f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
              "base_score double, score double")
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = {c: left[c][0].as_py() for c in left.column_names}
        texts = _texts(row["sizes"], row["body"])
        grams = Grams(texts, s.order, _Words())
        right = right.sort_by([("gram", "ascending"), ("bucket", "ascending")])
        counts = []
        for k in range(1, s.order + 1):
            own = right.filter(pc.equal(right["gram"], k))
            counts.append(np.concatenate([_unplanes(d, n) for d, n in zip(own["counts"].to_pylist(),
                                                                         own["n"].to_pylist())]))
        known, base, scores = chunk_scores(texts, counts, grams, s, total, types, n_train)
        return pa.Table.from_pydict({
            "doc_id": row["ids"], "held_out": row["held"], "n_tokens": grams.lengths, "n_known": known,
            "train_tokens": [total] * len(texts), "base_score": base, "score": scores}, schema=target)

    return chunks.select("chunk", "ids", "held", "sizes", "body").groupBy("chunk").cogroup(
        answers.select("chunk", "bucket", "gram", "n", "counts").groupBy("chunk")).applyInArrow(run, schema)
