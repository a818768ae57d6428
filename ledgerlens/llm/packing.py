"""Cost-balanced packing of tokenised documents into sequences.

Attention over a piece of ``l`` tokens costs ``linear * l + quadratic * l * l``. Documents are taken
by descending length (those longer than a sequence in parts of its length); each goes to the sequence
of lowest cost so far that has room for it. Where none has, the sequence of lowest cost is filled and
the rest goes on.

Work is split into blocks of at most about ``block_tokens`` tokens, packed independently inside a
task: nothing is shuffled, no block grows with the input, and a lost task redoes only its blocks. A
block's capacities add up to its tokens exactly: full sequences, and for the remainder one sequence
for each power of two in it, which needs no padding either.

Defined results: null and empty texts are one end token; a null ``doc_id`` stays null; repeated rows
are packed separately; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ledgerlens.llm import tokens
from ledgerlens.llm.text import slices, to_batch, worker_state

SEQUENCE = 2048
END_ID = 1
BLOCK_TOKENS = 1_000_000
LINEAR, QUADRATIC = 1.0, 1.0 / 1024


class Encoder(dict):
    """Token ids (as bytes) of chunks: the library's model on each distinct pre-token, looked up from
    then on. Full caches become the old generation, from which what is still in use comes back."""

    def __init__(self, path: str, end_id: int = END_ID):
        super().__init__()
        self.splitter = tokens.Splitter(path)
        self.splitter.spec = None  # its vocabulary is in the model
        self.model = self.splitter.tokenizer.model
        self.end = array("I", [end_id]).tobytes()
        self.pieces: dict[str | int, bytes] = {}
        self.old: tuple[dict, dict] = ({}, {})

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self.old[0].get(chunk)
        if ids is None:
            parts = [self.pieces.get(p) or self._piece(p) for p in self.splitter.pieces(chunk)]
            ids = parts[0] if len(parts) == 1 else b"".join(parts)
        self[chunk] = ids
        return ids

    def _piece(self, piece: str | int) -> bytes:
        ids = self.old[1].get(piece)
        if ids is None:
            own = [piece] if isinstance(piece, int) else [t.id for t in self.model.tokenize(piece)]
            ids = array("I", own).tobytes()
        self.pieces[piece] = ids
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        if len(self) > tokens.CACHE_CHUNKS:
            self.old = dict(self), self.pieces
            self.clear()
            self.pieces = {}
        return np.frombuffer(b"".join(map(self.__getitem__, tokens.chunks(text))) + self.end, dtype="<u4")


def capacities(total: int, size: int = SEQUENCE) -> list[int]:
    """Sequence lengths that hold ``total`` tokens without padding."""
    rest = total % size
    return [size] * (total // size) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def assign(lengths: list[int], size: int = SEQUENCE, linear: float = LINEAR,
           quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int]]:
    """Pieces ``(document, start, length, sequence)``; sequences are filled exactly."""
    room = capacities(sum(lengths), size)
    cost = [0.0] * len(room)
    # Sequences in ``fit`` may have room for the piece at hand; a sequence found too full waits, known by
    # room and by cost, until the pieces have become short enough.
    fit = [(0.0, q) for q in range(len(room))]
    waiting, by_room, by_cost = set(), [], []
    pieces = []

    def current(q, c):
        return q in waiting and cost[q] == c

    parts = [(min(size, n - start), doc, start) for doc, n in enumerate(lengths) for start in range(0, n, size)]
    for length, doc, start in sorted(parts, key=lambda p: (-p[0], p[1], p[2])):
        while length:
            while by_room and -by_room[0][0] >= length:
                _, c, q = heapq.heappop(by_room)
                if current(q, c):
                    waiting.discard(q)
                    heapq.heappush(fit, (c, q))
            while fit and room[fit[0][1]] < length:
                c, q = heapq.heappop(fit)
                waiting.add(q)
                heapq.heappush(by_room, (-room[q], c, q))
                heapq.heappush(by_cost, (c, q))
            if fit:
                _, q = heapq.heappop(fit)
            else:  # none has room for all: the cheapest is filled and the rest goes on
                c, q = heapq.heappop(by_cost)
                while not current(q, c):
                    c, q = heapq.heappop(by_cost)
                waiting.discard(q)
            n = min(length, room[q])
            pieces.append((doc, start, n, q))
            room[q] -= n
            cost[q] += linear * n + quadratic * n * n
            if room[q]:
                heapq.heappush(fit, (cost[q], q))
            start, length = start + n, length - n
    return pieces


def _pack_block(ids: list, docs: list[np.ndarray], first: int) -> list[tuple]:
    pieces = assign([len(d) for d in docs])
    fill: dict[int, int] = {}
    rows = []
    for doc, start, length, q in pieces:
        offset = fill.get(q, 0)
        fill[q] = offset + length
        crc = zlib.crc32(docs[doc][start:start + length].tobytes())
        rows.append((ids[doc], start, length, crc, len(docs[doc]), first + q, offset))
    return rows


def pack(docs: DataFrame, vocabulary: str | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document longer than ``block_tokens`` is its own block. ``sequence_id`` is the task's partition
    (upper bits) and the number of the sequence in it.
    """
    path = vocabulary or tokens.vocabulary_path()
    id_type = dict(docs.dtypes)["doc_id"]
    schema = (f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, "
              "sequence_id long, offset long")

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_state(("packing", path), lambda: Encoder(path))
        base = TaskContext.get().partitionId() << 36
        ids, block, size, sequences = [], [], 0, 0
        for batch in slices(batches):
            keys, texts = (c.to_pylist() for c in batch.columns)
            for k, t in zip(keys, texts):
                ids.append(k)
                block.append(encoder.encode(t))
                size += len(block[-1])
                if size >= block_tokens:
                    yield to_batch(_pack_block(ids, block, base + sequences), target)
                    sequences += len(capacities(size))
                    ids, block, size = [], [], 0
        if block:
            yield to_batch(_pack_block(ids, block, base + sequences), target)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
