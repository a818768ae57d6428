"""Token counts by rank-synchronous array merging.

Pre-tokens come from the library's own normaliser and pre-tokeniser. A batch of them is held as one
ragged numpy array: symbols of all sequences end to end plus sequence starts. In each round every
sequence finds its lowest-ranked adjacent pair, all sequences apply theirs at the same time, and
finished sequences leave. The symbols that survive are counted.

The library merges the lowest rank first and, within a rank, from the left. A round therefore
applies all non-overlapping places of the pair only where its product cannot form a pair of lower
rank; otherwise only the leftmost place.

Defined results: null and empty texts have 0 tokens; a null ``doc_id`` stays null; repeated rows are
counted separately; an empty table gives an empty result.
"""

from __future__ import annotations


import numpy as np
from pyspark.sql import DataFrame

from ledgerlens.llm import tokens
from ledgerlens.llm.text import map_rows, utf8, worker_state

TOKEN_LIMIT = 2048
#: Symbols merged together at a time.
BATCH_SYMBOLS = 2_000_000


class RankMerger:
    """Merge tables of one vocabulary, and the ragged-array merging itself."""

    def __init__(self, spec: dict):
        model = spec["model"]
        ids = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.ids = ids
        left = np.array([ids[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([ids[b] for _, b in pairs], dtype=np.int64)
        made = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)
        self.base = int(max(ids.values())) + 2
        rank = np.arange(len(pairs))
        # A product that takes part in a pair of lower rank must be applied one place at a time.
        first_use = np.full(self.base, len(pairs), dtype=np.int64)
        np.minimum.at(first_use, left, rank)
        np.minimum.at(first_use, right, rank)
        order = np.argsort(left * self.base + right, kind="stable")
        self.keys = (left * self.base + right)[order]
        self.rank = rank[order]
        self.made = made
        self.together = first_use[made] > rank
        self.none = len(pairs)

    def symbols(self, piece: str) -> list[int]:
        """Start symbols of a byte-level pre-token: its characters, the last with the word end."""
        if not piece:
            return []
        get = self.ids.get
        out = [get(c) for c in piece[:-1]] + [get(piece[-1] + self.end)]
        return [i for i in out if i is not None]

    def counts(self, sequences: list[list[int]]) -> np.ndarray:
        """Number of symbols left of each sequence."""
        lengths = np.fromiter(map(len, sequences), dtype=np.int64, count=len(sequences))
        result = lengths.copy()
        active = np.flatnonzero(lengths > 1)
        if not len(active):
            return result
        flat = np.concatenate([np.asarray(sequences[i], dtype=np.int64) for i in active])
        sizes = lengths[active]
        while len(active):
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            owner = np.repeat(np.arange(len(sizes)), sizes)
            ranks = np.full(len(flat), self.none, dtype=np.int64)
            key = flat[:-1] * self.base + flat[1:]
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            hit = (self.keys[at] == key) & (owner[:-1] == owner[1:])
            ranks[:-1][hit] = self.rank[at[hit]]
            lowest = np.minimum.reduceat(ranks, starts)
            done = lowest == self.none
            chosen = (ranks == lowest[owner]) & ~done[owner]
            place = np.flatnonzero(chosen)
            if len(place):
                own = owner[place]
                # Runs of adjacent places (aaaa): every second one; places apart: all.
                fresh = np.ones(len(place), dtype=bool)
                fresh[1:] = place[1:] != place[:-1] + 1
                run_start = np.maximum.accumulate(np.where(fresh, np.arange(len(place)), 0))
                take = (np.arange(len(place)) - run_start) % 2 == 0
                first = np.ones(len(place), dtype=bool)
                first[1:] = own[1:] != own[:-1]
                take &= first | self.together[lowest[own]]
                place = place[take]
                flat[place] = self.made[lowest[owner[place]]]
                keep = np.ones(len(flat), dtype=bool)
                keep[place + 1] = False
                sizes = sizes - np.bincount(owner[place], minlength=len(sizes))
                flat, owner = flat[keep], owner[keep]
            result[active] = sizes
            stay = ~done & (sizes > 1)
            if not stay.all():
                flat = flat[stay[owner]]
                active, sizes = active[stay], sizes[stay]
        return result


class TokenCounter:
    """Counts of whole texts, equal to the library's ``encode`` without added special tokens."""

    def __init__(self, path: str):
        self.splitter = tokens.Splitter(path)
        self.merger = RankMerger(self.splitter.spec)
        self.by_chunk: dict[bytes, int] = {}
        self.by_piece: dict[str | int, int] = {}

    def _merge(self, pieces: list[str]) -> None:
        batch, size = [], 0
        for i, p in enumerate(pieces):
            batch.append(self.merger.symbols(p))
            size += len(batch[-1])
            if size >= BATCH_SYMBOLS or i == len(pieces) - 1:
                done = pieces[i + 1 - len(batch):i + 1]
                self.by_piece.update(zip(done, self.merger.counts(batch).tolist()))
                batch, size = [], 0

    def count_batch(self, texts: list[str | None]) -> list[int]:
        if len(self.by_chunk) > tokens.CACHE_CHUNKS:
            self.by_chunk, self.by_piece = {}, {}
        split = [tokens.chunks(t) for t in texts]
        new = list(set().union(*split).difference(self.by_chunk))
        cut = [self.splitter.pieces(c) for c in new]
        own = {p for ps in cut for p in ps}.difference(self.by_piece)
        self.by_piece.update((p, 1) for p in own if isinstance(p, int))  # special tokens
        self._merge([p for p in own if isinstance(p, str)])
        n_of = self.by_piece.__getitem__
        self.by_chunk.update((c, sum(map(n_of, ps))) for c, ps in zip(new, cut))
        return [sum(map(self.by_chunk.__getitem__, s)) for s in split]


def token_counts(docs: DataFrame, vocabulary: str | None = None, limit: int = TOKEN_LIMIT) -> DataFrame:
    """Per document: ``doc_id, n_bytes, n_tokens, over_limit`` of the whole text.

    ``vocabulary`` is the path of a ``tokenizers`` JSON file readable on every executor.
    """
    path = vocabulary or tokens.vocabulary_path()

    def count(columns, counter):
        ids, texts = columns
        out = []
        for lo in range(0, len(ids), 256):
            part = texts[lo:lo + 256]
            for i, t, n in zip(ids[lo:lo + 256], part, counter.count_batch(part)):
                out.append((i, len(utf8(t)), n, n > limit))
        return out

    id_type = dict(docs.dtypes)["doc_id"]
    return map_rows(docs, count, f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean",
                    ["doc_id", "text"], before=lambda: worker_state(("token_counts", path), lambda: TokenCounter(path)))
