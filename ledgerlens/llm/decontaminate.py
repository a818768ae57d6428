"""Benchmark decontamination with a broadcast set of normalised n-grams.

A window is ``n`` consecutive words of a benchmark item; an item with fewer words is one window.
Documents are scanned for rolling hashes of their word windows; a hash found in the set is verified
word by word, and all words of a verified window are hit.

The set is sent to all tasks only up to ``max_broadcast`` bytes of benchmark text and ``max_bytes`` bytes of the
index that is built from it (arrays: at most 32 bytes a word beside the text itself). A larger benchmark is dealt into
blocks below both sizes by item hash (a single larger item is a block of its own). Blocks follow one another: an
index is built, sent, used and dropped before the next; the hit ranges are merged per document.

Defined results: null texts have no words; rows that share an ``item_id`` are one item; a null
``item_id`` is listed as the empty string; items without words match nothing; empty tables give an
empty result or no hits; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from ledgerlens.llm.text import alnum_words, map_rows, slices, utf8, worker_state
from ledgerlens.session import stage_path

WINDOW = 10
MAX_BROADCAST = 32 << 20
MAX_BYTES = 128 << 20
#: Of the index, for each word: where it starts (8), hash, place and item of its window (16), the table (4 to 8).
WORD_BYTES = 32
_WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_OTHER = np.uint64(0xD6E8FEB86659FD93)


class _Hashes(dict):
    """Word hashes; forgets all when full."""

    def __missing__(self, word):
        if len(self) >= 200_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _hashes(words: list[bytes]) -> np.ndarray:
    known = worker_state(("decontaminate",), _Hashes)
    return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def _rolling(h: np.ndarray, size: int, mix: np.uint64 = _MIX) -> np.ndarray:
    out = np.zeros(max(0, len(h) - size + 1), dtype=np.uint64)
    for k in range(size):
        out = out * mix + h[k:len(h) - size + 1 + k]
    return out


class _Windows:
    """Windows of one length: sorted hashes, beside them a place in the words and the item; a table of the hashes' upper
    bits tells most other windows apart at once."""

    def __init__(self, words: np.ndarray, size: int, places: np.ndarray, items: np.ndarray):
        h, other = _rolling(words, size)[places], _rolling(words, size, _OTHER)[places]
        order = np.lexsort((items, other, h))
        h, other, places, items = h[order], other[order], places[order], items[order]
        # One place for each window and item; windows are told apart by both hashes.
        first = np.concatenate(([True], (h[1:] != h[:-1]) | (other[1:] != other[:-1]) | (items[1:] != items[:-1])))
        self.hashes, self.places, self.items = h[first], places[first].astype(np.int32), items[first].astype(np.int32)
        bits = max(10, (4 * len(self.hashes)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.table = np.zeros(1 << bits, dtype=bool)
        self.table[(self.hashes >> self.shift).astype(np.int64)] = True


class WindowIndex:
    """All windows of a set of items as arrays over the items' words, by length."""

    def __init__(self, items: list[tuple[str, str | None]], n: int):
        self.items = [item for item, _ in items]
        texts, hashes, sizes, counts = [], [], [], []
        for _, text in items:
            words = alnum_words(text)
            counts.append(len(words))
            hashes.append(np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words)))
            sizes.append(np.fromiter(map(len, words), dtype=np.int64, count=len(words)))
            if words:
                texts.append(b" ".join(words))
        self.text = b" ".join(texts)  # the words, one space between any two
        self.starts = np.concatenate(([0], np.cumsum(np.concatenate([*sizes, np.zeros(0, dtype=np.int64)]) + 1)))
        words = np.concatenate([*hashes, np.zeros(0, dtype=np.uint64)])
        counts = np.array(counts, dtype=np.int64)
        own = np.repeat(np.arange(len(counts)), counts)
        left = np.repeat(np.cumsum(counts), counts) - np.arange(len(words))  # words to the item's end
        size = np.minimum(n, counts)[own]
        self.windows = {}
        for k in np.unique(size).tolist():
            places = np.flatnonzero((size == k) & (left >= k))
            self.windows[k] = _Windows(words, k, places, own[places])

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged hit ranges ``[start, end)`` in words, and the items found."""
        found, ranges = set(), []
        own = _hashes(words) if self.windows else None
        for size, w in self.windows.items():
            if len(words) < size:
                continue
            h = _rolling(own, size)
            maybe = np.flatnonzero(w.table[(h >> w.shift).astype(np.int64)])
            at = np.searchsorted(w.hashes, h[maybe])
            same = at < len(w.hashes)
            same[same] = w.hashes[at[same]] == h[maybe[same]]
            known: dict[bytes, bool] = {}
            for i, j in zip(maybe[same].tolist(), at[same].tolist()):
                window = b" ".join(words[i:i + size])
                if window not in known:
                    items = self._verified(w, j, size, window)
                    found |= items
                    known[window] = bool(items)
                if known[window]:
                    ranges.append((i, i + size))
        return merge_ranges(ranges), found

    def _verified(self, w: _Windows, j: int, size: int, window: bytes) -> set[str]:
        """Items that hold the window word by word, of those with its hash."""
        end = int(np.searchsorted(w.hashes, w.hashes[j], side="right"))
        return {self.items[w.items[k]] for k in range(j, end)
                if self.text[self.starts[w.places[k]]:self.starts[w.places[k] + size] - 1] == window}


def merge_ranges(ranges) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def _dealt(benchmark: DataFrame, max_broadcast: int, max_bytes: int) -> tuple[DataFrame, int]:
    """``item, text`` of the benchmark and the number of its blocks."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    size = rows.agg(F.sum(F.octet_length("text")).alias("text"),
                    F.sum(F.octet_length("text") + WORD_BYTES * F.regexp_count("text", F.lit(_WORDS))).alias("built")).first()
    return rows, max(1, -(-(size.text or 0) // max_broadcast), -(-(size.built or 0) // max_bytes))


def _sent(rows: DataFrame, block: int, blocks: int, n: int):
    """The broadcast index of one block; its items, within the size bound, are built into arrays on the driver."""
    own = rows.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block) if blocks > 1 else rows
    return rows.sparkSession.sparkContext.broadcast(WindowIndex([tuple(r) for r in own.collect()], n))


def _each_block(docs: DataFrame, benchmark: DataFrame, n: int, max_broadcast: int, max_bytes: int, step) -> DataFrame:
    """``docs`` after ``step(docs, index)`` for every block; with several, each result is written before the next."""
    rows, blocks = _dealt(benchmark, max_broadcast, max_bytes)
    for b in range(blocks):
        index = _sent(rows, b, blocks, n)
        docs = step(docs, index)
        if blocks > 1:
            path = stage_path(docs.sparkSession, "decontaminate")
            docs.write.parquet(path)
            docs = docs.sparkSession.read.parquet(path)
            index.destroy()
    return docs


def _merged(spans):
    """``merge_ranges`` of sorted spans as a column."""
    kind = "array<struct<start:bigint,end:bigint>>"

    def take(done, s):
        last = F.try_element_at(done, F.lit(-1))
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        rest = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        apart = (F.size(done) == 0) | (s["start"] > last["end"])
        return F.when(apart, F.concat(done, F.array(s))).otherwise(F.concat(rest, F.array(joined)))

    return F.aggregate(spans, F.array().cast(kind), take)


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, max_broadcast: int = MAX_BROADCAST,
              max_bytes: int = MAX_BYTES) -> DataFrame:
    """Per document: ``doc_id, n_words, n_hit, n_items, item_ids, spans`` (hit ranges in words)."""
    id_type = dict(docs.dtypes)["doc_id"]
    schema = ("_row long, doc_id {}, n_words long, item_ids array<string>, "
              "spans array<struct<start:long,end:long>>").format(id_type)

    def scanner(index):
        def scan(columns):
            out = []
            for r, i, t in zip(*columns):
                words = alnum_words(t)
                spans, items = index.value.scan(words)
                out.append((r, i, len(words), sorted(items), [{"start": a, "end": b} for a, b in spans]))
            return out
        return scan

    items, blocks = _dealt(benchmark, max_broadcast, max_bytes)
    rows = docs.select(F.lit(None).cast("long").alias("_row") if blocks == 1
                       else F.xxhash64("doc_id", "text").alias("_row"), "doc_id", "text")
    parts = []
    for b in range(blocks):
        index = _sent(items, b, blocks, n)
        part = map_rows(rows, scanner(index), schema, ["_row", "doc_id", "text"])
        if blocks > 1:
            path = stage_path(docs.sparkSession, "hits")
            (part.where(F.size("spans") > 0) if b else part).write.parquet(path)
            part = docs.sparkSession.read.parquet(path)
            index.destroy()
        parts.append(part)
    if blocks == 1:
        hits = parts[0]
    else:
        # Rows that repeat id and text have equal hits in every block: one is merged per document,
        # and the number of repeats comes from the first block.
        every = parts[0].withColumn("_first", F.lit(1))
        for p in parts[1:]:
            every = every.unionByName(p.withColumn("_first", F.lit(0)))
        hits = (every.groupBy("_row", "doc_id", "n_words")
                     .agg(F.sort_array(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids"),
                          F.flatten(F.collect_set("spans")).alias("spans"), F.sum("_first").alias("_times"))
                     .withColumn("spans", _merged(F.array_sort("spans")))
                     .withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_times")))))
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return hits.select("doc_id", "n_words", covered.alias("n_hit"),
                       F.size("item_ids").cast("long").alias("n_items"), "item_ids", "spans")


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, max_broadcast: int = MAX_BROADCAST,
                     max_bytes: int = MAX_BYTES) -> DataFrame:
    """Rows of ``docs`` with no word in an occurrence of a benchmark window."""
    import pyarrow as pa

    def step(docs, index):
        def clean(batches):
            for batch in slices(batches):
                texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
                yield batch.filter(pa.array([not index.value.scan(alnum_words(t))[0] for t in texts],
                                            type=pa.bool_()))
        return docs.mapInArrow(clean, docs.schema)

    return _each_block(docs, benchmark, n, max_broadcast, max_bytes, step)


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, max_broadcast: int = MAX_BROADCAST,
                 max_bytes: int = MAX_BYTES) -> DataFrame:
    """``docs`` with the characters of every hit range cut out of ``text``."""
    import pyarrow as pa

    def step(docs, index):
        def cut(text):
            spans, _ = index.value.scan(alnum_words(text))
            if not spans:
                return text
            raw = utf8(text)
            places = [m.span() for m in _WORD.finditer(raw.lower())]
            for a, b in reversed(spans):
                raw = raw[:places[a][0]] + raw[places[b - 1][1]:]
            return raw.decode("utf-8")

        def strip(batches):
            for batch in slices(batches):
                k = batch.schema.get_field_index("text")
                yield batch.set_column(k, batch.schema.field(k), pa.array(
                    [cut(t) for t in batch.column(k).to_pylist()], type=batch.schema.field(k).type))
        return docs.mapInArrow(strip, docs.schema)

    return _each_block(docs, benchmark, n, max_broadcast, max_bytes, step)


def items_sha256(item_ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(item_ids)).encode()).hexdigest()
