"""Byte-level BPE encoding by prefix dynamic programming, decoding, and re-encoding after edits.

A rank file merges the adjacent pair whose bytes have the lowest rank, the leftmost first. Every prefix
of a text then has one encoding, and so one last token. It is the token ``t`` that ends the prefix and
may follow the last token ``s`` of the prefix before it: the merges of the bytes of ``s + t`` end as
``[s, t]``. If all neighbours agree in this way, no merge ever crosses a border, so the tokens are the
encoding; as there is one encoding, there is one such ``t``. The table of last tokens, one for each byte,

* gives the encoding by walking back from the end,
* is exact for every prefix, so appended bytes only add entries,
* depends at each entry on no more bytes and entries than the longest token has: after an edit, entries
  are made anew until that many in a row are as before; the rest stays.

The vocabulary's pattern cuts texts into pre-tokens first. A match depends on the text from its start to
two characters behind its end, so an edit only moves the matches near it.

Operators: ``encode`` and ``decode`` for whole tables, ``tables`` for the prefix tables and ``edit`` to
apply edits to them.

Defined results: a null text is empty and has no tokens; a null ``doc_id`` stays null; repeated rows are
encoded separately; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from ledgerlens.llm.text import utf8, worker_state

DEFAULT_RANKS = "byte_bpe_50k.tiktoken"
#: Bytes of distinct pre-tokens and their ids that a task holds; then it starts anew (results do not change).
CACHE_BYTES = 100_000_000
#: Bytes of text that leave a task as one Arrow batch.
BATCH_BYTES = 1_000_000
_ENTRY = 200  # bytes of a cache entry besides its ids
#: Pairs of tokens whose agreement a worker remembers.
MAX_PAIRS = 400_000
_NO_RANK = 1 << 62


def ranks_path(name: str = DEFAULT_RANKS) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def default_pattern() -> str:
    import public_tokenizers
    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


class Vocabulary:
    """Tokens of a rank file, which tokens may follow which, and prefix tables."""

    def __init__(self, path: str):
        self.ranks = read_ranks(path)
        self.bytes_of = {i: t for t, i in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self._pairs: dict[int, bool] = {}
        # All tokens that end at a byte, found in one pass over a piece (bytes as Latin-1 letters).
        self._ends = ahocorasick.Automaton()
        for token, i in self.ranks.items():
            self._ends.add_word(token.decode("latin-1"), (len(token), i))
        self._ends.make_automaton()

    def merged(self, data: bytes) -> list[int]:
        """The tokens of a short byte string by the definition: merge the lowest rank, the leftmost first."""
        rank_of, none = self.ranks.get, _NO_RANK
        parts = [data[i:i + 1] for i in range(len(data))]
        low = [rank_of(data[i:i + 2], none) for i in range(len(data) - 1)] + [none]
        while (best := min(low)) < none:
            i = low.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del low[i]
            if i + 1 < len(parts):
                low[i] = rank_of(parts[i] + parts[i + 1], none)
            if i:
                low[i - 1] = rank_of(parts[i - 1] + parts[i], none)
        return [self.ranks[p] for p in parts]

    def _follows(self, first: int, second: int) -> bool:
        """May ``second`` stand behind ``first`` (-1: at the start)? Then merging their bytes gives these two
        tokens."""
        if len(self._pairs) > MAX_PAIRS:
            self._pairs.clear()
        both = [second] if first < 0 else [first, second]
        known = self.merged(b"".join(map(self.bytes_of.__getitem__, both))) == both
        self._pairs[first, second] = known
        return known

    def extend(self, table: array | list[int], data: bytes, until: array | None = None, shift: int = 0) -> int:
        """Add the last tokens of the prefixes of ``data`` that ``table`` lacks; ``table[k]`` is that of the
        first ``k + 1`` bytes.

        ``until`` is an earlier table of a text whose end is the end of ``data``, ``shift`` bytes behind its
        own place: as soon as as many entries as the longest token has are as they were, the rest is taken
        from it. Returns the number of entries worked out.
        """
        begin = done = len(table)
        lead = max(0, begin - self.longest)
        equal, known = 0, self._pairs.get
        for end, (size, token) in self._ends.iter(data[lead:].decode("latin-1")):
            end += lead
            if end < done:
                continue  # known, or found by a longer token that ends here
            start = end - size
            if start < -1:
                continue
            pair = (table[start] if start >= 0 else -1, token)
            fits = known(pair)
            if fits or fits is None and self._follows(*pair):
                table.append(token)
                done = end + 1
                if until is not None:
                    old = end - shift
                    equal = equal + 1 if old >= 0 and until[old] == token else 0
                    if equal >= self.longest:
                        table.extend(until[old + 1:])
                        return done - begin
        if len(table) != len(data):
            raise ValueError("the vocabulary lacks a byte of the text")
        return done - begin

    def tokens(self, table: array | list[int]) -> list[int]:
        """The encoding that a prefix table stands for."""
        out, at = [], len(table)
        while at:
            out.append(table[at - 1])
            at -= len(self.bytes_of[out[-1]])
        out.reverse()
        return out

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        table: list[int] = []
        self.extend(table, data)
        return self.tokens(table)


class Encoder(dict):
    """Ids (as bytes of unsigned 32-bit numbers) of pre-tokens, each distinct one worked out once."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        self.vocabulary = Vocabulary(path)
        self.find = regex.compile(pattern).findall
        self.held = 0

    def __missing__(self, piece: str) -> bytes:
        ids = array("I", self.vocabulary.encode_piece(utf8(piece))).tobytes()
        if len(ids) < 1024:  # long ones hardly come again
            if self.held > CACHE_BYTES:
                self.clear()
                self.held = 0
            self[piece] = ids
            self.held += _ENTRY + 2 * len(ids)
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, self.find(text or ""))), dtype="<u4")


def _encoder(path: str, pattern: str) -> Encoder:
    return worker_state(("bpe", path, pattern), lambda: Encoder(path, pattern))


class Decoder:
    """Bytes of ids: all tokens end to end, gathered by position."""

    def __init__(self, path: str):
        table = {i: token for token, i in read_ranks(path).items()}
        size = max(table) + 1
        self.lengths = np.array([len(table.get(i, b"")) for i in range(size)], dtype=np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.flat = np.frombuffer(b"".join(table.get(i, b"") for i in range(size)), dtype=np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        n = self.lengths[ids]
        ends = np.cumsum(n)
        if not len(ends) or not ends[-1]:
            return b""
        return self.flat[np.repeat(self.starts[ids] - ends + n, n) + np.arange(ends[-1])].tobytes()


def _id_batches(keys: pa.Array, rows: Iterator[np.ndarray], kind: pa.Schema, limit: int) -> Iterator[pa.RecordBatch]:
    """Batches ``(key, ids)`` of at most about ``limit`` ids."""
    low, held, size = 0, [], 0
    for k, ids in enumerate(rows):
        held.append(ids)
        size += len(ids)
        if size >= limit or k == len(keys) - 1:
            ends = np.cumsum([0, *map(len, held)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(held).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([keys[low:k + 1], lists.cast(kind.field(1).type)], schema=kind)
            low, held, size = k + 1, [], 0


def _schema(text: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    return to_arrow_schema(_parse_datatype_string(text))


def encode(docs: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """Per document: ``doc_id, ids`` (array of int), the encoding of its whole text.

    ``ranks`` is the path of a rank file readable on every executor."""
    path, cut = ranks or ranks_path(), pattern or default_pattern()
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>"
    kind = _schema(schema)

    def run(batches):
        encoder = _encoder(path, cut)
        for batch in batches:
            if batch.num_rows:
                yield from _id_batches(batch.column(0), (encoder.encode(t.as_py()) for t in batch.column(1)), kind,
                                       BATCH_BYTES // 4)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks: str | None = None) -> DataFrame:
    """``doc_id, ids, bytes``: the bytes that ids stand for; null ids give null bytes."""
    path = ranks or ranks_path()
    schema = f"doc_id {dict(encoded.dtypes)['doc_id']}, ids array<int>, bytes binary"
    kind = _schema(schema)

    def run(batches):
        decoder = Decoder(path)
        for batch in batches:
            ids = batch.column(1)
            out = [None if not i.is_valid else decoder.decode(i.values.to_numpy(zero_copy_only=False)) for i in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), ids.cast(kind.field(1).type), pa.array(out, pa.binary())],
                                             schema=kind)

    return encoded.select("doc_id", "ids").mapInArrow(run, schema)


class PrefixText:
    """A text with the ends of its pre-tokens (in characters) and their prefix tables, end to end."""

    def __init__(self, vocabulary: Vocabulary, pattern: regex.Pattern, text: str = "",
                 ends: array | None = None, last: array | None = None):
        self.vocabulary, self.pattern = vocabulary, pattern
        self.text, self.ends, self.last = "", array("i"), array("i")
        self.worked = 0  # prefix entries worked out so far
        if ends is None:
            self.append(text)
        else:
            self.text, self.ends, self.last = text, ends, last

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> None:
        """Put ``new`` in the place of the characters from ``start`` to before ``end``."""
        old_text, old_ends = self.text, self.ends
        self.text = old_text[:start] + new + old_text[end:]
        shift = len(new) - (end - start)
        # Matches that end two characters before the edit, and those before them, stay.
        keep = int(np.searchsorted(np.frombuffer(old_ends, dtype=np.int32) if old_ends else np.zeros(0, np.int32),
                                   start - 2, side="right"))
        at = old_ends[keep - 1] if keep else 0
        ends, pieces, meet = array("i", old_ends[:keep]), [], len(old_ends)
        later, old = {e: k for k, e in enumerate(old_ends[keep:], keep) if e >= end}, at
        # A match that begins where one began before, behind the edit: all matches from there on stay.
        for m in self.pattern.finditer(self.text, at):
            if m.start() - shift in later and m.start() >= start + len(new):
                meet, old = later[m.start() - shift] + 1, m.start() - shift
                break
            pieces.append(m.span())
            ends.append(m.end())
        else:
            old = len(old_text)
        byte_at = len(utf8(old_text[:at]))
        byte_old = byte_at + len(utf8(old_text[at:old]))
        before, middle = self._tables(old_text, at, old, old_ends, keep, byte_at), array("i")
        for a, b in pieces:
            data, table, known, moved = utf8(self.text[a:b]), array("i"), None, 0
            # The piece that holds the edit: its part before the edit is known, and so is its end.
            if a in before and start >= a:
                was, was_end = before[a]
                table = array("i", was[:len(utf8(self.text[a:min(start, b)]))])
                if b - shift == was_end and end <= was_end:
                    known, moved = was, len(data) - len(was)
            if len(table) < len(data):
                rest = len(data) - len(utf8(self.text[start + len(new):b])) if known is not None else 0
                if known is not None and rest > len(table):
                    self.worked += self.vocabulary.extend(table, data[:rest])
                self.worked += self.vocabulary.extend(table, data, known, moved)
            middle.extend(table)
        self.last = self.last[:byte_at] + middle + self.last[byte_old:]
        ends.extend(e + shift for e in old_ends[meet:])
        self.ends = ends

    def _tables(self, text: str, at: int, to: int, ends: array, keep: int, byte: int) -> dict[int, tuple[array, int]]:
        """Start -> (prefix table, end) of the matches from ``at`` to ``to``."""
        out = {}
        while at < to:
            end = ends[keep]
            size = len(utf8(text[at:end]))
            out[at] = self.last[byte:byte + size], end
            at, byte, keep = end, byte + size, keep + 1
        return out

    def ids(self) -> list[int]:
        out, at, byte = [], 0, 0
        for end in self.ends:
            data = utf8(self.text[at:end])
            whole = self.vocabulary.ranks.get(data)
            out += [whole] if whole is not None else self.vocabulary.tokens(self.last[byte:byte + len(data)])
            at, byte = end, byte + len(data)
        return out


_TABLES = "doc_id {id}, text string, ends array<int>, last array<int>, ids array<int>, worked long"


def _run_texts(df: DataFrame, columns: list[str], ranks: str | None, pattern: str | None, make) -> DataFrame:
    path, cut = ranks or ranks_path(), pattern or default_pattern()
    schema = _TABLES.format(id=dict(df.dtypes)["doc_id"])
    kind = _schema(schema)

    def run(batches):
        vocabulary, compiled = _encoder(path, cut).vocabulary, regex.compile(cut)
        for batch in batches:
            for k in range(batch.num_rows):
                row = [batch.column(c)[k].as_py() for c in range(batch.num_columns)]
                t = make(vocabulary, compiled, *row[1:])
                one = [[row[0]], [t.text], [list(t.ends)], [list(t.last)], [t.ids()], [t.worked]]
                yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(one, kind)], schema=kind)

    return df.select(*columns).mapInArrow(run, schema)


def tables(docs: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """Per document: ``doc_id, text, ends, last, ids, worked``: ends of the pre-tokens, the last token of each
    byte prefix of a pre-token, the encoding, and how many entries of ``last`` were worked out for it."""
    return _run_texts(docs, ["doc_id", "text"], ranks, pattern,
                      lambda v, p, text: PrefixText(v, p, text or ""))


def edit(stored: DataFrame, edits: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """``tables`` of the edited texts, worked out near the edits only.

    ``edits``: ``doc_id, start, end, new`` in characters, applied to a text from the last place to the first
    (of equal places, the longer cut first). Places beyond a text are its end, a null place is its end (an
    append), a null ``new`` is empty. Documents without edits stay; edits of no document are ignored.
    """
    size = F.lit(2 ** 31 - 1)
    row = F.struct(F.coalesce("start", size).alias("start"), F.coalesce("end", "start", size).alias("end"),
                   F.coalesce("new", F.lit("")).alias("new"))
    # All edits of one text meet in its row, as its text does.
    wanted = edits.groupBy(F.col("doc_id").alias("_doc")).agg(F.sort_array(F.collect_list(row), asc=False).alias("_edits"))
    df = stored.join(wanted, F.col("doc_id").eqNullSafe(F.col("_doc")), "left")

    def make(vocabulary, pattern, text, ends, last, changes):
        t = PrefixText(vocabulary, pattern, text or "", array("i", ends or []), array("i", last or []))
        for c in changes or []:
            n = len(t.text)
            start = min(max(c["start"], 0), n)
            t.replace(start, min(max(c["end"], start), n), c["new"])
        return t

    return _run_texts(df, ["doc_id", "text", "ends", "last", "_edits"], ranks, pattern, make)
