"""Helpers shared by the text operators: word splitting on UTF-8 bytes, Arrow batches, hash folds.

Words are cut on the UTF-8 bytes: every byte of a non-ASCII character is 0x80 or more, so classes
that only name ASCII characters split bytes and characters at the same places.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

_ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256))


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def space_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of anything but space and the controls 0x09-0x0D."""
    return utf8(text).lower().split()


def alnum_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of ASCII letters, digits and non-ASCII characters."""
    return utf8(text).translate(_ALNUM).split()


def fold(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text (fold 0)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


_state: list = [None, None]


def worker_state(key: tuple, make: Callable[[], object]):
    """The tables and caches of the operator at work in this Python worker.

    Workers live on from task to task and from stage to stage. What one operator has built serves its next
    task; as soon as another operator asks for its own, the earlier one's goes back to the system, so that a
    worker never holds the caches of two stages."""
    if _state[0] != key:
        _state[:] = [None, None]
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):
            pass  # another C library: freed memory stays with the process
        _state[:] = [key, make()]
    return _state[1]


#: Rows that are Python objects at a time.
SLICE_ROWS = 512


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Parts of the batches: whole texts are copied into Python objects a few at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def map_rows(df: DataFrame, fn: Callable[[list], list[tuple]], schema: str, columns: list[str],
             before: Callable[[], object] | None = None) -> DataFrame:
    """Apply ``fn`` to the value lists of ``columns``, batch by batch; ``fn`` returns output tuples.

    ``before`` runs once per task and its result is passed to ``fn`` as a second argument.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = (before(),) if before else ()
        for batch in slices(batches):
            rows = fn([c.to_pylist() for c in batch.columns], *state)
            if rows:
                yield to_batch(rows, target)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    target = to_arrow_schema(_parse_datatype_string(schema))
    return df.select(*columns).mapInArrow(run, schema)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
