"""Shared helpers: bounded memos and batches of texts, grouped reading of sorted Arrow streams."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions.workers import cut, shared_folder, ship

__all__ = ["arrow_type", "cut", "forgets", "groups", "mapped", "release", "rewritten", "shared_folder", "slices", "string_list", "table", "word_hashes"]

#: Bytes of text handled together inside a Python worker; bounds its memory whatever the Arrow batch holds.
CHUNK_CHARS = 1 << 21
#: Longer keys are never kept in a worker's memo, so a bound on entries bounds the bytes.
MEMO_KEY = 64


_memos: list[Callable[[], None]] = []


def forgets(empty: Callable[[], None]) -> Callable[[], None]:
    """Register what empties a module's memos at the end of a task."""
    _memos.append(empty)
    return empty


_hashes: dict[bytes, int] = {}
_HASHES = 300_000
forgets(_hashes.clear)


def word_hashes(words: list[bytes]) -> list[int]:
    """A 64-bit hash of each word, below 2**63; a bounded memo keeps those of short words."""
    try:
        return list(map(_hashes.__getitem__, words))
    except KeyError:
        pass
    if len(_hashes) > _HASHES:
        _hashes.clear()
    made = {w: int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little") >> 1 for w in set(words) if w not in _hashes}
    found = [made[w] if w in made else _hashes[w] for w in words]
    _hashes.update((w, h) for w, h in made.items() if len(w) <= MEMO_KEY)
    return found


def release() -> None:
    """Empty the memos and hand freed memory back, for workers are kept for other stages."""
    for empty in _memos:
        empty()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def mapped(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema), with the package at hand in the workers, whose memos end with the task."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return ship(df).mapInArrow(whole, schema)


def arrow_type(batch: pa.RecordBatch, name: str) -> pa.DataType:
    return batch.schema.field(name).type


def rewritten(df: DataFrame, text: int, change: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """df with every bounded slice of its batches changed to one of the same columns; text: the text column's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                yield change(batch)

    plain = df.toDF(*(f"in{k}" for k in range(len(df.columns))))  # names with dots can't be passed
    return mapped(plain, run, plain.schema).toDF(*df.columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def string_list(column: pa.Array) -> list[str]:
    """Texts of an Arrow column; null reads as the empty text."""
    return ["" if x is None else x for x in column.to_pylist()]


def slices(batch: pa.RecordBatch, text: str | int, limit: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about `limit` bytes of text (one row at least)."""
    import pyarrow.compute as pc

    if batch.num_rows == 0:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
    total = np.cumsum(sizes)
    begin = 0
    while begin < batch.num_rows:
        floor = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, floor + limit, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of equal `key` from a stream that is sorted by it; callers bound the size of a group."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        keys = np.asarray(batch.column(key))
        edges = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        begin = 0
        for end in [*edges.tolist(), batch.num_rows]:
            k = keys[begin]
            if held and k != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(begin, end - begin))
            last = k
            begin = end
    if held:
        yield pa.Table.from_batches(held)
