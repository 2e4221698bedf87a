"""Vectorised text primitives over Arrow string columns.

Texts are handled as one concatenated array per slice of a record batch (bytes
or code points) with row offsets, so that splitting into words, hashing words
and hashing shingles are a handful of numpy passes and hold a bounded amount of
memory: a slice ends at ``SLICE_BYTES`` unless one text alone is longer.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SLICE_BYTES = 1 << 20
#: Texts that one Arrow batch holds at most, unless one row alone is longer; the session's own setting goes before it.
BATCH_BYTES = 4 << 20
_BASE, _LIMIT = 0x9E3779B97F4A7C15 | 1, 1 << 64
_INVERSE = pow(_BASE, -1, _LIMIT)
_powers: dict[str, np.ndarray] = {}


@cache
def _trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # another C library
        return None


def give_back() -> None:
    """Return freed memory to the system: workers are used again by later stages, which should not find it taken."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes where the session has no bound of its own (a batch of long texts is held by the JVM and the worker)."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, str(BATCH_BYTES))


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` with batches bounded by bytes; each task gives its memory back when it ends."""
    bounded_batches(df.sparkSession)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(whole, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def odd_constants(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _power(kind: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        run = np.full(max(n, 2 * SLICE_BYTES), base, np.uint64)
        run[0] = 1
        have = _powers[kind] = np.multiply.accumulate(run)
    return have[:n]


_BYTE_VALUES = odd_constants(256, 77)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and its row offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, index, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(index, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    every = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return every[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive row ranges (first, end, bytes, offsets) of at most ``limit`` bytes or one row."""
    data, offsets = utf8(column)
    rows, at = len(offsets) - 1, 0
    while at < rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a slice, and its row offsets counted in code points."""
    starts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, starts[offsets]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True within each row: starts, ends, and the first run of each row (rows + 1 long)."""
    n = len(inside)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[start:end]; equal spans hash alike in every batch and process."""
    n = len(values)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _power("up", _BASE, n), out=total[1:])
    spans = (total[ends] - total[starts]) * _power("down", _INVERSE, n + 1)[starts]
    return mix64(spans + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE_VALUES[data]


def point_values(points: np.ndarray) -> np.ndarray:
    return mix64(points.astype(np.uint64) + np.uint64(1))


def byte_table(inside: bytes | set[int]) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(inside)] = True
    return table


#: A-Z to a-z and nothing else.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Words between blanks: [^\x20\x09-\x0D]+
BLANK_WORDS = byte_table(set(range(256)) - {32, 9, 10, 11, 12, 13})
#: Words of lower-cased text: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
PLAIN_WORDS = byte_table(set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100)))


def hashed_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every lower-cased word, and the first word of each row (rows + 1 long)."""
    low = LOWER[data]
    starts, ends, first = runs(table[low], offsets)
    return span_hashes(byte_values(low), starts, ends), first


def gram_hashes(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``size``-word shingles of each row (a shorter row that has words: all of them as one)."""
    counts = np.diff(first)
    grams = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    out_first = np.concatenate([[0], np.cumsum(grams)])
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64), out_first
    const = odd_constants(size, 1009)
    full = np.zeros(max(0, n - size + 1), np.uint64)
    for j in range(size):
        full += words[j : j + len(full)] * const[j]
    long_rows = np.repeat(counts >= size, grams)
    at = np.arange(out_first[-1]) - np.repeat(out_first[:-1], grams) + np.repeat(first[:-1], grams)
    out = np.empty(out_first[-1], np.uint64)
    out[long_rows] = full[at[long_rows]]
    for row in np.flatnonzero((counts > 0) & (counts < size)):
        k = counts[row]
        out[out_first[row]] = (words[first[row] : first[row + 1]] * const[:k]).sum(dtype=np.uint64) + np.uint64(k)
    return mix64(out), out_first
