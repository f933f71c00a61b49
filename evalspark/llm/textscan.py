"""Vectorised scans of Arrow text columns inside tasks: words, hashes, rebuilt texts.

All functions work on the UTF-8 bytes of a column at once. White space is the six ASCII characters
``\\x09-\\x0D\\x20``, which never occur inside a multi-byte character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_RANDOM = np.random.Generator(np.random.PCG64(20240611))
TABLES = _RANDOM.integers(1, 1 << 63, size=(2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, index, data = column.buffers()
    offsets = np.frombuffer(index, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of at most ``limit`` bytes of text, or one row, so that scratch arrays stay small."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = buffers(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end
    # Python workers are reused by later stages, so the pool's free pages go back at the end of a task.
    pa.default_memory_pool().release_unused()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each row the number of words before it."""
    solid = ~SPACE[data]
    before, after = np.zeros_like(solid), np.zeros_like(solid)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    filled = offsets[1:] > offsets[:-1]
    before[offsets[:-1][filled]] = False
    after[offsets[1:][filled] - 1] = False
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, table: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span, from one prefix sum over all bytes."""
    values = TABLES[table][LOWER] if lower else TABLES[table]
    n = len(data)
    if not len(starts):
        return np.zeros(0, np.uint64)
    powers = np.cumprod(np.full(n, BASE))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values[data] * powers, out=total[1:])
    back = np.cumprod(np.full(int(starts.max()) + 1, BASE_INVERSE))
    return mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def grams(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of each ``k`` neighbouring items; entry i covers items i to i + k - 1."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, 0xD6E8FEB86659FD93 + seed, np.uint64)
    factor = np.uint64(0x2545F4914F6CDD1D + 2 * seed)
    for j in range(k):
        total = total * factor + hashes[j : j + n]
    return mix(total)


def kept_words(data, offsets, starts, ends, bounds, kept) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of texts made of the kept words, joined by one space."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    chosen = np.flatnonzero(kept)
    last = np.ones(len(chosen), bool)
    last[:-1] = row[chosen[1:]] != row[chosen[:-1]]
    edge = np.zeros(len(data) + 1, np.int8)
    np.add.at(edge, starts[chosen], 1)
    np.add.at(edge, ends[chosen], -1)
    mask = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    out = data.copy()
    gaps = ends[chosen[~last]]
    out[gaps] = 32
    mask[gaps] = True
    count = np.zeros(len(data) + 1, np.int64)
    np.cumsum(mask, out=count[1:])
    return out[mask], count[offsets]


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A string column from bytes and offsets."""
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))).cast(pa.string())
