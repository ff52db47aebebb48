"""Vectorised words and word hashes of whole Arrow batches.

A word is a maximal run of bytes other than space and 0x09-0x0D.  Bytes of
UTF-8 sequences are never in that set, so byte runs and code point runs agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE_CODE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_CODE_LOWER = _BYTE_CODE.copy()
_BYTE_CODE_LOWER[65:91] = _BYTE_CODE[97:123]
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


class Words(NamedTuple):
    data: np.ndarray  # bytes of the chunk
    starts: np.ndarray  # first byte of each word
    ends: np.ndarray  # one past the last byte
    bounds: np.ndarray  # words of document i are bounds[i]:bounds[i + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, end to end, and the offset of each row; null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts come to about ``size`` bytes."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end
        row = end


def split_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """The words of the documents that lie end to end in ``data``."""
    size = len(data)
    if size == 0:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(offsets), np.int64))
    inside = ~_SPACE[data]
    before = np.empty(size, bool)
    before[0] = False
    before[1:] = inside[:-1]
    firsts = offsets[:-1]
    before[firsts[firsts < size]] = False
    after = np.empty(size, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    lasts = offsets[1:]
    after[lasts[lasts > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < size:
        size = max(size, CHUNK_BYTES + 1)
        for i, factor in enumerate((_BASE, _INVERSE)):
            table = np.full(size, factor, np.uint64)
            table[0] = 1
            _powers[i] = np.cumprod(table, dtype=np.uint64)
    return _powers[0], _powers[1]


def hash_words(words: Words, lower: bool) -> np.ndarray:
    """A 64-bit hash of each word; ``lower`` takes A-Z as a-z."""
    size = len(words.data)
    power, inverse = _power_tables(size + 1)
    codes = (_BYTE_CODE_LOWER if lower else _BYTE_CODE)[words.data]
    codes *= power[:size]
    sums = np.empty(size + 1, np.uint64)
    sums[0] = 0
    np.cumsum(codes, out=sums[1:])
    return mix((sums[words.ends] - sums[words.starts]) * inverse[words.starts])


def hash_runs(hashes: np.ndarray, length: int, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of every run of ``length`` items; run i begins at item i."""
    count = len(hashes) - length + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    if length <= 8:
        total = np.zeros(count, np.uint64)
        factor = 1
        for j in range(length):
            factor = factor * (_BASE + 2 * seed) % (1 << 64)
            total += hashes[j : j + count] * np.uint64(factor)
        return mix(total)
    base = (_BASE + 2 * seed) % (1 << 64)
    table = np.full(len(hashes) + 1, base, np.uint64)
    table[0] = 1
    power = np.cumprod(table, dtype=np.uint64)
    table = np.full(count, pow(base, -1, 1 << 64), np.uint64)
    table[0] = 1
    inverse = np.cumprod(table, dtype=np.uint64)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * power[:-1], out=sums[1:])
    return mix((sums[length:] - sums[:count]) * inverse)


def text_chunks(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, Words]]:
    """Row ranges of ``batch`` with the words of their texts."""
    data, offsets = flat(batch.column(batch.schema.get_field_index(column)))
    for row, end in chunks(offsets):
        part = offsets[row : end + 1]
        yield row, end, split_words(data[part[0] : part[-1]], part - part[0])
