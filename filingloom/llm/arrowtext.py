"""Texts of Arrow batches as flat byte arrays, and words hashed without per-word Python.

A chunk is some consecutive rows of a batch: ``data`` holds their UTF-8 bytes
back to back, ``off`` the n + 1 places where rows begin and end. A null text is
an empty one. Chunks are cut by bytes, so memory per task stays bounded
whatever the row count; a single longer text is a chunk of its own, whole.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19

_U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, nulls as empty texts."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, values = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8)[off[0] : off[-1]] if values is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def release() -> None:
    """Give freed memory back to the system: Spark keeps Python workers for later tasks, with all that they once took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES, most: int = 4096) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, data, off) of at most about ``limit`` bytes of text and ``most`` rows each."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        data, off = flat(batch.column(text))
        first = 0
        while first < batch.num_rows:
            last = min(first + most, batch.num_rows, max(first + 1, int(np.searchsorted(off, off[first] + limit, "right")) - 1))
            yield batch.slice(first, last - first), data[off[first] : off[last]], off[first : last + 1] - off[first]
            first = last
        del batch, data, off
    release()


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, all other bytes kept."""
    return np.where((data - np.uint8(65)) < 26, data | np.uint8(32), data)


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser: spreads every input bit over the word."""
    h = h ^ (h >> _U64(33))
    h = h * _U64(0xFF51AFD7ED558CCD)
    h ^= h >> _U64(33)
    h *= _U64(0xC4CEB9FE1A85EC53)
    h ^= h >> _U64(33)
    return h


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse modulo 2^64; those for a chunk are kept, for longer texts not."""

    def made(size: int) -> list[np.ndarray]:
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, _U64(base), _U64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        return out

    if n > 2 * CHUNK_BYTES:
        return tuple(made(n))
    if not _POWERS:
        _POWERS.extend(made(2 * CHUNK_BYTES))
    return _POWERS[0][:n], _POWERS[1][:n]


def word_bounds(mask: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True bytes, none of which crosses a row."""
    n = len(mask)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = mask.copy()
    begin[1:] &= ~mask[:-1]
    stop = np.zeros(n + 1, bool)
    stop[1:] = mask
    stop[1:n] &= ~mask[1:]
    inner = off[(off > 0) & (off < n)]
    begin[inner] |= mask[inner]
    stop[inner] |= mask[inner - 1]
    return np.flatnonzero(begin), np.flatnonzero(stop)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span: prefix sums of a polynomial, rebased to the span's start."""
    if not len(starts):
        return np.zeros(0, _U64)
    power, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, _U64)
    steps = data.astype(_U64)
    steps += _U64(1)
    steps *= power[:-1]
    np.cumsum(steps, out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(_U64) * _U64(0xD6E8FEB86659FD93))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` consecutive entries, in order; shorter input gives none."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, _U64)
    h = np.full(n, _U64(size), _U64)
    for k in range(size):
        h = (h ^ words[k : k + n]) * _U64(0x9FB21C651E98DF25)
        h ^= h >> _U64(29)
    return mixed(h)


#: Word bytes by rule: not white space (0x20, 0x09-0x0D).
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = False
#: Word bytes by rule: after lower-casing, digits, a-z and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
