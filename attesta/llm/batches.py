"""Bytes, words and 64-bit hashes of a whole Arrow batch at once.

The texts of a batch lie one after the other in one byte array. Words are maximal runs of bytes other than space and
``\\x09-\\x0D``, A-Z lower-cased where asked; they never run across two texts. A prefix polynomial hash (modulo 2**64, a random value
per byte) gives the hash of any range in constant time.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20


def release_memory() -> None:
    """Gives freed memory back to the system at the end of a task, as a Python worker lives on beside the next one."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values (an invertible finaliser)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_VALUE = mix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))
_POWERS: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, kept between calls."""
    if len(_POWERS[0]) < n:
        size = max(n, CHUNK_BYTES + (1 << 16))
        for i, base in enumerate((_BASE, _INVERSE)):
            table = np.full(size, base, _U)
            table[0] = 1
            _POWERS[i] = np.multiply.accumulate(table)
    return _POWERS[0], _POWERS[1]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """prefix[j] - prefix[i] times the inverse power of i is the polynomial hash of data[i:j]."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, _U)
    np.cumsum(_VALUE[data] * up[: len(data)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Scrambled hash of each range; ranges of other lengths differ as well."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(_U) * _U(0x2545F4914F6CDD1D))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text or binary column and where each row starts and ends; null counts as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole, at


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets in them), about ``limit`` bytes at a time; a longer text comes alone and whole."""
    data, at = column_bytes(column)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(at, at[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, last, data[at[first]: at[last]], at[first: last + 1] - at[first]
        first = last


class Words:
    """Words of a chunk: byte ranges, the row each belongs to, rows' first words, and hashes."""

    def __init__(self, data: np.ndarray, at: np.ndarray, lower: bool = True):
        self.data, self.at = LOWER[data] if lower else data, at
        word = ~SPACE[data]
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        ends = word.copy()
        ends[:-1] &= ~word[1:]
        inner = at[1:-1]
        inner = inner[(inner > 0) & (inner < len(data))]
        begins[inner] = word[inner]
        ends[inner - 1] = word[inner - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, at)
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(len(at) - 1), self.count)

    def hashes(self) -> np.ndarray:
        return range_hash(prefix_hash(self.data), self.start, self.end)

    def texts(self) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[s:e] for s, e in zip(self.start.tolist(), self.end.tolist())]


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` word hashes (over the whole chunk; the caller leaves out runs across rows)."""
    n = max(len(words) - width + 1, 0)
    total = np.zeros(n, _U)
    for i in range(width):
        total += words[i: i + n] * _U((_BASE * (2 * i + 1) + 2 * i * i) % 2**64 | 1)
    return mix(total)


def run_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of values[at[i]:at[i+1]] for each i, zero where empty."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind in "u" and values.dtype.itemsize == 8 else np.int64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]
