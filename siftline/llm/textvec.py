"""Vectorised text helpers on Arrow buffers: words, hashes and small blocks of rows.

All functions work on whole texts. A block holds about ``BLOCK`` bytes (one longer text is a block
of its own), so numpy temporaries stay small whatever the size of an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 18

#: The bytes that separate words, U+0009 to U+000D and U+0020.
SPACES = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20)
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[list(SPACES)] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_BASE = 0x9E3779B97F4A7C13
_MASK = (1 << 64) - 1
_MIX1 = np.uint64(0xFF51AFD7ED558CCD)
_MIX2 = np.uint64(0xC4CEB9FE1A85EC53)
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (murmur3's finaliser)."""
    h = h ^ (h >> np.uint64(33))
    h = h * _MIX1
    h ^= h >> np.uint64(33)
    h = h * _MIX2
    h ^= h >> np.uint64(33)
    return h


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An order-dependent hash of two hashes."""
    return mix(a * np.uint64(0x9DDFEA08EB382D69) + b + np.uint64(0x632BE59BD9B4E019))


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, 2 * BLOCK)
        have = np.empty(size, dtype=np.uint64)
        have[0] = 1
        done, step = 1, np.uint64(base)
        while done < size:
            more = min(done, size - done)
            have[done : done + more] = have[:more] * step
            done += more
            step = step * step
        _powers[name] = have
    return have


class Prefix:
    """Rolling hashes of any slices of one buffer, equal for equal bytes wherever they stand."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        with np.errstate(over="ignore"):
            terms = (data.astype(np.uint64) + np.uint64(1)) * _power("up", _BASE, n + 1)[:n]
            self.sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(terms, out=self.sums[1:])
            self.down = _power("down", pow(_BASE, -1, 1 << 64), n + 1)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])

    def windows(self, width: int) -> np.ndarray:
        """The hash of every slice of ``width`` bytes, by start."""
        n = len(self.sums) - width
        if n <= 0:
            return np.empty(0, dtype=np.uint64)
        with np.errstate(over="ignore"):
            return mix((self.sums[width:] - self.sums[:n]) * self.down[:n])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column and its n + 1 offsets; nulls become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if pa.types.is_null(column.type):
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    if column.null_count:
        empty = b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else ""
        column = pc.fill_null(column, empty)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of about ``limit`` bytes each."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def each_block(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets from 0) for each block of a column."""
    data, offsets = buffers(column)
    for a, b in blocks(offsets, limit):
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (runs of bytes other than ``SPACES``), and each text's range in them, as n + 1 bounds."""
    n = len(data)
    inside = IS_WORD[data]
    first = inside.copy()
    last = inside.copy()
    if n:
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < n)]
        first[edges] = inside[edges]
        last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def owner(bounds: np.ndarray) -> np.ndarray:
    """The row of each element, from n + 1 bounds."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def sums_by(bounds: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Per row, the sum of an integer or boolean array over its range."""
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
