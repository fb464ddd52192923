"""Vectorised hashing of words and byte strings inside a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes hashed at once; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 20

_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    known = _powers.get(int(base))
    if known is None or len(known) < n:
        steps = np.full(max(n, CHUNK_BYTES + 1), base)
        steps[0] = 1
        known = _powers[int(base)] = np.multiply.accumulate(steps)
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values one to one."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


BYTE_VALUES = mix(np.arange(1, 257, dtype=_U))


class Rolling:
    """64-bit fingerprints of any stretch of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray):
        self.sums = np.zeros(len(values) + 1, _U)
        np.cumsum(values * _power(_BASE, len(values)), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        inverse = _power(_BASE_INVERSE, len(self.sums))
        return mix((self.sums[end] - self.sums[start]) * inverse[start])

    def windows(self, size: int) -> np.ndarray:
        """Of each window of ``size`` values."""
        if len(self.sums) <= size:
            return np.zeros(0, _U)
        span = self.sums[size:] - self.sums[:-size]
        return mix(span * _power(_BASE_INVERSE, len(span)))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    if span < width:
        values = np.minimum(values[: span - width], values[width - span :])
    return values


class Texts:
    """Texts laid end to end: their bytes and where each one begins."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    @classmethod
    def chunks(cls, column: pa.Array, limit: int | None = None) -> Iterator[tuple[int, int, Texts]]:
        """(first row, end row, texts) of runs of rows with about ``limit`` bytes."""
        column, limit = column.cast(pa.large_string()), limit or CHUNK_BYTES
        n = len(column)
        if not n:
            return
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        low = 0
        while low < n:
            high = int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1
            high = min(n, max(high, low + 1))
            yield low, high, cls(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
            low = high

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end byte of each word, and the number of the first word of each text (and the total)."""
        data = self.data
        inside = np.ones(len(data) + 2, bool)
        inside[0] = inside[-1] = False
        inside[1:-1] = (data != 32) & ((data < 9) | (data > 13))
        edge = inside[1:] & ~inside[:-1]  # a word begins at byte i
        after = inside[:-1] & ~inside[1:]  # a word ends before byte i
        cut = self.offsets[1:-1]
        cut = cut[(cut > 0) & (cut < len(data))]
        cut = cut[inside[cut] & inside[cut + 1]]  # the end of a text inside a run of word bytes
        edge[cut] = after[cut] = True
        starts, ends = np.flatnonzero(edge), np.flatnonzero(after)
        return starts, ends, np.searchsorted(starts, self.offsets)

    def word_hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """64-bit hash of each word, and the number of the first word of each text (and the total)."""
        starts, ends, first = self.words()
        hashes = np.zeros(len(starts), _U)
        low = 0
        while low < len(starts):  # in parts, so that memory stays small for a long text
            high = max(low + 1, int(np.searchsorted(ends, starts[low] + 2 * CHUNK_BYTES, "right")))
            base = starts[low]
            part = Rolling(BYTE_VALUES[self.data[base : ends[high - 1]]])
            hashes[low:high] = part.of(starts[low:high] - base, ends[low:high] - base)
            low = high
        return hashes, first
