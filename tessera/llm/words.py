"""Vectorised splitting of text columns into hashed words, for use inside Spark tasks.

A word is a run of bytes other than space and ``\\t``..``\\r``, with A-Z lower-cased. An Arrow string
column is already one byte buffer with offsets, so a whole batch is split and hashed with a handful of
numpy passes; no Python object is made per word.

Word hashes are 64-bit: each byte is replaced by a fixed random 64-bit value, the values are combined as
a polynomial in an odd multiplier and the result is mixed. Multipliers are odd, hence invertible modulo
2**64, so a word's hash is a difference of two prefix sums times a power of the inverse.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULT = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(int(_MULT), -1, 2**64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.ones(max(n, 1), dtype=np.uint64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(pow(int(base), done, 2**64))
        done += more
    return out


_BLOCK = 1 << 15
_UP, _DOWN = _powers(_MULT, _BLOCK), _powers(_INV, _BLOCK + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    if not len(offsets):
        offsets = np.zeros(1, dtype=np.int64)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]
#: Everything but ASCII letters, digits and bytes of non-ASCII characters separates.
PUNCTUATION = np.array([not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) for b in range(256)])


class Words:
    """The words of a batch of texts: ``start``/``end`` byte places, ``row`` bounds and ``hash``."""

    def __init__(self, column: pa.Array, separators: np.ndarray = _SPACE):
        raw, offsets = text_bytes(column)
        self.raw = _LOWER[raw]
        self.offsets = offsets
        n = len(raw)
        inside = np.ones(n + 2, dtype=bool)
        inside[0] = inside[-1] = False
        inside[1:-1] = ~separators[raw]
        # a row's first byte starts a word even where the row before ends in one
        first = np.zeros(n + 1, dtype=bool)
        first[offsets] = True
        begins = inside[1:-1] & (~inside[:-2] | first[:-1])
        ends = inside[1:-1] & (~inside[2:] | first[1:])
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.bounds = np.searchsorted(self.start, offsets)  # row r has words bounds[r]:bounds[r+1]
        self._hash = None

    def __len__(self) -> int:
        return len(self.start)

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = self.hash_of(self.start, self.end)
        return self._hash

    def hash_of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the byte ranges start:end, both ascending."""
        out = np.empty(len(start), dtype=np.uint64)
        i = 0
        while i < len(start):  # in blocks, so that the temporary arrays stay in the CPU's cache
            lo = start[i]
            j = max(i + 1, int(np.searchsorted(end, lo + _BLOCK, side="right")))
            hi = int(end[j - 1])
            powers, inverse = (_UP, _DOWN) if hi - lo <= _BLOCK else (_powers(_MULT, hi - lo), _powers(_INV, hi - lo + 1))
            part = _BYTE[self.raw[lo:hi]]
            part *= powers[: hi - lo]
            sums = np.zeros(hi - lo + 1, dtype=np.uint64)
            np.cumsum(part, out=sums[1:])
            s, e = start[i:j] - lo, end[i:j] - lo
            out[i:j] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
            i = j
        return out

    def shingles(self, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of every k consecutive words of a row (a shorter row: all its words as one) and their row."""
        h, counts = self.hash, np.diff(self.bounds)
        n = len(counts)
        row = np.repeat(np.arange(n), counts)
        if not len(h):
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        acc = h.copy()
        left = self.bounds[1:][row] - np.arange(len(h))  # words from here to the row's end
        for i in range(1, min(k, len(h))):
            acc[:-i] = np.where(left[:-i] > i, acc[:-i] * _MULT + h[i:], acc[:-i])
        acc = mix(acc)
        at_start = np.zeros(len(h), dtype=bool)
        at_start[self.bounds[:-1][counts > 0]] = True
        keep = (left >= k) | (at_start & (left < k))
        return acc[keep], row[keep]


def distinct_by_row(values: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values in ascending order, and the n + 1 bounds of the rows; rows ascend."""
    values, bounds = values.copy(), np.searchsorted(rows, np.arange(n + 1))
    for a, b in zip(bounds[:-1], bounds[1:]):
        values[a:b].sort()
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    return values[new], np.searchsorted(rows[new], np.arange(n + 1))
