"""Vectorised helpers on Arrow text batches, shared by the text operators.

Texts stay UTF-8 bytes in Arrow buffers; words, lines and windows are found and
hashed with numpy over many documents at once. A batch is cut into blocks of
about ``BLOCK_BYTES`` so that temporary arrays stay small; one longer document
is a block of its own. No state is shared between blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

_U = np.uint64
#: Odd multiplier of the polynomial hash and its inverse modulo 2**64.
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)
#: One random odd 64-bit value for each byte.
_BYTE = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_pow = np.ones(1, np.uint64)
_ipow = np.ones(1, np.uint64)

#: Bytes that separate words: space and tab to carriage return.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII upper case to lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: First byte of a code point (not a continuation byte).
LEADING = np.ones(256, bool)
LEADING[0x80:0xC0] = False


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the multiplier and of its inverse, grown by doubling."""
    global _pow, _ipow
    while len(_pow) <= n:
        k = len(_pow)
        _pow = np.concatenate([_pow, _pow * _U(pow(_P, k, 1 << 64))])
        _ipow = np.concatenate([_ipow, _ipow * _U(pow(_PINV, k, 1 << 64))])
    return _pow, _ipow


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of a 64-bit hash over all bits."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def spans_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    off = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``most`` bytes."""
    raw, off = spans_of(column)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def window_hash(b: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` bytes from each position on (the last k - 1 are of no use)."""
    n = len(b)
    if n < k:
        return np.zeros(0, np.uint64)
    out, shift, block, size = None, 0, _BYTE[b], 1
    while k:
        if k & 1:
            part = block[shift:]
            out = part.copy() if out is None else out[: len(part)] * _U(pow(_P, size, 1 << 64)) + part
            shift += size
        k >>= 1
        if k:
            block = block[:-size] * _U(pow(_P, size, 1 << 64)) + block[size:]
            size *= 2
    return mix(out)


def slice_hash(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each slice, wherever it lies."""
    up, down = _powers(len(b))
    sums = np.empty(len(b) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[b] * up[: len(b)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def running_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the run of 64-bit values from each start to its end."""
    up, down = _powers(len(values))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)], dtype=np.uint64)])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


class Words:
    """The words of a block: first and end byte, document and 64-bit hash."""

    def __init__(self, b: np.ndarray, off: np.ndarray, lower: bool = False):
        n = len(b)
        word = np.empty(n + 2, bool)
        word[0] = word[-1] = False
        np.logical_not(SEPARATOR[b], out=word[1:-1])
        inner = word[1:-1]
        first, last = inner & ~word[:-2], inner & ~word[2:]
        cuts = off[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        first[cuts] = inner[cuts]
        last[cuts - 1] = inner[cuts - 1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        #: Words of document d are from[d] to from[d + 1].
        self.bounds = np.searchsorted(self.start, off)
        self.count = np.diff(self.bounds)
        self.inner = inner
        up, down = _powers(n)
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE[LOWER[b] if lower else b] * up[:n], out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))

    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word and hash of each run of ``k`` words in one document."""
        m = len(self.hash) - k + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = self.hash[:m].copy()
        for j in range(1, k):
            h *= _U(_P)
            h += self.hash[j : j + m]
        left = np.repeat(self.bounds[1:], self.count)[:m] - np.arange(m)
        at = np.flatnonzero(left >= k)
        return at, mix(h[at])


def per_doc(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many flags are set in each document's bytes (or words)."""
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[off[1:]] - sums[off[:-1]]
