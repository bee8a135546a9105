"""Vectorised word handling on Arrow string batches (numpy, inside tasks).

Words are maximal runs of bytes outside ``\\x20 \\x09-\\x0D`` of the UTF-8 text.
Every function works on slices of whole documents of about ``SLICE_BYTES``,
so temporary arrays stay small whatever the Arrow batch holds; one document
longer than that is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_U = np.uint64

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _seeded(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**64, size=n, dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, _U(base))
    out[0] = 1
    return np.multiply.accumulate(out)


class _ByteHash:
    """sum(table[byte] * base**position) mod 2**64; positions split into a low
    and a high power table, so words of any length work."""

    def __init__(self, seed: int):
        self.table = _seeded(seed, 256)
        base = int(_seeded(seed + 1, 1)[0]) | 1
        self.low = _powers(base, 1 << 12)
        self.high = _powers(pow(base, 1 << 12, 2**64), 1 << 12)

    def __call__(self, data: np.ndarray, pos: np.ndarray, first: np.ndarray) -> np.ndarray:
        v = self.table[data]
        v *= self.low[pos & 0xFFF]
        if len(pos) and (big := int(pos.max()) >> 12):
            if big >= len(self.high):
                self.high = _powers(int(self.high[1]), 2 * big)
            v *= self.high[pos >> 12]
        return np.add.reduceat(v, first) if len(first) else np.zeros(0, _U)


_HASHES = {0: _ByteHash(11), 1: _ByteHash(1213)}


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x = x * _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class Words:
    """Words of consecutive documents: byte ``start``/``end`` in ``data``, and
    ``doc``: word index at which each document begins (one more at the end).
    ``gaps`` marks the bytes between words (white space)."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, gaps: np.ndarray = _WHITE):
        self.data, self.bounds = data, bounds
        solid = ~gaps[data]
        begin, end = solid.copy(), solid.copy()
        begin[1:] &= ~solid[:-1]
        end[:-1] &= ~solid[1:]
        inner = bounds[(bounds > 0) & (bounds < len(data))]
        begin[inner] = solid[inner]
        end[inner - 1] = solid[inner - 1]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(end) + 1
        self.doc = np.searchsorted(self.start, bounds)
        self._solid = solid

    def hashes(self, which: int = 0) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, _U)
        length = self.end - self.start
        first = np.cumsum(length) - length
        pos = np.arange(int(length.sum())) - np.repeat(first, length)
        return mix(_HASHES[which](self.data[self._solid], pos, first) + length.astype(_U))

    def coded(self) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Document of every word, its code, and the word behind each code."""
        ends = np.cumsum(np.append(0, self.end - self.start), dtype=np.int64)
        words = pa.LargeStringArray.from_buffers(len(self.start), pa.py_buffer(ends),
                                                 pa.py_buffer(self.data[self._solid])).dictionary_encode()
        which = np.repeat(np.arange(len(self.doc) - 1), np.diff(self.doc))
        return which, words.indices.to_numpy().astype(np.int64), words.dictionary


def windows(h: np.ndarray, n: int, salt: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Order-dependent hash of every ``n`` consecutive word hashes, by doubling
    (document bounds are the caller's affair)."""
    if len(h) < n:
        return np.zeros(0, _U)
    base = salt | 1
    out, done, block, size = None, 0, h, 1
    rest = n
    while rest:
        if rest & 1:
            part = block[done:done + len(h) - n + 1]
            out = part.copy() if out is None else out * _U(pow(base, size, 2**64)) + part
            done += size
        rest >>= 1
        if rest:
            block = block[:len(block) - size] * _U(pow(base, size, 2**64)) + block[size:]
            size *= 2
    return mix(out)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document bounds of an Arrow string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[bounds[0]:bounds[-1]], bounds - bounds[0]


def gaps_but(*ranges: tuple[int, int]) -> np.ndarray:
    """Gaps table of words made of the bytes in ``ranges`` (both ends in)."""
    gaps = np.ones(256, bool)
    for a, b in ranges:
        gaps[a:b + 1] = False
    return gaps


def slices(column: pa.Array, lower: bool = False, limit: int = SLICE_BYTES,
           gaps: np.ndarray = _WHITE) -> Iterator[tuple[int, int, Words]]:
    """(first document, end document, their Words) for runs of documents;
    ``lower`` lower-cases A-Z."""
    data, bounds = text_bytes(column)
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + limit, "right")) - 1)
        part = data[bounds[i]:bounds[j]]
        yield i, j, Words(_LOWER[part] if lower else part, bounds[i:j + 1] - bounds[i], gaps)
        i = j


def ragged(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, one after another."""
    first = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) - np.repeat(first, counts)
