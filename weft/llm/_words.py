"""Vectorised words and rolling hashes over Arrow string columns.

A word is a maximal run of bytes outside ``\\x20 \\x09-\\x0D``. Its 64-bit hash is a sum
of its bytes, each times a random number of its place in the word (multilinear
hashing: no rule of the bytes, such as a Thue-Morse order, makes two words alike), then
an avalanche step. Windows of words are hashed by Rabin-Karp: prefix sums over the
words' hashes and powers of an odd base modulo 2**64. A slice of rows is processed at
once, so no Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser; returns a new array."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_WORD = ~_SEPARATOR
_BYTE = np.arange(1, 257, dtype=U)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, SLICE_BYTES + 1)
            for name, b in (("up", self.base), ("down", self.inverse)):
                powers = np.full(n, b, U)
                powers[0] = 1
                setattr(self, name, np.cumprod(powers, dtype=U))


_TOKENS = _Powers(0xD1342543DE82EF95)


class _Places:
    """A random number for each place in a word, grown on demand."""

    def __init__(self) -> None:
        self.at = np.zeros(0, U)

    def reach(self, n: int) -> np.ndarray:
        if len(self.at) < n:
            self.at = mix(np.arange(1, 2 * n + 1, dtype=U) * U(0x9E3779B97F4A7C15))
        return self.at


_PLACES = _Places()


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n+1 offsets; null counts as ''."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of up to ``most`` bytes, or one row."""
    data, at = buffers(column)
    row, rows = 0, len(at) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, side="right")) - 1)
        yield row, end, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each text the index of its first word."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    word = _WORD[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    edge = at[:-1][at[:-1] < n]
    before[edge] = False
    after[edge[edge > 0] - 1] = False
    start, end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    return start, end, np.searchsorted(start, at)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    n = len(data)
    if not len(start):
        return np.zeros(0, U)
    # places count from the start of the word that a byte is in, or that is before it
    begin = np.zeros(n, np.int64)
    begin[start[1:]] = np.diff(start)
    begin[start[0]] = start[0]
    place = np.arange(n) - np.cumsum(begin)
    places = _PLACES.reach(int((end - start).max()))
    total = np.empty(n + 1, U)
    total[0] = 0
    np.cumsum(_BYTE[data] * places.take(place, mode="clip"), out=total[1:])
    return mix(total[end] - total[start])


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of ``words[i:i + width]`` for each i that has a full window."""
    n = len(words)
    if n < width:
        return np.zeros(0, U)
    return span_hashes(words, np.arange(n - width + 1), np.arange(width, n + 1))


def span_hashes(words: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    n = len(words)
    _TOKENS.reach(n + 1)
    total = np.empty(n + 1, U)
    total[0] = 0
    np.cumsum(words * _TOKENS.up[:n], out=total[1:])
    return mix((total[end] - total[first]) * _TOKENS.down[first] + (end - first).astype(U))
