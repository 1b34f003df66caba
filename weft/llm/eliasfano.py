"""Elias-Fano sequences and a bigram trie in one memory-mapped buffer.

All queries are vectors: many look-ups walk the structure in step.
"""

from __future__ import annotations

import json

import numpy as np

U = np.uint64
SUCCESSOR_BITS = 48
RANK_BITS = 64 - SUCCESSOR_BITS


_ONES, _TOPS = U(0x0101010101010101), U(0x8080808080808080)
_BYTE_SELECT = np.zeros((256, 8), np.int64)  # position of the nth one of a byte
for _b in range(256):
    _at = [k for k in range(8) if _b >> k & 1]
    _BYTE_SELECT[_b, : len(_at)] = _at


def select_in_word(word: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """Position of the nth (from 0) one of each 64-bit word, which has that many."""
    sums = word - ((word >> U(1)) & U(0x5555555555555555))
    sums = (sums & U(0x3333333333333333)) + ((sums >> U(2)) & U(0x3333333333333333))
    sums = ((sums + (sums >> U(4))) & U(0x0F0F0F0F0F0F0F0F)) * _ONES  # ones up to each byte's end
    whole = np.bitwise_count((((nth.astype(U) * _ONES) | _TOPS) - sums) & _TOPS).astype(U) << U(3)
    before = ((sums << U(8)) >> whole) & U(255)
    return whole.astype(np.int64) + _BYTE_SELECT[((word >> whole) & U(255)).astype(np.int64), nth - before.astype(np.int64)]


class EliasFano:
    """A sorted sequence of numbers below ``universe`` in about 2 + log2(u/n) bits
    each: low bits packed, high bits in unary with a rank directory."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        ones = np.bitwise_count(high).astype(np.int64)
        self.rank = np.concatenate([[0], np.cumsum(ones)])
        self.zero_rank = np.arange(len(self.rank), dtype=np.int64) * 64 - self.rank

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        low_bits = max(0, min(56, (universe // max(1, n)).bit_length() - 1))
        low = np.zeros((n * low_bits + 7) // 8 + 8, np.uint8)
        for a in range(0, n, 1 << 16):  # a multiple of 8 values starts at a whole byte
            part = values[a : a + (1 << 16)]
            bits = ((part[:, None] >> np.arange(low_bits, dtype=U)[None, :]) & U(1)).astype(np.uint8).ravel()
            packed = np.packbits(bits, bitorder="little")
            low[a * low_bits // 8 : a * low_bits // 8 + len(packed)] = packed
        tops = (values >> U(low_bits)).astype(np.int64)
        size = (universe - 1 >> low_bits) + 1 + n if universe else n
        bits = np.zeros(-(-(int(size) + 1) // 64) * 64, np.uint8)
        bits[tops + np.arange(n)] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little").view("<u8"))

    def parts(self) -> list[np.ndarray]:
        return [self.low, self.high.view(np.uint8)]

    def _lows(self, i: np.ndarray) -> np.ndarray:
        bit = i * self.low_bits
        words = np.ndarray((len(self.low) - 7,), "<u8", self.low, strides=(1,))
        return (words[bit >> 3] >> (bit & 7).astype(U)) & U((1 << self.low_bits) - 1)

    def _select(self, directory: np.ndarray, nth: np.ndarray, one: bool) -> np.ndarray:
        """Bit position of the nth (from 0) one or zero."""
        block = np.searchsorted(directory, nth, side="right") - 1
        word = self.high[block].astype(U)
        return block * 64 + select_in_word(word if one else ~word, nth - directory[block])

    def get(self, i: np.ndarray) -> np.ndarray:
        top = self._select(self.rank, i, True) - i
        return (top.astype(U) << U(self.low_bits)) | self._lows(i)

    def find(self, x: np.ndarray, least: np.ndarray | None = None, most: np.ndarray | None = None) -> np.ndarray:
        """Index of each x, or -1: successor search from index ``least`` up to ``most``,
        among the values there that share its high bits."""
        out = np.full(len(x), -1, np.int64)
        if not self.n or not len(x):
            return out
        top = (x >> U(self.low_bits)).astype(np.int64)
        inside = top < self.zero_rank[-1]
        top = np.where(inside, top, 0)
        low = np.where(top > 0, self._select(self.zero_rank, np.maximum(top - 1, 0), False) - np.maximum(top - 1, 0), 0)
        high = self._select(self.zero_rank, top, False) - top
        if least is not None:
            low, high = np.maximum(low, least), np.minimum(high, most)
        high = end = np.maximum(low, high)
        want = x & U((1 << self.low_bits) - 1)
        while (open_ := low < high).any():
            middle = (low + high) >> 1
            less = self._lows(np.minimum(middle, self.n - 1)) < want
            low, high = np.where(open_ & less, middle + 1, low), np.where(open_ & ~less, middle, high)
        hit = inside & (low < end)
        hit[hit] = self._lows(low[hit]) == want[hit]
        out[hit] = low[hit]
        return out


class BigramTrie:
    """Contexts, pointers to their successors, successors, and their codes.

    Level 1: sorted context hashes. Pointers: monotone, where a context's
    successors begin. Level 2: successor ids made monotone by their context's rank,
    in a sequence for each 2^RANK_BITS contexts, as no more ranks fit beside an id.
    Codes: quantised probabilities, a byte each, and quantised backoff weights, two
    bytes for each context. A successor is searched between its context's pointers.
    """

    def __init__(self, contexts: EliasFano, pointers: EliasFano, successors: list[EliasFano], codes: np.ndarray, backoff: np.ndarray) -> None:
        self.contexts, self.pointers, self.successors = contexts, pointers, successors
        self.codes, self.backoff = codes, backoff

    @classmethod
    def build(cls, contexts: np.ndarray, first: np.ndarray, successors: np.ndarray, codes: np.ndarray, backoff: np.ndarray) -> BigramTrie:
        """contexts sorted; context k has successors[first[k]:first[k + 1]], sorted."""
        parts = []
        for a in range(0, len(contexts), 1 << RANK_BITS):
            edges = first[a : a + (1 << RANK_BITS) + 1]
            rank = np.repeat(np.arange(len(edges) - 1, dtype=U), np.diff(edges))
            parts.append(EliasFano.build((rank << U(SUCCESSOR_BITS)) | successors[edges[0] : edges[-1]], len(edges) - 1 << SUCCESSOR_BITS))
        return cls(
            EliasFano.build(contexts, 1 << 64),
            EliasFano.build(first.astype(U), int(first[-1]) + 1),
            parts,
            codes.astype(np.uint8),
            backoff.astype("<u2"),
        )

    def look_up(self, contexts: np.ndarray, owner: np.ndarray, successors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(code of each successor in contexts[owner], backoff code of each context).

        Code 0: not in the trie; backoff code 0: an unknown context.
        """
        rank = self.contexts.find(contexts)
        backoff = np.where(rank >= 0, self.backoff[np.maximum(rank, 0)] if len(self.backoff) else 0, 0).astype("<u2")
        code = np.zeros(len(owner), np.uint8)
        own = rank[owner]
        at = np.flatnonzero(own >= 0)
        at = at[np.argsort(own[at] >> RANK_BITS, kind="stable")]  # by part
        own = own[at]
        known = np.flatnonzero(rank >= 0)
        first, last = np.zeros((2, len(rank)), np.int64)
        first[known], last[known] = self.pointers.get(rank[known]), self.pointers.get(rank[known] + 1)
        first, last = first[owner[at]], last[owner[at]]
        key = (own.astype(U) << U(SUCCESSOR_BITS)) | successors[at]  # the rank's leading bits fall out: they number the part
        begin = self.pointers.get(np.arange(len(self.successors)) << RANK_BITS).astype(np.int64)
        cuts = np.searchsorted(own >> RANK_BITS, np.arange(len(self.successors) + 1))
        for k, level in enumerate(self.successors):
            mine = slice(cuts[k], cuts[k + 1])
            found = level.find(key[mine], first[mine] - begin[k], last[mine] - begin[k])
            hit = np.flatnonzero(found >= 0)
            code[at[mine][hit]] = self.codes[found[hit] + begin[k]]
        return code, backoff

    def tofile(self, file) -> None:
        levels = (self.contexts, self.pointers, *self.successors)
        arrays = [a for level in levels for a in level.parts()] + [self.codes, self.backoff.view(np.uint8)]
        header = json.dumps({"levels": [[level.n, level.low_bits] for level in levels], "bytes": [len(a) for a in arrays]}).encode()
        file.write(len(header).to_bytes(8, "little") + header)
        for a in arrays:
            file.write(a.tobytes())
        file.flush()

    @classmethod
    def open(cls, path) -> BigramTrie:
        """Memory-map a file that ``tofile`` wrote."""
        data = np.memmap(path, np.uint8, "r")
        size = int.from_bytes(data[:8].tobytes(), "little")
        header, at = json.loads(data[8 : 8 + size].tobytes()), 8 + size
        arrays = []
        for n in header["bytes"]:
            arrays.append(data[at : at + n])
            at += n
        unaligned = lambda a, kind: np.ndarray((len(a) // np.dtype(kind).itemsize,), kind, a)
        levels = [EliasFano(n, bits, arrays[2 * k], unaligned(arrays[2 * k + 1], "<u8")) for k, (n, bits) in enumerate(header["levels"])]
        return cls(*levels[:2], levels[2:], arrays[-2], unaligned(arrays[-1], "<u2"))
