"""Periodic runs of words by the runs theorem.

A run is a stretch with a smallest period p, at least two periods long, that no
neighbour extends. By the theorem each run has a Lyndon root that is the longest
Lyndon word from its place on, under an order of the words or under the reverse order.
The longest Lyndon word from a place on ends at the next smaller value of the inverse
suffix array, and at the next greater one for the reverse order. So there are two
candidates (place, period) for each word; each is extended to both sides by the longest
common prefix and suffix, which are range minima of the LCP arrays of the text and of its
reverse, answered by sparse tables. Candidates that come to two periods are all
the runs; ``least`` and ``times`` keep those of that length and that many periods.

Texts of a batch are worked as one sequence with a separator of its own after each,
which no run can hold. A run of ``least`` words and ``times`` periods repeats a window of
``least - least // times`` words (at least, and inside its text); texts that repeat none
have no run and are left out beforehand.

A null text has no words. Rows that repeat an id, or have none, are documents of their
own; a null id's decimal form is ''. An empty table gives an empty result. Columns other
than doc_id and text are not read, so none can clash. Words are told apart by 64-bit
hashes. A text is worked whole, in some 500 bytes a word.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._spark import small_batches
from ._words import bounds, slices, window_hashes, word_hashes

LEAST = 24
TIMES = 3


def suffix_array(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix array, inverse, LCP of each suffix and the one before it) of ``x`` by
    doubling; only suffixes that are not yet told apart are sorted again. ``x`` ends in
    a value that it holds once."""
    n = len(x)
    order = np.argsort(x, kind="stable")
    new = np.append(True, x[order][1:] != x[order][:-1])
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # a class is named by the place of its first suffix
    at = np.flatnonzero(~(new & np.append(new[1:], True)))  # places of classes of more than one suffix
    levels, width = [rank.copy()], 1
    while len(at):
        suffix = order[at]
        own, follow = rank[suffix], rank[suffix + width]  # equal so far, so neither reaches the end
        by = np.lexsort((follow, own))
        suffix, own, follow = suffix[by], own[by], follow[by]
        order[at] = suffix
        new = np.append(True, (own[1:] != own[:-1]) | (follow[1:] != follow[:-1]))
        rank[suffix] = np.maximum.accumulate(np.where(new, at, 0))
        levels.append(rank.copy())
        at = at[~(new & np.append(new[1:], True))]
        width *= 2
    # classes of a level agree in its width: lengths are found from the widest one down
    a, b, same = order[1:], order[:-1], np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        u, v = a + same, b + same
        inside = np.maximum(u, v) < n
        same[inside & (levels[k].take(u, mode="clip") == levels[k].take(v, mode="clip"))] += 1 << k
    return order, rank, np.append(0, same)


class Minima:
    """Sparse table: the least value of any range in two look-ups."""

    def __init__(self, values: np.ndarray) -> None:
        self.levels, width = [values.astype(np.int32)], 1
        while 2 * width <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-width], last[width:]))
            width *= 2
        self.base = np.cumsum([0, *map(len, self.levels[:-1])])
        self.flat = np.concatenate(self.levels)

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Least of values[low:high]; each range holds a value."""
        level = np.frexp((high - low).astype(np.float64))[1].astype(np.int64) - 1
        base = self.base[level]
        return np.minimum(self.flat[base + low], self.flat[base + high - (1 << level)])

    def next_smaller(self) -> np.ndarray:
        """For each place the next one with a smaller value, or the number of places."""
        own = self.levels[0]
        at = np.arange(1, len(own) + 1)
        for k in range(len(self.levels) - 1, -1, -1):
            low = self.levels[k]
            at += ((at < len(low)) & (low.take(at, mode="clip") > own)).astype(np.int64) << k
        return at


class Extensions:
    """Longest common prefixes of any two suffixes of ``x``."""

    def __init__(self, x: np.ndarray) -> None:
        _, self.rank, lcp = suffix_array(x)
        self.minima = Minima(lcp)

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """``i`` and ``j`` differ and lie inside."""
        a, b = self.rank[i].astype(np.int64), self.rank[j].astype(np.int64)
        return self.minima.of(np.minimum(a, b) + 1, np.maximum(a, b) + 1).astype(np.int64)


def find_runs(x: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs of ``x`` that are ``least`` long and ``times``
    (2 or more) periods, by start and period. The first and the last value of ``x`` stand nowhere else."""
    n, far = len(x), Extensions(x)
    end = [Minima(far.rank).next_smaller(), Minima(-far.rank).next_smaller()]
    place, period = np.tile(np.arange(n), 2), np.concatenate(end) - np.tile(np.arange(n), 2)
    some = (period * times <= n) & (place + period < n) & (place > 0)
    place, period = place[some], period[some]
    ahead = far.of(place, place + period)
    back = Extensions(x[::-1].copy()).of(n - place, n - place - period)  # what ends before either place
    length = back + period + ahead
    some = length >= np.maximum(least, times * period)
    found = np.unique(np.stack([place - back, period, length])[:, some], axis=1)
    return found[0], found[2], found[1]


def crc_repeats(doc_id: int | None, words: int) -> np.ndarray | None:
    """Repeats in a tenth of the texts, named by the id's crc32: the words from one place
    on become repetitions of the first ones there. Which word stands at each place."""
    h = zlib.crc32(b"" if doc_id is None else b"%d" % doc_id)
    if h % 10 or not words:
        return None
    a, each = h // 10 % words, 3 + h // 10 % 8
    at = np.arange(words)
    at[a:] = a + (at[a:] - a) % (1 + (words - a) // each)
    return at


_SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _described(start: np.ndarray, length: np.ndarray, period: np.ndarray) -> tuple:
    """Number of runs, the run of most periods, and the digest of all."""
    text = "".join(f"{s},{n},{p}\n" for s, n, p in zip(start.tolist(), length.tolist(), period.tolist()))
    digest = hashlib.sha256(text.encode()).hexdigest()
    if not len(start):
        return 0, None, None, None, None, digest
    # quotients of whole numbers below 2**26 are equal, or differ, as doubles too
    best = np.lexsort((period, start, -(length / period)))[0]
    s, n, p = int(start[best]), int(length[best]), int(period[best])
    return len(start), s, n, p, 1000 * n // p, digest


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES, repeats=None) -> DataFrame:
    """Runs of every row's words, and the digest of the words that stay when of each run
    only the first period is kept. ``repeats`` (id, number of words) may name which word
    stands at each place, as ``crc_repeats`` does."""
    window = least - least // times

    def work(ids: list, data: np.ndarray, at: np.ndarray) -> Iterator[tuple]:
        start, end, first = bounds(data, at)
        hashes = word_hashes(data, start, end)
        moved = [repeats(i, int(n)) if repeats else None for i, n in zip(ids, np.diff(first))]
        for k, own in enumerate(moved):
            if own is not None:
                hashes[first[k] : first[k + 1]] = hashes[first[k] : first[k + 1]][own]
        wide = window_hashes(hashes, window)
        some = []
        for k in range(len(ids)):
            own = np.sort(wide[first[k] : max(first[k], first[k + 1] - window + 1)])
            if (own[1:] == own[:-1]).any():
                some.append(k)
        found = {}
        if some:
            # a value of its own before the first text and after each
            size = np.array([first[k + 1] - first[k] for k in some])
            symbols = np.unique(np.concatenate([hashes[first[k] : first[k + 1]] for k in some]), return_inverse=True)[1]
            origin = 1 + np.cumsum(size + 1) - (size + 1)
            x = np.arange(len(symbols), 2 * len(symbols) + len(some) + 1)
            x[np.arange(len(symbols)) + np.repeat(origin - np.cumsum(size) + size, size)] = symbols
            runs = np.stack(find_runs(x, least, times))
            cut = np.searchsorted(runs[0], np.append(origin, len(x)))
            for k, o, a, b in zip(some, origin, cut[:-1], cut[1:]):
                if b > a:
                    found[k] = runs[0, a:b] - o, runs[1, a:b], runs[2, a:b]
        nothing = (np.zeros(0, np.int64),) * 3
        for k, i in enumerate(ids):
            own = data[at[k] : at[k + 1]].tobytes().split()
            s, n, p = found.get(k, nothing)
            if moved[k] is not None or len(s):
                gone = np.zeros(len(own) + 1, np.int64)
                np.add.at(gone, s + p, 1)
                np.add.at(gone, s + n, -1)
                stays = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
                own = [own[j] for j in (stays if moved[k] is None else moved[k][stays]).tolist()]
            yield i, *_described(s, n, p), hashlib.sha256(b" ".join(own)).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, at in slices(batch.column(1)):
                rows = list(zip(*work(batch.column(0)[row:end].to_pylist(), data, at)))
                types = [pa.int64()] * 6 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names=[c.split()[0] for c in _SCHEMA.split(", ")])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, _SCHEMA)


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    return periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), repeats=crc_repeats)
