"""Near-duplicate components of SimHash fingerprints by Golay-code fuzzy hashing.

A document's fingerprint has a bit set where more than half of its word shingles'
XXH64 hashes have it set. Distinct fingerprints are the nodes; two link when they
differ in at most two bits.

The 64 bits are three segments of at most 23. Two errors leave one of the three without
any (pigeonhole), and any other segment with two at most. The perfect binary Golay
code [23, 12, 7] hashes such a segment fuzzily: the words one bit away from it, and
itself, decode to one codeword, or to six; two segments at most two bits apart have a
word between them, so they share a codeword's index. Each fingerprint gets a key for
each exact segment and each codeword index of the segment after it: 3 or up to 18 keys.

Fingerprints meet by key, in sorted order, and every link is verified. A task keeps
only a spanning forest of the links it finds. A key of more than ``BUCKET``
fingerprints is not compared pair by pair: its fingerprints meet by the words one bit
away from them instead, which 65 fingerprints at most can share, whatever their
number; all that share one link with each other.

Null texts have no words. A text without words has fingerprint zero and links like any
other. Rows that repeat an id are documents of their own; a null id is no component's
smallest one unless there is none. Equal texts share a fingerprint, so copies are one
node. An empty table gives an empty result. Columns other than doc_id and text are not
read, so none can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._groups import runs
from ._spark import cut, small_batches
from ._words import U, bounds, lower_ascii, mix, slices
from .components import components

WIDTH = 3
SEED = 42
SEGMENTS = ((42, 22), (21, 21), (0, 21))  # (lowest bit, bits)
BUCKET = 1024
LINKS = 1 << 20  # links of a task that are held before they are thinned to a forest
PART = 1 << 18  # shingles hashed at once

# --- fixed values: the XXH64 primes and the Golay code's generator polynomial ---
P1, P2, P3, P4, P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
GENERATOR = 0b110001110101


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << U(by)) | (x >> U(64 - by))


def xxh64_spans(data: np.ndarray, first: np.ndarray, size: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of each span of ``data``, which must end in eight bytes of no span."""
    out = np.empty(len(first), U)
    long = size >= 32
    if long.any():
        view = memoryview(data)
        out[long] = [xxhash.xxh64_intdigest(view[a : a + n], seed) for a, n in zip(first[long].tolist(), size[long].tolist())]
    short = np.flatnonzero(~long)
    at, left = first[short], size[short]
    h = left.astype(U) + U((seed + P5) & (2**64 - 1))
    words = np.lib.stride_tricks.as_strided(data[:8].view("<u8"), (len(data) - 7,), (1,))
    halves = np.lib.stride_tricks.as_strided(data[:4].view("<u4"), (len(data) - 3,), (1,))
    for step in range(3):
        go = np.flatnonzero(left >= 8)
        if not len(go):
            break
        k = _rotated(words[at[go]] * U(P2), 31) * U(P1)
        h[go] = _rotated(h[go] ^ k, 27) * U(P1) + U(P4)
        at[go] += 8
        left[go] -= 8
    go = np.flatnonzero(left >= 4)
    h[go] = _rotated(h[go] ^ (halves[at[go]].astype(U) * U(P1)), 23) * U(P2) + U(P3)
    at[go] += 4
    left[go] -= 4
    for step in range(3):
        go = np.flatnonzero(left > 0)
        h[go] = _rotated(h[go] ^ (data[at[go]].astype(U) * U(P5)), 11) * U(P1)
        at[go] += 1
        left[go] -= 1
    h ^= h >> U(33)
    h *= U(P2)
    h ^= h >> U(29)
    h *= U(P3)
    out[short] = h ^ (h >> U(32))
    return out


def _spaced(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words with one blank after each, eight bytes more, and where each begins."""
    size = end - start + 1
    begin = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(begin[-1] + 8, np.uint8)
    out[: begin[-1]] = np.append(data, np.uint8(32))[np.repeat(start - begin[:-1], size) + np.arange(begin[-1])]
    out[begin[1:] - 1] = 32
    return out, begin


def bit_counts(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many hashes of each run, which begins at ``first``, have each bit set."""
    size = np.diff(np.append(first, len(hashes)))
    parts = -(-size // 255)  # a byte counts to 255
    upto = np.cumsum(parts)
    begin = np.repeat(first - 255 * (upto - parts), parts) + 255 * np.arange(upto[-1])
    count = np.empty((len(first), 8, 8), np.int64)
    for j in range(8):
        lanes = (hashes >> U(j)) & U(0x0101010101010101)
        some = np.add.reduceat(lanes, begin).astype("<u8").view(np.uint8).reshape(-1, 8)
        count[:, :, j] = np.add.reduceat(some.astype(np.int64), upto - parts, axis=0)
    return count.reshape(len(first), 64)


def fingerprints(column: pa.Array, width: int = WIDTH, seed: int = SEED) -> np.ndarray:
    out = np.zeros(len(column), U)
    for row, end, data, at in slices(column):
        start, stop, first = bounds(lower_ascii(data), at)
        if not len(start):
            continue
        stream, begin = _spaced(lower_ascii(data), start, stop)
        words = np.diff(first)
        shingles = np.where(words >= width, words - width + 1, np.minimum(words, 1))
        some = np.flatnonzero(shingles)
        upto = np.concatenate([[0], np.cumsum(shingles[some])])
        low = np.repeat(first[some] - upto[:-1], shingles[some]) + np.arange(upto[-1])
        high = np.minimum(low + width, np.repeat(first[some + 1], shingles[some]))
        hashes = np.empty(upto[-1], U)
        for k in range(0, len(low), PART):
            a, b = begin[low[k : k + PART]], begin[high[k : k + PART]]
            hashes[k : k + PART] = xxh64_spans(stream, a, b - 1 - a, seed)
        over = 2 * bit_counts(hashes, upto[:-1]) > shingles[some][:, None]
        out[row + some] = np.packbits(over, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprinted(docs: DataFrame, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) of every row; ``fp`` holds the fingerprint's 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints(batch.column(1), width, seed).view(np.int64))], names=["doc_id", "fp"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


class Golay:
    """The perfect [23, 12, 7] code: every 23-bit word lies within three bits of one
    codeword, whose upper twelve bits are its index."""

    def __init__(self) -> None:
        message = np.arange(4096)
        rest = message << 11
        for k in range(22, 10, -1):
            rest = np.where(rest >> k & 1, rest ^ (GENERATOR << (k - 11)), rest)
        self.parity = rest
        bit = 1 << np.arange(23)
        one = np.append(0, bit)
        errors = np.unique((one[:, None, None] | one[None, :, None] | one[None, None, :]).ravel())
        self.leader = np.zeros(2048, np.int64)
        self.leader[self.syndrome(errors)] = errors
        self.near = np.append(0, bit)

    def syndrome(self, word: np.ndarray) -> np.ndarray:
        return self.parity[word >> 11] ^ (word & 0x7FF)

    def decode(self, word: np.ndarray) -> np.ndarray:
        return (word ^ self.leader[self.syndrome(word)]) >> 11

    def indices(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``word``, codeword index): what the words at most one bit away
        decode to, each index once."""
        found = np.sort(self.decode(word[:, None] ^ self.near[None, :]), axis=1)
        new = np.ones(found.shape, bool)
        new[:, 1:] = found[:, 1:] != found[:, :-1]
        at = np.nonzero(new)
        return at[0], found[at]


_CODE = Golay()


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in ``fps``, key): two fingerprints at most two bits apart share a key."""
    part = [((fps >> U(low)) & U((1 << bits) - 1)).astype(np.int64) for low, bits in SEGMENTS]
    at, keys = [], []
    for i in range(3):
        row, index = _CODE.indices(part[(i + 1) % 3])
        at.append(row)
        keys.append(mix((part[i][row] | index << 23 | i << 35).astype(U)))  # one to one
    return np.concatenate(at), np.concatenate(keys)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of as few pairs that connect what the pairs (a, b) connect."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(names))
    while True:
        before = root.copy()
        np.minimum.at(root, root[x], root[y])
        np.minimum.at(root, root[y], root[x])
        root = root[root]
        if (root == before).all():
            break
    other = np.flatnonzero(root != np.arange(len(names)))
    return names[root[other]], names[other]


def bucket_links(keys: np.ndarray, fps: np.ndarray, bits: int = 2) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Verified links inside each run of equal ``keys``, as forests."""
    have, count = [], 0
    row = np.arange(len(keys))
    for apart in range(1, len(keys)):
        row = row[row < len(keys) - apart]
        row = row[keys[row] == keys[row + apart]]
        if not len(row):
            break
        near = row[np.bitwise_count(fps[row] ^ fps[row + apart]) <= bits]
        have.append((fps[near], fps[near + apart]))
        count += len(near)
        if count > LINKS:
            have = [forest(*map(np.concatenate, zip(*have)))]
            count = len(have[0][0])
    if count:
        yield forest(*map(np.concatenate, zip(*have)))


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b) of distinct fingerprints (column ``fp``), as spanning forests of the
    links within two bits."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy().view(U)
            for k in range(0, len(own), 1 << 14):
                at, keys = fuzzy_keys(own[k : k + (1 << 14)])
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(own[k + at].view(np.int64))], names=["key", "fp"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
            both = [pa.array(a.view(np.int64)), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b.view(np.int64))]
            return pa.RecordBatch.from_arrays(both, names=["a", "b"])

        keys, fps, hot = np.zeros(0, U), np.zeros(0, U), None  # hot: the large key whose rest may follow
        for batch in _with_end(batches):
            if batch is not None:
                keys = np.append(keys, batch.column(0).to_numpy().view(U))
                fps = np.append(fps, batch.column(1).to_numpy().view(U))
            if not len(keys):
                continue
            edges = runs(keys)
            size = np.diff(edges)
            large = (size > bucket) | (keys[edges[:-1]] == hot if hot is not None else False)
            done = np.ones(len(size), bool)
            if batch is not None:
                done[-1] = large[-1]  # the last key may go on in the next batch
            hot = keys[-1] if large[-1] else None
            out = np.repeat(large, size)
            if out.any():
                yield found(fps[out], None)
            small = np.repeat(done & ~large, size)
            for a, b in bucket_links(keys[small], fps[small]):
                yield found(a, b)
            keep = np.repeat(~done, size)
            keys, fps = keys[keep], fps[keep]

    met = cut(fps.mapInArrow(spread, "key long, fp long").repartition("key").sortWithinPartitions("key").mapInArrow(meet, "a long, b long"))
    edges = met.where("b is not null")
    crowded = met.where("b is null").select("a").distinct()
    if crowded.isEmpty():
        return edges
    # all fingerprints one bit from a word, and itself: 65 at most, and each two of them link
    word = F.expr("concat(array(a), transform(sequence(0, 63), i -> a ^ shiftleft(1L, i)))")
    around = crowded.select("a", F.explode(word).alias("word")).groupBy("word").agg(F.min("a").alias("least"), F.collect_list("a").alias("all"))
    return edges.unionByName(around.where(F.size("all") > 1).select(F.col("least").alias("a"), F.explode("all").alias("b")).where("a <> b"))


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def near_components(docs: DataFrame, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    rows = cut(fingerprinted(docs, width, seed))
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(nodes.select("fp")))
    classes = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("class"))
    smallest = classes.groupBy("class").agg(F.min("least").alias("component_id"))
    named = classes.join(smallest, "class").select(F.col("fp").alias("of"), "component_id")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(named, F.col("fp") == F.col("of")).select("doc_id", digits.alias("fingerprint"), "component_id")


def op11_simhash(spark, sf_dir: str) -> DataFrame:
    return near_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
