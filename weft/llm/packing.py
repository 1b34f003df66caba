"""Best-fit packing of tokenised documents into sequences.

A document is its token ids and one end id; only longer ones are cut, into pieces
of ``SEQUENCE`` tokens and a rest. Pieces are packed by best-fit decreasing. The
open bins are kept by remaining capacity; a segment tree over the capacities finds
the tightest bin that holds a piece in logarithmic time. Pieces are dealt by hash
into groups of about ``GROUP_PIECES``, packed apart; bins that a group leaves
underfull are opened again and packed with those of other groups, until one group
is left. Only whole bins' numbers and offsets are added to the narrow piece rows.

Token ids are those of the tokenizer on the whole text; see ``WordEncoder``.

A null text is empty: one piece, the end id alone. Rows that repeat an id, or have
none, are separate documents. An empty table gives an empty result; other columns than
doc_id and text are left out.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut, small_batches
from ._words import U, bounds, lower_ascii, slices, word_hashes

SEQUENCE = 2048
END_ID = 0
GROUP_PIECES = 16_384
UNDERFULL = 0.95
CACHE_WORDS = 1_500_000


class TightestBin:
    """Segment tree over remaining capacities 0..most; leaves hold bin stacks."""

    def __init__(self, most: int) -> None:
        self.leaves = 1 << most.bit_length()
        self.any = bytearray(2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, capacity: int, bin_: int) -> None:
        self.bins[capacity].append(bin_)
        at = capacity + self.leaves
        while at and not self.any[at]:
            self.any[at] = 1
            at >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """(remaining capacity, bin) of a tightest bin that holds ``size``."""
        tree, at = self.any, size + self.leaves
        if not tree[at]:
            while at > 1 and (at & 1 or not tree[at + 1]):  # climb to a right sibling that has bins
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if tree[2 * at] else 2 * at + 1
        capacity = at - self.leaves
        bin_ = self.bins[capacity].pop()
        if not self.bins[capacity]:
            tree[at] = 0
            at >>= 1
            while at and not (tree[2 * at] or tree[2 * at + 1]):
                tree[at] = 0
                at >>= 1
        return capacity, bin_


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, packed by best-fit decreasing."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, opened = TightestBin(capacity), 0
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        found = tree.take(size)
        if found is None:
            found = capacity, opened
            opened += 1
        bins[i], offsets[i] = found[1], capacity - found[0]
        if found[0] > size:
            tree.put(found[0] - size, found[1])
    return bins, offsets


_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?")] = True


class WordEncoder:
    """Token ids of whole texts; every distinct word is encoded once in a worker.

    The tokenizer lower-cases, and no token of it spans a blank or the place
    between a letter and a mark that ends a word. Texts are cut there (A-Z lowered),
    words are told apart by a 64-bit hash, and ids come from a sorted cache of at
    most ``CACHE_WORDS`` words.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._forget()

    def _forget(self) -> None:
        self.known, self.place = np.zeros(0, U), np.zeros(0, np.int64)
        self.first, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    @staticmethod
    def cuts(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of words and of marks that end them; per text the first."""
        start, end, first = bounds(data, at)
        if not len(start):
            return start, end, first
        before = data[np.maximum(end - 2, 0)]
        accented = (data[np.maximum(end - 3, 0)] == 0xC3) & (end - start > 2) & (before >= 0x80) & (before != 0x97) & (before != 0xB7)
        mark = _MARK[data[end - 1]] & (end - start > 1) & (_LETTER[before] | accented)
        total = np.concatenate([[0], np.cumsum(1 + mark)])
        starts, ends = np.empty(total[-1], np.int64), np.empty(total[-1], np.int64)
        starts[total[:-1]], ends[total[:-1]] = start, end - mark
        starts[total[1:][mark] - 1], ends[total[1:][mark] - 1] = end[mark] - 1, end[mark]
        return starts, ends, total[first]

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text in them)."""
        if b"<|" not in data.tobytes():  # else a word may be a special token, which case tells apart
            data = lower_ascii(data)
        start, end, first = self.cuts(data, at)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        word, example, inverse = np.unique(word_hashes(data, start, end), return_index=True, return_inverse=True)
        if len(self.known) > CACHE_WORDS:
            self._forget()
        spot = np.searchsorted(self.known, word)
        new = np.ones(len(word), bool)
        inside = spot < len(self.known)
        new[inside] = self.known[spot[inside]] != word[inside]
        if new.any():
            texts = [data[s:e].tobytes().decode() for s, e in zip(start[example[new]], end[example[new]])]
            coded = [c.ids for c in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            number = len(self.first) - 1 + np.arange(len(coded))
            sizes = np.fromiter(map(len, coded), np.int64, len(coded))
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(sizes)])
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(coded), np.uint32, int(sizes.sum()))])
            self.known, self.place = np.insert(self.known, spot[new], word[new]), np.insert(self.place, spot[new], number)
            spot = np.searchsorted(self.known, word)
        place = self.place[spot][inverse]
        low, size = self.first[place], self.first[place + 1] - self.first[place]
        upto = np.concatenate([[0], np.cumsum(size)])
        flat = self.ids[np.repeat(low - upto[:-1], size) + np.arange(upto[-1])]
        return flat, upto[first]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's pieces."""
    small_batches(docs.sparkSession)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path or tokenizer_path())
        for batch in batches:
            doc_ids = batch.column(0)
            rows, piece, start, length, crc = [], [], [], [], []
            for row, end, data, at in slices(batch.column(1)):
                ids, first = coder.encode(data, at)
                for k in range(end - row):
                    own = np.append(ids[first[k] : first[k + 1]], np.uint32(END_ID)).astype("<u4")
                    for low in range(0, len(own), sequence):
                        part = own[low : low + sequence]
                        rows.append(row + k)
                        piece.append(low // sequence)
                        start.append(low)
                        length.append(len(part))
                        crc.append(zlib.crc32(part))
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([doc_ids.take(pa.array(rows, pa.int32())), *map(pa.array, (piece, start, length, crc), kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cut_up, schema)


_PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, again boolean"
_STRIDE = 1 << 40  # sequence numbers of a round


def _packer(turn: int, last: bool, sequence: int):
    def pack_group(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        # Arrow longs: beside a null id no other one may turn into a float
        table = table.drop_columns("group").sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        length = table["length"].to_numpy()
        bins, offset = best_fit(length, sequence)
        fill = np.bincount(bins, length)
        again = (fill < UNDERFULL * sequence)[bins] & (not last)
        numbers = turn * _STRIDE + key[0].as_py() * (1 << 20) + bins
        return table.append_column("sequence_id", pa.array(numbers)).append_column("offset", pa.array(offset)).append_column("again", pa.array(again))

    return pack_group


def pack(pieced: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """``pieced`` with sequence_id and offset.

    A round's bins are numbered from the group's number on, in steps of the
    rounds' common stride, so that no two bins share a number.
    """
    full = pieced.where(F.col("length") == sequence)
    left = cut(pieced.where(F.col("length") < sequence))
    columns = pieced.columns
    full = full.withColumn("sequence_id", F.lit(_STRIDE * 2048) + F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    done, turn = [full], 0
    while True:
        groups = -(-left.count() // GROUP_PIECES) or 1
        # rows of a checkpoint keep their place, so repeated ids spread as well
        group = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(turn)), F.lit(groups))
        last = groups == 1
        packed = left.withColumn("group", group).groupBy("group").applyInArrow(_packer(turn, last, sequence), _PACKED)
        if last:
            done.append(packed.drop("again"))
            break
        packed = cut(packed)
        done.append(packed.where("not again").drop("again"))
        rest = packed.where("again").select(*columns)
        if rest.count() > 0.75 * left.count():  # hardly any bin is full: packing anew gains nothing
            done[-1] = packed.drop("again")
            break
        left, turn = cut(rest), turn + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def pack_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Pipeline form: a row for each piece, with its place in a sequence."""
    return pack(cut(pieces(docs, path)))


def op6_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
