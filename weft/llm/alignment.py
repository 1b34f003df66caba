"""Alignment of two tokenizers' tokens by a dangling-suffix transducer.

Both tokenizers cut the same bytes. The transducer reads their tokens in turn and
remembers which side leads and its unmatched bytes, the dangling suffix of that side's
last token. The next token of the other side overlaps that last token, which is a link;
it shortens the suffix, ends it, or leaves a suffix of its own. Transitions are memoised
by side, suffix and next token. An empty suffix closes a group: both sides have a
boundary there.

Texts are read in units: a run of blanks and what follows up to the next blank that
stands after something visible. Neither tokenizer has a token across such a place (the
first splits there before it merges; no piece of the second has a blank after another
symbol, which is verified when it is loaded), so a unit's tokens are the same alone and in
its text, and each distinct unit is encoded and aligned once in a worker. Units are told
apart by 64-bit hashes.

How many documents hold a pair of ids linked is counted over all documents: rows come in
chunks of about ``CHUNK_BYTES`` of text, a chunk combines its documents' pairs, Spark sums
them by pair, and each chunk gets the sums of its own pairs back. A pair that every
document holds is one row of each chunk.

Null and empty texts, and texts whose joined tokens differ from the text with a blank
before it (U+2581 in it, for one), have no tokens: zeros and ''. Rows that repeat an id,
or have none, are documents of their own. An empty table gives an empty result. Columns
other than doc_id and text are not read, so none can clash.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._groups import runs
from ._spark import planned_bytes, small_batches
from ._words import U, slices, word_hashes

CHUNK_BYTES = 12 << 20
CACHE_UNITS = 400_000
MEMO = 400_000  # transitions
PART_BYTES = 48 << 20  # of compressed input for each partition of the exchanges
VOCABULARY = 1 << 16  # most ids of a tokenizer; bounds the table of the first one's ids


class Transducer:
    """Aligns two token sequences; ``a`` and ``b`` give the bytes of each id."""

    def __init__(self, a: list[bytes | None], b: list[bytes | None]) -> None:
        self.a, self.b = a, b
        self.memo: dict[tuple[int, bytes, int], tuple[int, bytes]] = {}

    def step(self, lead: int, rest: bytes, token: int) -> tuple[int, bytes] | None:
        """State after the other side's ``token``: who leads, by which bytes; none where
        the bytes differ. ``lead`` is 0 where the first side leads."""
        own = self.a[token] if lead else self.b[token]
        if not own:
            return None
        if rest.startswith(own):
            to = lead, rest[len(own) :]
        elif own.startswith(rest):
            to = 1 - lead, own[len(rest) :]
        else:
            return None
        if len(self.memo) >= MEMO:
            self.memo.clear()
        self.memo[lead, rest, token] = to
        return to

    def align(self, first: list[int], second: list[int]) -> tuple[list[tuple[int, int]], list[tuple[list[int], list[int]]]] | None:
        """(links, groups), or none where the joined bytes differ."""
        links, groups, i, j, known = [], [], 0, 0, self.memo.get
        while i < len(first):
            # a group begins: the first side leads by its next token
            left, right, dangling = [first[i]], [], first[i]
            lead, rest = 0, self.a[dangling] or b""
            i += 1
            while rest:
                if lead:
                    if i == len(first):
                        return None
                    token = first[i]
                    i += 1
                    left.append(token)
                    links.append((token, dangling))
                else:
                    if j == len(second):
                        return None
                    token = second[j]
                    j += 1
                    right.append(token)
                    links.append((dangling, token))
                to = known((lead, rest, token)) or self.step(lead, rest, token)
                if to is None:
                    return None
                if to[0] != lead:
                    dangling = token
                lead, rest = to
            if not right:
                return None
            groups.append((left, right))
        return (links, groups) if j == len(second) else None


def byte_level_bytes() -> dict[str, int]:
    """The byte that each symbol of a byte-level vocabulary stands for: visible Latin-1
    symbols for themselves, the others, in order, from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


# Last bytes of the multi-byte blanks of Unicode; after the lead byte 0xC3 none is one.
_BLANK_END = np.zeros(256, bool)
_BLANK_END[[0x85, 0xA0, *range(0x80, 0x8B), 0xA8, 0xA9, 0xAF, 0x9F]] = True


class Aligner:
    """Tokens, links and groups of whole texts, each distinct unit worked once."""

    def __init__(self, byte_path: str, piece_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        import sentencepiece
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_file(byte_path)
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        pieces = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        if max(self.first.get_vocab_size(), len(pieces)) > VOCABULARY:
            raise ValueError(f"a vocabulary has more than {VOCABULARY} ids")
        self.units_apart = not any("▁" in p.lstrip("▁") for p in pieces)
        self.blank = self.second.piece_to_id("▁")
        decoded = byte_level_bytes()
        first: list[bytes | None] = [None] * self.first.get_vocab_size()
        for token, i in self.first.get_vocab().items():
            first[i] = bytes(decoded[c] for c in token) if all(c in decoded for c in token) else None
        plain = lambda i: not (self.second.is_unknown(i) or self.second.is_control(i))
        second = [bytes([int(p[3:5], 16)]) if self.second.is_byte(i) else p.replace("▁", " ").encode() if plain(i) else None for i, p in enumerate(pieces)]
        self.transducer = Transducer(first, second)
        self._forget()

    def _forget(self) -> None:
        self.known, self.place = np.zeros(0, U), np.zeros(0, np.int64)
        self.numbers = np.zeros((0, 4), np.int64)  # tokens of either side, groups, links; -1 links: bytes differ
        self.at, self.pairs, self.text = np.zeros(1, np.int64), np.zeros(0, np.uint32), np.zeros(0, object)

    def _learn(self, units: list[str]) -> None:
        first = [c.ids for c in self.first.encode_batch_fast(units, add_special_tokens=False)]
        # the second tokenizer adds the blank that each unit begins with; an empty text would stay empty
        second = [ids if len(unit) > 1 else [self.blank] for unit, ids in zip(units, self.second.encode([u[1:] for u in units], num_threads=1))]
        numbers, pairs, text = np.zeros((len(units), 4), np.int64), [], []
        spelled = self.transducer.a
        for k, (unit, a, b) in enumerate(zip(units, first, second)):
            found = self.transducer.align(a, b)
            if found is None or b"".join([spelled[i] or b"" for i in a]) != unit.encode():
                numbers[k] = 0, 0, 0, -1
                text.append(b"")
                continue
            links, groups = found
            numbers[k] = len(a), len(b), len(groups), len(links)
            pairs += [x << 16 | y for x, y in links]
            text.append(";".join([f"{x[0] if len(x) == 1 else ','.join(map(str, x))}|{y[0] if len(y) == 1 else ','.join(map(str, y))}" for x, y in groups]).encode())
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(np.maximum(numbers[:, 3], 0))])
        self.pairs = np.concatenate([self.pairs, np.array(pairs, np.uint32)])
        self.numbers = np.concatenate([self.numbers, numbers])
        more = np.empty(len(text), object)
        more[:] = text
        self.text = np.concatenate([self.text, more])

    def units(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Texts with a blank before each, where units begin, and each text's first."""
        size = np.diff(at)
        stream = np.full(len(data) + len(size), 32, np.uint8)
        stream[np.arange(len(data)) + np.repeat(np.arange(1, len(size) + 1), size)] = data
        at = at + np.arange(len(at))
        begins = np.zeros(len(stream), bool)
        if self.units_apart and len(stream) > 2:
            before, two = stream[1:-1], stream[:-2]
            solid = (before > 32) & ~((before >= 0x80) & _BLANK_END[before] & (two != 0xC3))
            begins[2:] = (stream[2:] == 32) & solid
        begins[at[:-1]] = True
        start = np.flatnonzero(begins)
        return stream, start, np.searchsorted(start, at)

    def read(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: its numbers, its groups' digest, where its pairs begin; and of
        each of its distinct pairs, in order, the pair and how often it is linked."""
        texts = len(at) - 1
        stream, start, first = self.units(data, at)
        end = np.append(start[1:], len(stream))
        unit, example, inverse = np.unique(word_hashes(stream, start, end), return_index=True, return_inverse=True)
        if len(self.known) > CACHE_UNITS:
            self._forget()
        spot = np.searchsorted(self.known, unit)
        new = np.ones(len(unit), bool)
        inside = spot < len(self.known)
        new[inside] = self.known[spot[inside]] != unit[inside]
        if new.any():
            number = len(self.numbers) + np.arange(new.sum())
            self._learn([stream[s:e].tobytes().decode() for s, e in zip(start[example[new]], end[example[new]])])
            self.known, self.place = np.insert(self.known, spot[new], unit[new]), np.insert(self.place, spot[new], number)
            spot = np.searchsorted(self.known, unit)
        place = self.place[spot][inverse]
        sums = np.zeros((len(place) + 1, 4), np.int64)
        np.cumsum(self.numbers[place], axis=0, out=sums[1:])
        numbers = sums[first[1:]] - sums[first[:-1]]
        odd = np.concatenate([[0], np.cumsum(self.numbers[place, 3] < 0)])
        good = (odd[first[1:]] == odd[first[:-1]]) & (np.diff(at) > 0)
        numbers[~good] = 0
        digests = [hashlib.sha256(b";".join(self.text[place[first[k] : first[k + 1]]].tolist())).hexdigest() if good[k] else "" for k in range(texts)]
        owner = np.repeat(np.arange(texts), np.diff(first))
        place, owner = place[good[owner]], owner[good[owner]]
        low, size = self.at[place], np.diff(self.at)[place]
        upto = np.concatenate([[0], np.cumsum(size)])
        flat = self.pairs[np.repeat(low - upto[:-1], size) + np.arange(upto[-1])]
        held, times = np.unique(np.repeat(owner, size).astype(U) << U(32) | flat, return_counts=True)
        return numbers, digests, np.searchsorted(held >> U(32), np.arange(texts + 1).astype(U)), (held & U(0xFFFFFFFF)).astype(np.uint32), times


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(byte_path: str, piece_path: str) -> Aligner:
    key = byte_path, piece_path
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(*key)
    return _ALIGNERS[key]


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _planes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u4")).view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


_NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]


def linked(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """Each row's numbers and digest, its chunk, and its distinct pairs (packed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = aligner(*(paths or tokenizer_paths()))
        chunk, room = TaskContext.get().partitionId() << 32, CHUNK_BYTES
        for batch in batches:
            for row, end, data, at in slices(batch.column(1)):
                numbers, digests, first, pairs, times = reader.read(data, at)
                packed = [(_planes(np.diff(pairs[a:b], prepend=np.uint32(0))), _planes(times[a:b])) for a, b in zip(first[:-1], first[1:])]
                if room < len(data) and room < CHUNK_BYTES:
                    chunk, room = chunk + 1, CHUNK_BYTES
                room -= len(data)
                columns = [batch.column(0)[row:end], *map(pa.array, numbers.T.copy()), pa.array(digests, pa.string()), pa.array(np.full(end - row, chunk))]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x, pa.binary()) for x in zip(*packed))], names=["doc_id", *_NUMBERS, "groups_sha256", "chunk", "pairs", "times"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, {', '.join(f'{n} long' for n in _NUMBERS)}, groups_sha256 string, chunk long, pairs binary, times binary")


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, pair, times) of all rows' pairs."""
    pairs = [np.cumsum(_from_planes(p.as_py()), dtype=np.uint32) for p in table["pairs"]]
    times = [_from_planes(t.as_py()) for t in table["times"]]
    row = np.repeat(np.arange(len(pairs)), [len(p) for p in pairs])
    empty = [np.zeros(0, np.uint32)]
    return row, np.concatenate(pairs + empty).astype(np.int64), np.concatenate(times + empty).astype(np.int64)


def align(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """A row for each row of ``docs``; ``n_best`` counts the links whose pair's count is the
    highest of its first id, ``count_sum`` adds up all links' counts."""
    spark = docs.sparkSession
    parts = int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), planned_bytes(docs.select("doc_id", "text")) // PART_BYTES))
    rows = linked(docs, paths).repartition(parts, "chunk")

    def combine(table: pa.Table) -> pa.Table:
        """Documents of one chunk that hold each pair."""
        pairs = np.sort(_unpacked(table)[1])
        each = runs(pairs)
        return pa.table({"chunk": pa.array(np.full(len(each) - 1, table["chunk"][0].as_py())), "pair": pairs[each[:-1]], "n": np.diff(each)})

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right["pair"].to_numpy())
        pair, count, top = (right[c].to_numpy()[order] for c in ("pair", "count", "top"))
        row, own, times = _unpacked(left)
        spot = np.searchsorted(pair, own)
        best, total = np.zeros(left.num_rows, np.int64), np.zeros(left.num_rows, np.int64)
        np.add.at(best, row, times * (count[spot] == top[spot]))
        np.add.at(total, row, times * count[spot])
        return left.select(["doc_id", *_NUMBERS]).append_column("n_best", pa.array(best)).append_column("count_sum", pa.array(total)).append_column("groups_sha256", left["groups_sha256"])

    asked = rows.groupBy("chunk").applyInArrow(combine, "chunk long, pair long, n long").repartition(parts, "pair")
    counts = asked.groupBy("pair").agg(F.sum("n").alias("count"))
    # at most VOCABULARY rows: one for each id of the first tokenizer
    tops = F.broadcast(counts.groupBy(F.shiftright("pair", 16).alias("a")).agg(F.max("count").alias("top")))
    found = counts.join(tops, F.shiftright("pair", 16) == F.col("a")).select(F.col("pair").alias("of"), "count", "top")
    found = asked.join(found, F.col("pair") == F.col("of")).select("chunk", "pair", "count", "top")
    schema = f"doc_id long, {', '.join(f'{n} long' for n in [*_NUMBERS, 'n_best', 'count_sum'])}, groups_sha256 string"
    return rows.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(answer, schema)


def op12_token_alignment(spark, sf_dir: str) -> DataFrame:
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"))
