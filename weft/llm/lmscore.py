"""Language-model scoring with an Elias-Fano bigram trie.

The model is learned from all rows outside the held-out fold, from every bigram that
occurs there. Counts are discounted by ``DISCOUNT``; the mass of discounts backs off to
the unigram distribution: p(b|a) = q(a, b) + backoff(a) * p(b), where p(b) is add-0.1
smoothed and q is the discounted share, rounded down to a grid of ``STEPS`` a decade and
held as a byte. backoff(a) is what the shares of a leave of 1, rounded down to a grid of
``BACKOFF_STEPS`` a decade and held as two bytes. So the model sums to one, less 0.04 %
of the backed-off mass at most, over known words and one unknown word.

The trie is split over shards by context. A group of documents asks a shard about
its distinct bigrams once; its training counts travel in the same rows. The shard
adds the counts of all groups, builds its trie, maps it into memory and answers
every group. Unigram counts are gathered first, with totals.

Tokens are words (A-Z lowered), then one end, which also stands before the first
word. Null texts are empty: an end alone. Words are told apart by 64-bit hashes. Rows
that repeat an id, or have none, are scored and counted each by itself.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._groups import grouped, runs, shard_edges
from ._spark import crc_fold, cut, small_batches
from ._words import U, bounds, lower_ascii, slices, word_hashes
from .eliasfano import SUCCESSOR_BITS, BigramTrie

FOLDS = 10
ADD = 0.1
DISCOUNT = 0.75
STEPS = 28  # of a decade; code 1 + STEPS * -log10(q), 255 at most
BACKOFF_STEPS = 6000  # likewise, 65535 at most
END = U(0x5851F42D4C957F2D)
FLUSH = 2_000_000


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts and the offsets of each text's tokens."""
    hashes, sizes = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    for _, _, data, at in slices(column):
        data = lower_ascii(data)
        start, end, first = bounds(data, at)
        hashes.append(np.insert(word_hashes(data, start, end), first[1:], END))
        sizes.append(np.diff(first) + 1)
    return np.concatenate(hashes), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def code_of(q: np.ndarray) -> np.ndarray:
    """Rounded down: a larger code is a smaller share."""
    return np.clip(1 + np.ceil(-np.log10(q) * STEPS - 1e-9), 1, 255).astype(np.uint8)


def share_of(code: np.ndarray) -> np.ndarray:
    return np.where(code > 0, 10.0 ** -((code.astype(float) - 1) / STEPS), 0.0)


def backoff_code(weight: np.ndarray) -> np.ndarray:
    return np.clip(1 + np.ceil(-np.log10(weight) * BACKOFF_STEPS - 1e-9), 1, 65535).astype("<u2")


def backoff_of(code: np.ndarray) -> np.ndarray:
    """An unknown context (code 0) backs off with weight 1."""
    return np.where(code > 0, 10.0 ** -((code.astype(float) - 1) / BACKOFF_STEPS), 1.0)


def _packed(rows: dict) -> pa.Table:
    kinds = {"asker": pa.int64(), "shard": pa.int64(), "kind": pa.int32(), "n": pa.int64(), "v": pa.int64()}
    return pa.table({k: pa.array(v, kinds.get(k, pa.binary())) for k, v in rows.items()})


def _concat(column, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(b.as_py(), kind) for b in column] or [np.zeros(0, kind)])


# --- unigrams ---


def unigram_counts(docs: DataFrame, shards: int) -> DataFrame:
    """(shard, hashes, counts, n, v): the training counts of all words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = [], []

        def flush() -> pa.RecordBatch:
            h, c = _add(np.concatenate(hashes), np.concatenate(counts))
            edges = shard_edges(h, shards)
            some = np.flatnonzero(np.diff(edges))
            hashes.clear(), counts.clear()
            return _packed({"shard": some, "hashes": [h[edges[k] : edges[k + 1]].tobytes() for k in some], "counts": [c[edges[k] : edges[k + 1]].tobytes() for k in some]}).combine_chunks().to_batches()[0]

        for batch in batches:
            h, c = np.unique(tokens(batch.column(0))[0], return_counts=True)
            hashes.append(h)
            counts.append(c.astype(np.int64))
            if sum(map(len, hashes)) > FLUSH:
                h, c = _add(np.concatenate(hashes), np.concatenate(counts))
                hashes[:], counts[:] = [h], [c]
                if len(h) > FLUSH // 2:
                    yield flush()
        if hashes and sum(map(len, hashes)):
            yield flush()

    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        h, c = _add(_concat(table["hashes"], U), _concat(table["counts"], np.int64))
        return _packed({"shard": [key[0].as_py()], "hashes": [h.tobytes()], "counts": [c.tobytes()], "n": [int(c.sum())], "v": [len(h)]})

    small_batches(docs.sparkSession)
    part = docs.where("not held_out").select("text").mapInArrow(count, "shard long, hashes binary, counts binary")
    return part.groupBy("shard").applyInArrow(add, "shard long, hashes binary, counts binary, n long, v long")


def _add(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(hashes)
    hashes, counts = hashes[order], counts[order]
    edges = runs(hashes)
    return (hashes[edges[:-1]], np.add.reduceat(counts, edges[:-1])) if len(hashes) else (hashes, counts)


# --- a group's tokens, numbered by its distinct words and bigrams ---


class _Numbered:
    def __init__(self, table: pa.Table) -> None:
        hashes, self.first = tokens(table["text"])
        self.words, self.word = np.unique(hashes, return_inverse=True)
        before = np.empty(len(hashes), np.int64)
        before[1:] = self.word[:-1]
        before[self.first[:-1]] = np.searchsorted(self.words, END)
        pairs, self.pair = np.unique(before * max(1, len(self.words)) + self.word, return_inverse=True)
        self.context, self.successor = pairs // max(1, len(self.words)), pairs % max(1, len(self.words))
        self.pairs = len(pairs)
        self.edges = runs(self.context)  # where each context's pairs begin
        self.contexts = self.context[self.edges[:-1]]


def _asks(shards: int):
    def ask(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """kind 1: words. kind 2: contexts, their number of bigrams, successors'
        leading 48 bits, training counts."""
        group, g = _Numbered(table), key[0].as_py()
        rows = {k: [] for k in ("asker", "shard", "kind", "a", "b", "c", "d")}

        def put(shard, kind, *arrays):
            for k, value in zip(rows, (g, shard, kind, *(x.tobytes() for x in arrays), b"", b"", b"")):
                rows[k].append(value)

        edges = shard_edges(group.words, shards)
        train = ~np.repeat(table["held_out"].to_numpy(), np.diff(group.first)).astype(bool)
        count = np.bincount(group.pair[train], minlength=group.pairs).astype("<i4")
        successor = group.words[group.successor] >> U(64 - SUCCESSOR_BITS)
        six = np.ascontiguousarray(successor.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
        per_context = np.diff(group.edges).astype("<i4")
        cuts = np.searchsorted(group.contexts, edges)
        for k in np.flatnonzero((np.diff(edges) > 0) | (np.diff(cuts) > 0)).tolist():
            if edges[k] < edges[k + 1]:
                put(k, 1, group.words[edges[k] : edges[k + 1]])
            lo, hi = cuts[k], cuts[k + 1]
            if lo < hi:
                a, b = group.edges[lo], group.edges[hi]
                put(k, 2, group.words[group.contexts[lo:hi]], per_context[lo:hi], six[a:b], count[a:b])
        return _packed(rows)

    return ask


def _count_answer(asked: pa.Table, table: pa.Table) -> pa.Table:
    rows = {k: [] for k in ("asker", "shard", "kind", "a", "b")}
    known, counts = _concat(table["hashes"], U), _concat(table["counts"], np.int64)
    for asker, shard, words in zip(asked["asker"], asked["shard"], asked["a"]):
        words = np.frombuffer(words.as_py(), U)
        out = np.zeros(len(words), np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, words), len(known) - 1)
            hit = known[at] == words
            out[hit] = counts[at[hit]]
        for k, value in zip(rows, (asker.as_py(), shard.as_py(), 1, out.tobytes(), b"")):
            rows[k].append(value)
    return _packed(rows)


def build_shard(contexts: np.ndarray, owner: np.ndarray, successors: np.ndarray, counts: np.ndarray) -> BigramTrie:
    """Trie of training counts; ``owner`` numbers each bigram's context. Bigrams
    may come in parts, from many groups."""
    names, rank = np.unique(contexts, return_inverse=True)
    context = rank[owner] if len(owner) else np.zeros(0, np.int64)
    order = np.lexsort((successors, context))
    context, successors, counts = context[order], successors[order], counts[order].astype(np.int64)
    new = np.ones(len(context), bool)
    new[1:] = (context[1:] != context[:-1]) | (successors[1:] != successors[:-1])
    edges = np.flatnonzero(new)
    total = np.add.reduceat(counts, edges) if len(edges) else counts
    context, successors = context[edges], successors[edges]
    seen = np.bincount(context, total, len(names)).astype(np.int64)
    keep = total > 0  # the others are only asked for
    context, successors, total = context[keep], successors[keep], total[keep]
    code = code_of((total - DISCOUNT) / seen[context]) if len(total) else np.zeros(0, np.uint8)
    backoff = 1 - np.bincount(context, share_of(code), len(names))
    # contexts that training never saw are none
    live = np.flatnonzero(seen > 0)
    number = np.full(len(names), -1)
    number[live] = np.arange(len(live))
    first = np.searchsorted(number[context], np.arange(len(live) + 1))
    return BigramTrie.build(names[live], first, successors, code, backoff_code(backoff[live]))


def _bigram_answer(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    contexts = _concat(table["a"], U)
    owner = np.repeat(np.arange(len(contexts)), _concat(table["b"], "<i4"))
    six = _concat(table["c"], np.uint8).reshape(-1, 6)
    successors = np.zeros((len(six), 8), np.uint8)
    successors[:, :6] = six
    successors = successors.view("<u8").ravel()
    with tempfile.NamedTemporaryFile() as file:
        build_shard(contexts, owner, successors, _concat(table["d"], "<i4")).tofile(file)
        trie = BigramTrie.open(file.name)
        code, backoff = trie.look_up(contexts, owner, successors)
        del trie
    rows = {k: [] for k in ("asker", "shard", "kind", "a", "b")}
    at = pair = 0
    for asker, a, c in zip(table["asker"], table["a"], table["c"]):
        n, m = len(a.as_py()) // 8, len(c.as_py()) // 6
        for k, value in zip(rows, (asker.as_py(), key[0].as_py(), 2, code[pair : pair + m].tobytes(), backoff[at : at + n].tobytes())):
            rows[k].append(value)
        at, pair = at + n, pair + m
    return _packed(rows)


def _scorer(total: int, kinds: int):
    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        group = _Numbered(left)
        right = right.sort_by("shard")
        kind = right["kind"].to_numpy()
        one, two = right.filter(pa.array(kind == 1)), right.filter(pa.array(kind == 2))
        count, code, backoff = _concat(one["a"], np.int64), _concat(two["a"], np.uint8), backoff_of(_concat(two["b"], "<u2"))
        p = (count + ADD) / (total + ADD * (kinds + 1))
        per_context = np.repeat(backoff, np.diff(group.edges))
        log_pair = np.log10(share_of(code) + per_context * p[group.successor])
        add = lambda x: np.add.reduceat(x, group.first[:-1]) if len(left) else np.zeros(0)
        return pa.table({
            "doc_id": left["doc_id"],
            "held_out": left["held_out"],
            "n_tokens": pa.array(np.diff(group.first), pa.int64()),
            "n_known": pa.array(add((count > 0)[group.word].astype(np.int64)), pa.int64()),
            "train_tokens": pa.array(np.full(len(left), total), pa.int64()),
            "base_score": pa.array(add(np.log10(p)[group.word]), pa.float64()),
            "score": pa.array(add(log_pair[group.pair]), pa.float64()),
        })

    return score


def score_documents(docs: DataFrame) -> DataFrame:
    """``docs`` is (doc_id, text, held_out boolean); see ``op10_lm_scoring``."""
    dealt, shards = grouped(docs, "held_out")
    unigrams = cut(unigram_counts(docs, shards))
    total = unigrams.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    asked = dealt.groupBy("g").applyInArrow(_asks(shards), "asker long, shard long, kind int, a binary, b binary, c binary, d binary")
    answer = "asker long, shard long, kind int, a binary, b binary"
    counts = asked.where("kind = 1").select("asker", "shard", "a").groupBy("shard").cogroup(unigrams.groupBy("shard")).applyInArrow(lambda a, b: _count_answer(a, b), answer)
    bigrams = asked.where("kind = 2").groupBy("shard").applyInArrow(_bigram_answer, answer)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("g").cogroup(counts.unionByName(bigrams).groupBy("asker")).applyInArrow(_scorer(int(total[0]), int(total[1])), schema)


def op10_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_documents(docs.select("doc_id", "text", (crc_fold("doc_id", FOLDS) == 0).alias("held_out")))


ORACLE = {}
