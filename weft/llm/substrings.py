"""Substring deduplication by Rabin-Karp hashes of fixed-length word windows.

Every window of ``WINDOW`` words is hashed. A window is removed where its word
sequence also starts in a document with a smaller id; the removed windows of a
document merge into maximal intervals of words. Windows are judged on the input.

A group of documents keeps for each window hash the smallest id that holds it and
asks the hash's shard for the smallest id of all groups; only hashes whose smallest
holder is in another group are answered. Hashes have 64 bits; a window is
mistaken for another with a probability of (number of windows) / 2**64.

The counting is a minimum for each hash, combined in each group first and finished per
shard. It is done on arrays: as rows of their own, windows would shuffle more than four
times the input (see the README).

Texts without words keep nothing: the hash of an empty text. Null texts count as
such. Rows that repeat an id are one id, so they never remove each other's words.
Rows with a null id are never a smaller document; their windows yield to all ids.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._groups import from_planes, grouped, planes, runs, shard_edges
from ._words import U, bounds, slices, window_hashes, word_hashes

WINDOW = 13
_NO_ID = np.iinfo(np.int64).max


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(_NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def _windows(table: pa.Table, width: int):
    """Per slice of texts: rows, words and each window's hash and document."""
    for row, end, data, at in slices(table["text"]):
        start, stop, first = bounds(data, at)
        hashes = window_hashes(word_hashes(data, start, stop), width)
        document = np.searchsorted(first, np.arange(len(hashes)), side="right") - 1
        inside = np.arange(width, width + len(hashes)) <= first[document + 1]
        yield row, end, data, at, start, stop, first, hashes, document, inside


def _smallest(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The table's distinct window hashes, sorted, with the smallest id of each."""
    ids = _ids(table["doc_id"])
    hashes, owners = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    for row, _, _, _, _, _, _, h, document, inside in _windows(table, width):
        hashes.append(h[inside])
        owners.append(ids[row + document[inside]])
    return _least(np.concatenate(hashes), np.concatenate(owners))


def _least(hashes: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(hashes)
    hashes, owners = hashes[order], owners[order]
    edges = runs(hashes)
    if len(edges) == 1:
        return hashes, owners
    return hashes[edges[:-1]], np.minimum.reduceat(owners, edges[:-1])


def _request(width: int, shards: int):
    def request(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        hashes, least = _smallest(table, width)
        edges = shard_edges(hashes, shards)
        some = np.flatnonzero(np.diff(edges))
        part = lambda a: [planes(a[edges[k] : edges[k + 1]]) for k in some]
        return pa.table({"asker": pa.array([key[0].as_py()] * len(some), pa.int64()), "shard": pa.array(some, pa.int64()), "hashes": pa.array(part(hashes), pa.binary()), "least": pa.array(part(least), pa.binary())})

    return request


def _answer(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    asker = table["asker"].to_numpy()
    hashes = [from_planes(b.as_py()) for b in table["hashes"]]
    least = np.concatenate([from_planes(b.as_py()).astype(np.int64) for b in table["least"]])
    owner = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
    hashes = np.concatenate(hashes)
    order = np.argsort(hashes)
    edges = runs(hashes[order])
    lowest = np.empty(len(hashes), np.int64)
    lowest[order] = np.repeat(np.minimum.reduceat(least[order], edges[:-1]), np.diff(edges))
    elsewhere = np.flatnonzero(lowest < least)
    edges = np.searchsorted(owner[elsewhere], np.arange(len(asker) + 1))
    some = np.flatnonzero(np.diff(edges))
    part = lambda a: [planes(a[elsewhere[edges[k] : edges[k + 1]]]) for k in some]
    return pa.table({"asker": pa.array(asker[some], pa.int64()), "hashes": pa.array(part(hashes), pa.binary()), "least": pa.array(part(lowest), pa.binary())})


def intervals(removed: np.ndarray) -> np.ndarray:
    """(begin, end) of each maximal run of removed words."""
    padded = np.concatenate([[False], removed, [False]])
    return np.flatnonzero(padded[1:] != padded[:-1]).reshape(-1, 2)


def kept_text(data: np.ndarray, at: np.ndarray, start: np.ndarray, stop: np.ndarray, first: np.ndarray, removed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts' kept words, joined by single spaces, and each text's offset."""
    kept = np.flatnonzero(~removed)
    text = np.searchsorted(first, kept, side="right") - 1
    more = np.append(text[1:] == text[:-1], False)[: len(kept)]  # another kept word follows in the text
    stays, data = np.zeros(len(data) + 1, np.int8), data.copy()
    stays[start[kept]] += 1
    stays[stop[kept] + more] -= 1  # the byte after a word is a separator
    data[stop[kept][more]] = 0x20
    stays = np.cumsum(stays[:-1], dtype=np.int8) > 0
    return data[stays], np.concatenate([[0], np.cumsum(stays)])[at]


def _remove(width: int, texts: bool):
    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        hashes, least = _smallest(left, width)
        for h, low in zip(right["hashes"], right["least"]):
            spot = np.searchsorted(hashes, from_planes(h.as_py()))
            least[spot] = np.minimum(least[spot], from_planes(low.as_py()).astype(np.int64))
        ids = _ids(left["doc_id"])
        words, gone, digest, spans, kept = [], [], [], [], []
        for row, end, data, at, start, stop, first, h, document, inside in _windows(left, width):
            hit = np.zeros(len(h), bool)
            own = np.flatnonzero(inside)
            hit[own] = least[np.searchsorted(hashes, h[own])] < ids[row + document[own]]
            change = np.zeros(len(start) + 1, np.int64)
            begin = np.flatnonzero(hit)
            change[begin] += 1
            change[begin + width] -= 1
            removed = np.cumsum(change[:-1]) > 0
            text, upto = kept_text(data, at, start, stop, first, removed)
            lost = np.concatenate([[0], np.cumsum(removed)])
            words += np.diff(first).tolist()
            gone += np.diff(lost[first]).tolist()
            for k in range(end - row):
                own = text[upto[k] : upto[k + 1]]
                digest.append(hashlib.sha256(own).hexdigest())
                if texts:
                    spans.append(intervals(removed[first[k] : first[k + 1]]).tolist())
                    kept.append(own.tobytes().decode())
        out = {"doc_id": left["doc_id"], "n_words": pa.array(words, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
        if texts:
            out |= {"removed": pa.array(spans, pa.list_(pa.list_(pa.int64()))), "kept": pa.array(kept, pa.string())}
        return pa.table(out)

    return remove


def remove_repeats(docs: DataFrame, width: int = WINDOW, texts: bool = True) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 and, with ``texts``, the
    removed word intervals and the kept words joined by single spaces."""
    dealt, shards = grouped(docs)
    asked = dealt.groupBy("g").applyInArrow(_request(width, shards), "asker long, shard long, hashes binary, least binary")
    answers = asked.groupBy("shard").applyInArrow(_answer, "asker long, hashes binary, least binary")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", removed array<array<long>>, kept string" if texts else "")
    return dealt.groupBy("g").cogroup(answers.groupBy("asker")).applyInArrow(_remove(width, texts), schema)


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), texts=False)


ORACLE = {
    "op8_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
m AS (SELECT win, min(doc_id) AS least FROM g GROUP BY win),
gone AS (SELECT DISTINCT doc_id, i + k AS j FROM g JOIN m USING (win), range(13) AS t(k) WHERE least < g.doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS text FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
""",
}
