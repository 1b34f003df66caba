"""Exact top-k search by inner product with no random access.

Vectors are packed into blocks. In a block every dimension has a list of the block's
vectors sorted by component, read from the top for a positive query weight and from
the bottom for a negative one. A round reads the next ``STEP`` part of every list, for
a batch of queries at once; only the cells it reads are touched. What was read gives
each vector a lower score bound (unread components lie at the list's far end) and an
upper one (they lie at the last value read). A vector whose upper bound is below the
k-th best lower bound is an outsider: its cells are skipped from then on. Reading goes
on until hardly any vector is in question or the lists end; the final scores of the
few are then resolved. The k-th best score carries over to a task's next blocks.

How early reading can stop depends on the vectors: of unit vectors in 64 dimensions
most cells must be read (see the README).

Components become floor(scale * x); one beyond the range of long counts as its end.
Scores are exact, and clamped to the range of long. Identical vectors of a block are
searched once and take their ids from a list; k + 1 of its smallest are enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import cut

K = 20
SCALE = 64
BLOCK_ROWS = 4096
QUERY_ROWS = 8192  # queries of a task
LANE_ROWS = 1 << 16  # vectors that a task reads, block by block
BATCH = 128  # queries that read in step
STEP = 0.125  # of a list, in one round
FEW = 4  # resolve when a query has at most FEW * k vectors in question, or half of what a round reads


def exact_dtype(a: np.ndarray, b: np.ndarray):
    """The smallest type in which all partial sums of a @ b.T are exact."""
    most = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * max(1, a.shape[1])
    return np.float32 if most < 2**23 else np.float64 if most < 2**52 else object


class SortedLists:
    """One block's lists, sorted by component, and what readers have cost so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int) -> None:
        vectors, inverse = np.unique(vectors, axis=0, return_inverse=True)
        order = np.lexsort((ids, inverse.ravel()))
        ids, owner = ids[order], inverse.ravel()[order]
        first = np.searchsorted(owner, np.arange(len(vectors) + 1))
        keep = np.arange(len(ids)) - first[owner] <= k
        self.ids, self.owner, self.vectors = ids[keep], owner[keep], vectors
        self.first = np.searchsorted(self.owner, np.arange(len(vectors) + 1))
        self.order = np.ascontiguousarray(np.argsort(vectors, axis=0, kind="stable").T)  # ascending, a row for each dimension
        self.sorted = np.take_along_axis(np.ascontiguousarray(vectors.T), self.order, 1)
        self.cells_read = self.cells = 0  # by single queries

    def _read(self, lower: np.ndarray, unread: np.ndarray, live: np.ndarray, weights: np.ndarray, span: slice, far: np.ndarray) -> None:
        """All dimensions' lists over ``span``, for queries with these one-sided weights."""
        for d in np.flatnonzero(weights.any(0)):
            at = self.order[d, span]
            mine = live[at]
            at = at[mine]
            lower[at] += (self.sorted[d, span][mine] - far[d]).astype(lower.dtype)[:, None] * weights[:, d][None, :]
            unread[at, d] = 0
            self.cells_read += len(at) * int(np.count_nonzero(weights[:, d]))

    def search(self, queries: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, vector row, score) of all that may be in a query's top k.

        ``floor`` holds each query's k-th best score so far and is raised.
        """
        kind, n = exact_dtype(queries, self.vectors), len(self.vectors)
        live = np.ones((n, len(queries)), bool)
        if kind is not object:
            self._outsiders(queries.astype(kind), k, floor, live)
        col, row = np.nonzero(live)
        if kind is object:
            least, most = np.iinfo(np.int64).min, np.iinfo(np.int64).max
            score = np.array([min(most, max(least, sum(int(x) * int(y) for x, y in zip(queries[r], self.vectors[c])))) for r, c in zip(row, col)], np.int64)
        else:
            score = np.empty(len(row), np.int64)
            for a in range(0, len(row), 1 << 16):
                part = slice(a, a + (1 << 16))
                score[part] = np.einsum("ij,ij->i", queries[row[part]].astype(kind), self.vectors[col[part]].astype(kind))
        return row, col, score

    def _outsiders(self, q: np.ndarray, k: int, floor: np.ndarray, live: np.ndarray) -> None:
        """Read in rounds and strike outsiders from ``live`` (vectors x queries)."""
        n, step = len(self.vectors), max(1, int(len(self.vectors) * STEP))
        self.cells += n * int(np.count_nonzero(q))
        if n <= k:
            return
        bottom, top = self.sorted[:, 0].astype(q.dtype), self.sorted[:, -1].astype(q.dtype)
        up, down, open_, bounded = np.maximum(q, 0), np.minimum(q, 0), np.arange(len(q)), np.zeros(len(q), bool)
        lower = np.repeat((up @ bottom + down @ top)[None, :], n, 0)
        unread_top = np.ones((n, q.shape[1]), q.dtype)
        unread_bottom = unread_top.copy()
        for read in range(step, n + step, step):
            some = live.any(1) if len(open_) == len(q) else live[:, open_].any(1)
            self._read(lower, unread_top, some, up, slice(max(0, n - read), n - read + step), bottom)
            self._read(lower, unread_bottom, some, down, slice(read - step, min(n, read)), top)
            if read >= n:
                break
            # k + 1 as the query's own row takes no part; an earlier block's k-th score is the better bound
            new = np.flatnonzero(np.isinf(floor[open_]) | bounded[open_])
            if len(new):
                bounded[open_[new]] = True
                floor[open_[new]] = np.maximum(floor[open_[new]], np.partition(lower[:, new], n - k - 1, axis=0)[n - k - 1].astype(float))
            front_top, front_bottom = self.sorted[:, n - read].astype(q.dtype), self.sorted[:, read - 1].astype(q.dtype)
            # what was read is no less than what is read last: none is out before these are
            if (up @ front_top + down @ front_bottom >= floor[open_]).all():
                continue
            rows = slice(None) if some.all() else np.flatnonzero(some)
            gap_top, gap_bottom = front_top - bottom, front_bottom - top
            upper = lower[rows] + unread_top[rows] @ (gap_top[:, None] * up.T) + unread_bottom[rows] @ (gap_bottom[:, None] * down.T)
            mine = live[:, open_] if len(open_) < len(q) else live
            mine[rows] &= upper >= floor[open_].astype(q.dtype)[None, :]
            live[:, open_] = mine
            left = mine.sum(0) > max(FEW * k, step // 2)
            if not left.any():
                break
            if not left.all():
                open_, up, down, lower = open_[left], up[left], down[left], np.ascontiguousarray(lower[:, left])


def _merge(found: list[np.ndarray], k: int) -> np.ndarray:
    """The k first rows of each query by falling score, then id, of (query, id, score)."""
    rows = np.concatenate(found, axis=1)
    order = np.lexsort((rows[1], np.invert(rows[2]), rows[0]))  # ~x falls as x rises, without overflow
    rows = rows[:, order]
    first = np.searchsorted(rows[0], rows[0], side="left")
    return rows[:, np.arange(rows.shape[1]) - first < k]


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x), of valid vectors only.

    Null vectors, and vectors with a null or non-finite component or no component,
    take no part; neither do null ids.
    """
    x = F.transform("embedding", lambda c: c.cast("double"))
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    v = F.transform(x, lambda c: F.floor(c * scale))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(F.coalesce(fine, F.lit(False))).select("vec_id", v.alias("v"))


def packed(vectors: DataFrame, block_rows: int) -> DataFrame:
    """Blocks of rows of one length: (dims, n, ids, cells), packed where the rows lie,
    with cells as narrow as the block's components allow."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, v = batch.column(0).to_numpy(), batch.column(1)
            if not len(ids):
                continue
            dims, flat, start = np.diff(v.offsets.to_numpy()), v.values.to_numpy(), v.offsets.to_numpy()[:-1]
            rows: dict[str, list] = {"dims": [], "n": [], "ids": [], "cells": []}
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                for a in range(0, len(at), block_rows):
                    part = at[a : a + block_rows]
                    cells = flat[start[part][:, None] + np.arange(d)[None, :]]
                    kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= cells.min() and cells.max() <= np.iinfo(t).max)
                    for name, value in zip(rows, (int(d), len(part), ids[part].astype("<i8").tobytes(), cells.astype(kind).tobytes())):
                        rows[name].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows.values(), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=list(rows))

    return vectors.select("vec_id", "v").mapInArrow(pack, "dims int, n long, ids binary, cells binary")


def _unpacked(table: pa.Table, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) of a group's blocks."""
    ids, vectors = [], []
    for n, i, c in zip(table["n"].to_pylist(), table["ids"], table["cells"]):
        data = c.as_buffer()
        vectors.append(np.frombuffer(data, f"<i{data.size // (n * dims)}").reshape(n, dims))
        ids.append(np.frombuffer(i.as_buffer(), "<i8"))
    return np.concatenate(ids), np.concatenate(vectors).astype(np.int64)


def _searcher(k: int):
    def lane(key: tuple[pa.Scalar, ...], queries: pa.Table, vectors: pa.Table) -> pa.Table:
        """A block of queries reads a lane of vectors."""
        out = [np.zeros((3, 0), np.int64)]
        if queries.num_rows and vectors.num_rows:
            dims = key[2].as_py()
            q_ids, q = _unpacked(queries, dims)
            ids, v = _unpacked(vectors, dims)
            floor = np.full(len(q_ids), -np.inf)
            for a in range(0, len(ids), BLOCK_ROWS):
                lists = SortedLists(ids[a : a + BLOCK_ROWS], v[a : a + BLOCK_ROWS], k)
                found = [out[0]]
                for b in range(0, len(q_ids), BATCH):
                    row, col, score = lists.search(q[b : b + BATCH], k, floor[b : b + BATCH])
                    count = lists.first[col + 1] - lists.first[col]
                    at = np.repeat(lists.first[col] + count - np.cumsum(count), count) + np.arange(count.sum())
                    new = np.stack([np.repeat(b + row, count), lists.ids[at], np.repeat(score, count)])
                    found.append(new[:, q_ids[new[0]] != new[1]])
                out = [_merge(found, k)]
                # the k-th best so far is a bound for all blocks to come
                full = np.flatnonzero(np.bincount(out[0][0], minlength=len(q_ids)) == k)
                last = np.searchsorted(out[0][0], full, side="right") - 1
                floor[full] = np.maximum(floor[full], out[0][2][last].astype(float))
            out = [np.stack([q_ids[out[0][0]], out[0][1], out[0][2]])]
        return pa.table({"query_id": out[0][0], "vec_id": out[0][1], "score": out[0][2]})

    return lane


def search(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best, itself left out.

    Both inputs are (vec_id, v). A task holds a block of queries and reads a lane of
    vectors, block by block; every query block meets every lane, so the work is the
    product of both, in tasks of bounded size. Vectors only meet queries of their own
    length. Of rows that repeat a query's id the smallest vector asks.
    """
    v = cut(packed(vectors, BLOCK_ROWS))
    q = cut(packed(queries.groupBy("vec_id").agg(F.min("v").alias("v")), BATCH))
    n_vectors, n_queries = (df.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for df in (v, q))
    tasks = 2 * vectors.sparkSession.sparkContext.defaultParallelism
    lanes = -(-n_vectors // LANE_ROWS) or 1
    q_blocks = max(1, -(-n_queries // QUERY_ROWS), min(-(-n_queries // BATCH), -(-tasks // lanes)))
    q = q.withColumn("q_block", F.pmod(F.xxhash64("ids"), F.lit(q_blocks))).withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))))
    v = v.withColumn("lane", F.pmod(F.xxhash64("ids"), F.lit(lanes))).withColumn("q_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_blocks - 1).cast("long"))))
    keys = ("q_block", "lane", "dims")
    found = q.groupBy(*keys).cogroup(v.groupBy(*keys)).applyInArrow(_searcher(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk(spark, sf_dir: str) -> DataFrame:
    v = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return search(v, v.where("vec_id % 20 = 0"))


ORACLE = {
    "op1_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""",
}
