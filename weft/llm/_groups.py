"""Requests and answers between groups of documents and shards of a statistic.

Documents are dealt by a hash of their id and text into groups of bounded size. A group
combines what it asks about (window or word hashes), and deals it over shards by
the leading bits. A shard sees the requests of all groups on its part of the hash
range and answers each group. The groups' texts are read again from the same
exchange, which Spark reuses, to apply the answers. Nothing meets in one place: a
hash that a third of all documents hold is one request of each group.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import planned_bytes

GROUP_BYTES = 3 << 20  # of compressed input; some 5 MB of text
SHARD_BYTES = 2 << 20


def grouped(docs: DataFrame, *columns: str) -> tuple[DataFrame, int]:
    """``docs`` dealt into groups (column ``g``), and the number of shards."""
    size = planned_bytes(docs.select("doc_id", "text"))
    groups = max(64, size // GROUP_BYTES + 1)
    shards = 1 << max(6, int(size // SHARD_BYTES).bit_length())
    dealt = docs.select("doc_id", "text", *columns, F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).alias("g"))
    parts = max(int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(groups, size // (8 << 20)))
    return dealt.repartition(int(parts), "g"), shards


def shard_edges(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's part of the sorted ``hashes`` begins, and the end.
    ``shards`` is a power of two; a hash's leading bits name its shard."""
    width = np.uint64(64 - (shards - 1).bit_length())
    edges = np.arange(1, shards, dtype=np.uint64) << width
    return np.concatenate([[0], np.searchsorted(hashes, edges), [len(hashes)]])


def runs(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins, and the end."""
    if not len(values):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]])


def planes(values: np.ndarray) -> bytes:
    """64-bit ``values`` with all first bytes first, then all second bytes, and so
    on: bytes that repeat from value to value lie together, and shuffles compress them."""
    return np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel()
