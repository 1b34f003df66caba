"""Exact deduplication through a minimal perfect hash of repeated digests.

The history is the set of distinct digests that are known to repeat, each with
its winner (the largest id) and its count. It is split by digest into parts, and a
minimal perfect hash is built for each part: a key takes the slot of the first
level on which no other key of its part hashes to the same bit, numbered by rank.
A slot holds the full digest and the winner's locator. A lookup compares all 32
bytes; rows whose digest is in no slot form groups of their own.

Counting combines before the shuffle, so a text that a third of all rows hold is
one row of each task, and so are rows that repeat both id and text. In the lookup, a
part's rows are dealt over as many tasks as its count asks for. There are as many parts
as rows and history ask for.

Null texts count as empty. Of rows that repeat the winner's id and text, one stays.
A null id never wins against an id. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut, text_digest, without

PART_KEYS = 50_000
TASK_ROWS = 100_000
BROADCAST_PARTS = 1_000_000  # rows of (part, ways)
_LOAD = 1.5


def _seeded(lo: np.ndarray, hi: np.ndarray, level: int, size: int) -> np.ndarray:
    x = lo + hi * np.uint64(2 * level + 1) + np.uint64((level * 0x9E3779B97F4A7C15) & (2**64 - 1))
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return (x % np.uint64(size)).astype(np.int64)


def _halves(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers of each 32-byte digest (n x 32 bytes)."""
    lanes = np.ascontiguousarray(digests).view("<u8").reshape(-1, 4)
    return lanes[:, 0] ^ lanes[:, 2], lanes[:, 1] ^ lanes[:, 3]


class PerfectHash:
    """Minimal perfect hash of distinct 32-byte digests; all steps are vectors."""

    def __init__(self, digests: np.ndarray) -> None:
        lo, hi = _halves(digests)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        left, before = np.arange(len(digests)), 0
        while len(left):
            size = max(2, int(len(left) * _LOAD))
            at = _seeded(lo[left], hi[left], len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            if len(self.levels) > 200:  # distinct keys need some ten levels
                raise ValueError("a history names each digest once")
            self.levels.append((alone, np.cumsum(alone) - 1 + before))
            before += int(alone.sum())
            left = left[~alone[at]]
        self.slots = before

    def slot(self, digests: np.ndarray) -> np.ndarray:
        """A key's own slot; of other digests some slot or -1."""
        lo, hi = _halves(digests)
        out, left = np.full(len(digests), -1, np.int64), np.arange(len(digests))
        for level, (alone, rank) in enumerate(self.levels):
            if not len(left):
                break
            at = _seeded(lo[left], hi[left], level, len(alone))
            hit = alone[at]
            out[left[hit]] = rank[at[hit]]
            left = left[~hit]
        return out


def _matrix(digests: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(digests.to_pylist()), np.uint8).reshape(-1, 32)


def _look_up(rows: pa.Table, history: pa.Table) -> pa.Table:
    """One part: build its hash over the history, then check its distinct rows. Ids stay
    Arrow longs: a null among them must not turn the others into floats."""
    own = rows["doc_id"].combine_chunks()
    size, at_winner = rows["copies"].to_numpy().astype(np.int64), np.arange(len(own))
    if len(history) and len(rows):
        keys = _matrix(history["known"])
        perfect = PerfectHash(keys)
        slot_of = perfect.slot(keys)
        slots, locator = np.empty_like(keys), np.empty(len(keys), np.int64)
        slots[slot_of], locator[slot_of] = keys, np.arange(len(keys))
        asked = _matrix(rows["digest"])
        at = perfect.slot(asked)
        found = (at >= 0) & (slots[at] == asked).all(1)
        at_winner[found] = len(own) + locator[at[found]]
        size[found] = history["n"].to_numpy()[locator[at[found]]]
    keep = pa.concat_arrays([own, history["winner"].combine_chunks().cast(pa.int64())]).take(pa.array(at_winner))
    wins = pc.or_(pc.fill_null(pc.equal(own, keep), False), pc.and_(pc.is_null(own), pc.is_null(keep)))
    return pa.table({"doc_id": own, "keep_id": keep, "group_size": size, "wins": wins, "copies": rows["copies"], "digest": rows["digest"]})


def _distinct(digests: DataFrame) -> DataFrame:
    """(doc_id, digest, copies): rows that repeat both are one row."""
    copies = F.sum("copies") if "copies" in digests.columns else F.count("*")
    return digests.groupBy("doc_id", "digest").agg(copies.alias("copies"))


def history_of(digests: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """Distinct digests of more than one row, with winner and count."""
    rows = F.sum("copies") if "copies" in digests.columns else F.count("*")
    counts = digests.groupBy("digest").agg(F.max("doc_id").alias("winner"), rows.alias("n"))
    if earlier is not None:
        counts = counts.unionByName(earlier.select("digest", "winner", "n")).groupBy("digest").agg(F.max("winner").alias("winner"), F.sum("n").alias("n"))
    return counts.where("n > 1")


def group_digests(digests: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """``digests`` (doc_id long, digest 32 bytes) with keep_id, group_size, kept.

    ``history`` (digest, winner, n) may come from earlier runs, on other rows: members
    gain its count and the larger winner, nonmembers are grouped by themselves.
    """
    digests = cut(_distinct(digests))
    history = cut(history_of(digests, history).select(F.col("digest").alias("known"), "winner", "n"))
    parts = int(max(64, history.count() // PART_KEYS, digests.count() // TASK_ROWS))
    part = lambda digest: F.pmod(F.hash(digest), F.lit(parts))
    # parts in which repeated digests have many rows; there are at most rows / TASK_ROWS of them
    ways = cut(history.groupBy(part("known").alias("part")).agg((F.sum("n") / TASK_ROWS + 1).cast("int").alias("ways")).where("ways > 1"))
    if ways.count() <= BROADCAST_PARTS:
        ways = F.broadcast(ways)
    left = digests.withColumn("part", part("digest")).join(ways, "part", "left")
    left = left.withColumn("way", F.pmod(F.xxhash64("doc_id", "digest"), F.coalesce("ways", F.lit(1)))).drop("ways")
    right = history.withColumn("part", part("known")).join(ways, "part", "left")
    right = right.withColumn("way", F.explode(F.expr("sequence(0L, coalesce(ways, 1) - 1L)"))).drop("ways")
    found = left.groupBy("part", "way").cogroup(right.groupBy("part", "way")).applyInArrow(
        lambda a, b: _look_up(a, b), "doc_id long, keep_id long, group_size long, wins boolean, copies long, digest binary"
    )
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")
    return found.select("*", copy).select("doc_id", "keep_id", "group_size", (F.col("wins") & (F.col("copy") == 1)).alias("kept"), "digest")


def digests_of(docs: DataFrame) -> DataFrame:
    """SHA-256 of the unchanged text in UTF-8, as 32 bytes."""
    return docs.select("doc_id", text_digest().alias("digest"))


def drop_repeats(docs: DataFrame) -> DataFrame:
    """Pipeline form: the row that stays of each group, with its own columns."""
    # only rows of repeated texts are looked at again
    repeats = cut(group_digests(digests_of(docs)).where("not kept").select("doc_id", "keep_id", "digest"))
    return without(docs, repeats.where("not doc_id <=> keep_id"), repeats.where("doc_id <=> keep_id"))


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    digests = digests_of(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return group_digests(digests).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = {
    "op5_exact_dedup": """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, (doc_id = keep_id) AS kept, text_sha256 FROM d JOIN g USING (t)
""",
}
