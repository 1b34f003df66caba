"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Only in a local session that names none (a test) a temporary folder is set; on a
    cluster no other folder would do.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="weft-checkpoint-"))
    return named or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably in the shared folder and cut its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


UNKNOWN_BYTES = 1 << 52  # estimates from here on stand for inputs without statistics


def planned_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate, which only sizes partitions. Where the input
    has no statistics, one pass adds up the columns' lengths."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    size = int(str(stats.sizeInBytes()))
    if size < UNKNOWN_BYTES:
        return size
    lengths = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)).cast("long") for c in df.columns]
    return df.agg(F.sum(sum(lengths[1:], lengths[0]))).first()[0] or 0


def blocks(df: DataFrame, block_bytes: int, least: int = 1, most: int = 65536) -> int:
    """Number of blocks of about ``block_bytes`` for the planned size of ``df``."""
    return max(least, min(most, planned_bytes(df) // block_bytes + 1))


BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_BYTES`` (or one row), so that long texts stay
    bounded. A smaller bound of the session stays as it is."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    have = int(spark.conf.get(name).removesuffix("b"))
    if have <= 0 or have > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def crc_fold(column: str, folds: int):
    """crc32 of the id as text, modulo ``folds``; a null id counts as ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds


def text_digest():
    """SHA-256 of the unchanged text in UTF-8, as 32 bytes; a null text counts as empty."""
    return F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))


def own_name(docs: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(docs: DataFrame, gone: DataFrame, twice: DataFrame) -> DataFrame:
    """``docs`` less the rows named by ``gone`` (doc_id, digest); of each of
    ``twice`` (alike) one row stays. An id, or none, may stand at several texts, so
    it names no row alone. Columns of any names pass through."""
    own, id_, at = (own_name(docs, n) for n in ("__digest", "__id", "__at"))
    names = lambda df: df.select(F.col("doc_id").alias(id_), F.col("digest").alias(at)).distinct()
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(at))
    plain = docs.withColumn(own, text_digest()).join(names(gone), same, "left_anti")
    twice = cut(names(twice))
    if twice.isEmpty():
        return plain.drop(own)
    once = plain.join(twice, same, "left_semi").dropDuplicates(["doc_id", own])
    return plain.join(twice, same, "left_anti").unionByName(once).drop(own)
