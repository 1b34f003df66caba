"""A corpus pipeline of training-data operators.

Five stages, each on all its predecessor kept: documents whose language cannot be
told go; of equal texts one stays; of each component of similar texts one stays;
sources are mixed to target weights, so rows repeat or go; what is left is packed
into token sequences. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from weft.llm import exactdedup, jaccardjoin, langid, mixing, packing
from weft.llm._spark import shared_dir


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs)


def drop_exact_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exactdedup.drop_repeats(docs)


def drop_near_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccardjoin.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_repeats),
    ("jaccard_join", drop_near_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The stages have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each one's rows are written as Parquet and read again."""
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
