"""Streams of triples: the same relation views and path steps on unbounded input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, folder: str, schema: str = "s string, p string, o string, ts timestamp") -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def relation_counts(triples: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Triples of each relation in event-time windows; late rows drop out."""
    return triples.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "p").agg(F.count("*").alias("n")).select("w.start", "p", "n")


def relate(triples: DataFrame, known: DataFrame, relation: str) -> DataFrame:
    """Stream-static join of new edges of a relation with known objects (name)."""
    return triples.where(F.col("p") == relation).join(known.select(F.col("name").alias("o")), "o")
