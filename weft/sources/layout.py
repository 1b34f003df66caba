"""Stored graphs: triples by relation and subject, with statistics of each relation.

The table is partitioned by relation, so a pattern reads its relation's files only, and
bucketed by subject, so what meets by subject (the fields of a class, a star of patterns)
meets without an exchange. The statistics say how many subjects, objects and values of one
subject a relation has; class queries gather a subject's fields in one aggregation where
that is known to be few.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.paths import checkpoint_dir
from .graph import Graph

BUCKET_BYTES = 128 << 20
_STATISTICS = "p string, triples long, subjects long, objects long, most_values long"


@dataclass(frozen=True)
class RelationStatistics:
    triples: int
    subjects: int
    objects: int
    most_values: int  # of one subject


def statistics_of(triples: DataFrame, distinct: bool = False) -> DataFrame:
    """(p, triples, subjects, objects, most_values): a row for each relation; distinct
    objects are an estimate. Counting combines before it shuffles. ``distinct``: whether the
    triples are known to be."""
    per = triples.groupBy("p", "s").agg((F.count("*") if distinct else F.count_distinct("o")).alias("n"))
    subjects = per.groupBy("p").agg(F.sum("n").alias("triples"), F.count("*").alias("subjects"), F.max("n").alias("most_values"))
    objects = triples.groupBy("p").agg(F.approx_count_distinct("o").alias("objects"))
    return subjects.join(objects, "p").select("p", "triples", "subjects", "objects", "most_values")


def known_statistics(table: DataFrame) -> dict[str, RelationStatistics]:
    """As many rows as relations: a schema's size."""
    return {r.p: RelationStatistics(r.triples, r.subjects, r.objects, r.most_values) for r in table.collect()}


def measured(graph: Graph) -> Graph:
    """The graph with statistics of its triples' relations."""
    out = graph.with_statistics(known_statistics(statistics_of(graph.triples)))
    return out


def store(triples: DataFrame, name: str, buckets: int | None = None, path: str | None = None) -> Graph:
    """Write triples as table ``name`` and its statistics as ``name_statistics``; the graph
    that reads them. Repeated triples are stored once. ``path``: a shared folder; default
    one in the checkpoint folder."""
    spark = triples.sparkSession
    path = path or f"{checkpoint_dir(spark)}/{name}"
    kept = [c for c in triples.columns if c != "p"]
    if buckets is None:
        size = int(str(triples._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        buckets = int(min(4096, max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES))) if size < 1 << 52 else int(spark.conf.get("spark.sql.shuffle.partitions"))
    # dealt as the buckets are, so a task writes one file for each relation; equal triples meet there
    dealt = triples.where("s is not null and p is not null and o is not null").select(*kept, "p").repartition(buckets, "s").distinct()
    dealt.write.format("parquet").partitionBy("p").bucketBy(buckets, "s").sortBy("s").mode("overwrite").option("path", path).saveAsTable(name)
    statistics_of(spark.table(name), distinct=kept == ["s", "o"]).write.format("parquet").mode("overwrite").option("path", f"{path}-statistics").saveAsTable(f"{name}_statistics")
    return open_stored(spark, name)


def open_stored(spark: SparkSession, name: str) -> Graph:
    return Graph(spark.table(name)).with_statistics(known_statistics(spark.table(f"{name}_statistics").select(*[c.split()[0] for c in _STATISTICS.split(", ")])))
