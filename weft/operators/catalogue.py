"""Operators on catalogue tables: relation inference, cardinalities, differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def infer_relations(tables: dict[str, DataFrame], wanted: DataFrame) -> DataFrame:
    """(class, target, relation): for each (class, target) the valid relation that is
    nearest by the class's ancestors, then the target's, then its declaration; null if
    none leads there. Joins over class_mro and valid_relations."""
    above = tables["class_mro"].select("class", F.col("ancestor").alias("source"), F.col("depth").alias("near"))
    ends = tables["class_mro"].select(F.col("class").alias("target"), F.col("ancestor").alias("end"), F.col("depth").alias("far"))
    valid = tables["valid_relations"].select(F.col("class").alias("source"), "relation", F.col("target").alias("end"), "position")
    found = wanted.join(above, "class").join(valid, "source").join(ends, ["target", "end"])
    best = found.groupBy("class", "target").agg(F.min_by("relation", F.struct("near", "far", "position")).alias("relation"))
    return wanted.distinct().join(best, ["class", "target"], "left")


def path_cardinalities(tables: dict[str, DataFrame]) -> DataFrame:
    """(class, relation, min_count, max_count): how many fields a class has on a path,
    and the first bound that one of them sets."""
    first = F.min_by("max", F.when(F.col("max").isNotNull(), F.col("position")))
    return tables["fields"].where("relation is not null").groupBy("class", "relation").agg(F.count("*").alias("min_count"), first.alias("max_count"))


def own_fields(tables: dict[str, DataFrame]) -> DataFrame:
    """(class, field): fields that no ancestor of the class has."""
    above = tables["class_mro"].where("depth > 0").select("class", "ancestor")
    inherited = above.join(tables["fields"].select(F.col("class").alias("ancestor"), "field"), "ancestor").select("class", "field")
    return tables["fields"].select("class", "field").join(inherited, ["class", "field"], "left_anti")
