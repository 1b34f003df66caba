"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut

ROUNDS = 100
TASK_EDGES = 1 << 15


def _stars(edges: DataFrame, large: bool, tasks: int) -> DataFrame:
    """Every node links its neighbours (larger ones, or smaller ones and itself)
    to the smallest of them, in so many tasks at most."""
    both = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    joined = both.join(least, F.col("u") == F.col("w"))
    if large:
        out = joined.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        out = joined.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("w").alias("b")))
    return out.where("a <> b").coalesce(tasks).distinct().coalesce(tasks)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each linked node's component.

    ``edges`` is (a, b) of longs. Each round joins the edges with their nodes'
    smallest neighbours; hot nodes are left to skew-join splitting. Rounds are as
    the logarithm of the longest path. A round over few edges takes a task for each
    ``TASK_EDGES``, not one for each shuffle partition.
    """
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").bitwiseAND((1 << 40) - 1))).first())
    before = mark(edges)
    for _ in range(ROUNDS):
        tasks = before[0] // TASK_EDGES + 1
        edges = cut(_stars(_stars(edges.coalesce(tasks), True, tasks), False, tasks))
        now = mark(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no fixed point after {ROUNDS} rounds")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
