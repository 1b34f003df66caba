"""Property paths over a graph: sequence, inverse, alternative, ``+`` and ``*``."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.graph import Graph

LEVELS = 24  # edges that a walk follows one by one
PART_BYTES = 8 << 20  # of stored input that one task joins or makes distinct


@dataclass(frozen=True)
class Path:
    kind: str
    parts: tuple


def inverse(path) -> Path:
    return Path("inverse", (path,))


def seq(*parts) -> Path:
    return Path("seq", parts)


def alt(*parts) -> Path:
    return Path("alt", parts)


def plus(path) -> Path:
    return Path("plus", (path,))


def star(path) -> Path:
    return Path("star", (path,))


def maybe(path) -> Path:
    """One step or none."""
    return Path("maybe", (path,))


def pairs(graph: Graph, path, nodes: DataFrame | None = None, distinct: bool = True) -> DataFrame:
    """(s, o) that a path joins; ``a`` is the type relation. ``nodes`` (name) are the
    subjects and objects that ``star`` and ``maybe`` also pair with themselves; default: all
    on the path. Without ``distinct`` rows may repeat."""
    out = _pairs(graph, path, nodes)
    return out.distinct() if distinct else out


def _pairs(graph: Graph, path, nodes: DataFrame | None) -> DataFrame:
    if isinstance(path, str):
        return graph.edges(path)
    if path.kind == "inverse":
        return _pairs(graph, path.parts[0], nodes).select(F.col("o").alias("s"), F.col("s").alias("o"))
    if path.kind == "seq":
        out = _pairs(graph, path.parts[0], nodes)
        for p in path.parts[1:]:
            # ``*`` as a step pairs what it is reached from with itself, on or off its own path
            at = out.select(F.col("o").alias("name")) if isinstance(p, Path) and p.kind in ("star", "maybe") else nodes
            step = _pairs(graph, p, at).select(F.col("s").alias("via"), F.col("o").alias("end"))
            out = out.join(step, F.col("o") == F.col("via")).select("s", F.col("end").alias("o"))
        return out
    if path.kind == "alt":
        out = _pairs(graph, path.parts[0], nodes)
        for p in path.parts[1:]:
            out = out.unionByName(_pairs(graph, p, nodes))
        return out
    step = _pairs(graph, path.parts[0], nodes)
    closed = step.distinct() if path.kind == "maybe" else closure(step)
    if path.kind == "plus":
        return closed
    own = step.select(F.col("s").alias("name")).union(step.select("o"))
    if nodes is not None:
        own = own.unionByName(nodes.select("name"))
    return closed.unionByName(own.select(F.col("name").alias("s"), F.col("name").alias("o"))).distinct()


def holding(graph: Graph, df: DataFrame, source: str, path, target: str) -> DataFrame:
    """Rows whose ``source`` the path joins with their ``target``; they repeat where it does so
    in several ways. A sequence is walked from the rows, so pairs of other nodes are never made."""
    steps = path.parts if isinstance(path, Path) and path.kind == "seq" and not recursive(path) else (path,)
    out = df.withColumn("__at", F.col(source))
    for p in steps[:-1]:
        out = out.join(pairs(graph, p, distinct=False).select(F.col("s").alias("__at"), F.col("o").alias("__to")), "__at").drop("__at").withColumnRenamed("__to", "__at")
    last = pairs(graph, steps[-1], distinct=False).select(F.col("s").alias("__s"), F.col("o").alias("__o"))
    return out.join(last, (F.col("__at") == F.col("__s")) & (F.col(target) == F.col("__o")), "left_semi").drop("__at")


def recursive(path) -> bool:
    """Whether a path holds ``+`` or ``*``, or a step that may be left out."""
    return isinstance(path, Path) and (path.kind in ("plus", "star", "maybe") or any(recursive(p) for p in path.parts))


def pairs_from(graph: Graph, path, seeds: DataFrame, back: bool = False) -> DataFrame:
    """Distinct (s, o) of a path whose subjects are among (name), or with ``back`` whose
    objects are. The frontier is walked from the seeds, so pairs of other nodes are never
    made; what is deeper than ``LEVELS`` edges of a ``+`` or ``*`` is found by labels. ``*``
    pairs each seed with itself, on the path or not."""
    start = seeds.select(F.col("name").alias("origin"), F.col("name").alias("at")).distinct()
    s, o = ("at", "origin") if back else ("origin", "at")
    return _advance(graph, path, start, back).select(F.col(s).alias("s"), F.col(o).alias("o")).distinct()


def _advance(graph: Graph, path, frontier: DataFrame, back: bool) -> DataFrame:
    """(origin, at): where the path leads from each ``at``; backwards with ``back``."""
    if isinstance(path, str):
        near, far = ("o", "s") if back else ("s", "o")
        return frontier.join(graph.edges(path), F.col("at") == F.col(near)).select("origin", F.col(far).alias("at")).distinct()
    if path.kind == "inverse":
        return _advance(graph, path.parts[0], frontier, not back)
    if path.kind == "seq":
        for p in reversed(path.parts) if back else path.parts:
            frontier = _advance(graph, p, frontier, back)
        return frontier
    if path.kind == "alt":
        found = [_advance(graph, p, frontier, back) for p in path.parts]
        return reduce(lambda a, b: a.unionByName(b), found).distinct()
    if path.kind == "maybe":
        return _advance(graph, path.parts[0], frontier, back).unionByName(frontier).distinct()
    frontier = settle(frontier)
    walked = _walk(graph, path.parts[0], frontier, back)
    return walked if path.kind == "plus" else walked.unionByName(frontier).distinct()


def _walk(graph: Graph, path, frontier: DataFrame, back: bool) -> DataFrame:
    """What one step or more lead to, level by level; the rest of long ways by labels."""
    fresh = every = settle(_advance(graph, path, frontier, back))
    for _ in range(LEVELS):
        if fresh.isEmpty():
            return every
        fresh = settle(_advance(graph, path, fresh, back).join(every, ["origin", "at"], "left_anti"))
        every = settle(every.unionByName(fresh))
    from .reach import Reach

    labels = Reach.of(pairs(graph, path, distinct=False))
    seeds = frontier.select(F.col("at").alias("name"))
    found = labels.behind(seeds).select(F.col("o").alias("via"), F.col("s").alias("end")) if back else labels.ahead(seeds).select(F.col("s").alias("via"), F.col("o").alias("end"))
    return frontier.join(found, F.col("at") == F.col("via")).select("origin", F.col("end").alias("at")).distinct()


def parts_for(*tables: DataFrame, times: int = 1) -> int | None:
    """Into how many parts rows of the tables are dealt: by the bytes of what they read, so that
    what one task holds does not grow with the input. ``times``: rows that are made of one.
    None where the bytes are unknown."""
    size = 0
    for table in tables:
        leaves = table._jdf.queryExecution().optimizedPlan().collectLeaves()
        size += sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    if size >= 1 << 52 or not tables:
        return None
    return max(tables[0].sparkSession.sparkContext.defaultParallelism, -(-size * times // PART_BYTES))


def dealt(df: DataFrame, parts: int | None, *keys: str | Column) -> DataFrame:
    """Rows brought together by the keys, before they are joined or made distinct by them: both
    then need no exchange of their own, and no task combines what a large split holds."""
    return df.repartition(parts, *keys) if parts else df.repartition(*keys)


def checkpoint_dir(spark) -> str:
    """The shared folder of checkpoints. Only a local session that names none gets a
    temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="weft-checkpoint-"))
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Cut a loop's lineage reliably: a checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Cut a loop's lineage by a table in the checkpoint folder. Unlike a checkpoint the rows
    read back know nothing of how they were partitioned, which in a loop of self-joins
    doubles what the planner has to weigh each round."""
    folder = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def closure(edges: DataFrame, within: list[str] | None = None, levels: int | None = None) -> DataFrame:
    """Transitive closure of (s, o), semi-naive: only pairs found in the last round
    are extended. ``within`` names columns that both edges of a step share, which
    keeps independent graphs apart and their joins co-located. Cycles end. Paths double
    each round until nothing is new; with ``levels`` they grow by an edge, so many times."""
    keys = within or []
    edges = settle(edges.select(*keys, "s", "o").distinct())
    every = fresh = edges
    for _ in count() if levels is None else range(levels):
        step = (every if levels is None else edges).select(*keys, F.col("s").alias("via"), F.col("o").alias("end"))
        on = F.col("o") == F.col("via")
        if keys:
            grown = fresh.withColumnRenamed("o", "via").join(step, [*keys, "via"]).select(*keys, "s", F.col("end").alias("o"))
        else:
            grown = fresh.join(step, on).select("s", F.col("end").alias("o"))
        fresh = settle(grown.distinct().join(every, [*keys, "s", "o"], "left_anti"))
        if fresh.isEmpty():
            return every
        every = settle(every.unionByName(fresh))
    raise RecursionError(f"no closure within {levels} levels")


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(name, level): all nodes that the roots (name) reach, with the first level. Runs
    until no node is new, so cycles end and depth has no bound."""
    seen = level = settle(roots.select("name").distinct().withColumn("level", F.lit(0)))
    for at in count(1):
        nxt = level.join(edges, F.col("name") == F.col("s")).select(F.col("o").alias("name")).distinct()
        level = settle(nxt.join(seen, "name", "left_anti").withColumn("level", F.lit(at)))
        if level.isEmpty():
            return seen
        seen = settle(seen.unionByName(level))
