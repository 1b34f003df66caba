"""Validation after changes: only what the changed triples can reach is checked again.

From the changed triples the paths of the constraints are walked backwards, through what
constraints on values ask of those in turn. The focus nodes found there, and those whose
types changed, are validated anew; of all others the earlier report's rows stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Catalog
from ..sources.graph import TYPE, Graph
from . import paths
from .paths import Path, dealt, pairs_from, parts_for, settle
from .shapes import Constraint, Shape, validate


def _union(parts: list[DataFrame]) -> DataFrame | None:
    return reduce(lambda a, b: a.unionByName(b), parts) if parts else None


def _before(graph: Graph, path, nodes: DataFrame | None) -> DataFrame | None:
    """(name) from which the path leads to one of the nodes."""
    return None if nodes is None else pairs_from(graph, path, nodes, back=True).select(F.col("s").alias("name"))


def _through(graph: Graph, path, changed: DataFrame, back: bool = False) -> DataFrame | None:
    """(name) whose values of the path a changed triple may be part of."""
    if isinstance(path, str):
        relation = TYPE if path == "a" else path
        return changed.where(F.col("p") == relation).select(F.col("o" if back else "s").alias("name"))
    if path.kind == "inverse":
        return _through(graph, path.parts[0], changed, not back)
    one_way = (lambda p: paths.inverse(p)) if back else (lambda p: p)
    if path.kind == "seq":
        steps = list(reversed(path.parts)) if back else list(path.parts)
        found = []
        for i, step in enumerate(steps):
            at = _through(graph, step, changed, back)
            found.append(at if not i else _before(graph, paths.seq(*map(one_way, steps[:i])), at))
        return _union(found)
    found = _union([_through(graph, p, changed, back) for p in path.parts])
    return _before(graph, Path("star", (one_way(path.parts[0]),)), found) if path.kind in ("plus", "star") else found


def touched(graph: Graph, c: Constraint, changed: DataFrame) -> DataFrame | None:
    """(name) of which a changed triple may decide whether they conform. ``graph`` holds the
    triples of before and after."""
    types = changed.where(F.col("p") == TYPE).select(F.col("s").alias("name"))
    if c.kind == "type":
        return types
    if c.path is None:
        return _union([t for p in c.parts if (t := touched(graph, p, changed)) is not None])
    parts = [_through(graph, c.path, changed)]
    if c.kind == "class":
        parts.append(_before(graph, c.path, types))
    elif c.kind != "datatype":
        parts += [_before(graph, c.path, touched(graph, p, changed)) for p in c.parts]
    return _union([p for p in parts if p is not None])


def _relations(path) -> set[str]:
    if isinstance(path, str):
        return {TYPE if path == "a" else path}
    return set() if path is None else set().union(*map(_relations, path.parts))


def asked(c: Constraint) -> set[str]:
    """The relations that a constraint looks at; types are always looked at."""
    return _relations(c.path).union({TYPE}, *[asked(p) for p in c.parts if isinstance(p, Constraint)])


def _changed(before: DataFrame, after: DataFrame, relations: set[str]) -> DataFrame:
    """(s, p, o) of the relations that only one of the two holds; rows of both may repeat. One
    aggregation for both."""
    key = ["s", "p", "o"]
    side = lambda df, there: df.where(F.col("p").isin(*sorted(relations))).select(*key, F.lit(there).alias("there"))
    both = dealt(side(before, False).unionByName(side(after, True)), parts_for(before, after), *key)
    return both.groupBy(*key).agg(F.min("there").alias("__least"), F.max("there").alias("__most")).where("__least = __most").select(*key)


def revalidate(before: DataFrame, after: DataFrame, shapes: list[Shape], report: DataFrame, catalog: Catalog | None = None) -> DataFrame:
    """The report of triples ``after``, from the ``report`` of triples ``before``: the rows
    that ``validate`` gives of them. Shapes and catalogue are the same for both."""
    relations = {TYPE}.union(*[asked(c) for shape in shapes for c in shape.constraints], [s.target[1] for s in shapes if not isinstance(s.target, str)])
    changed = settle(_changed(before, after, relations))
    both, graph, parts = Graph(before.select("s", "p", "o").unionByName(after.select("s", "p", "o"))), Graph(after), []
    for shape in shapes:
        found = [t for c in shape.constraints if (t := touched(both, c, changed)) is not None]
        if isinstance(shape.target, str):
            found.append(changed.where(F.col("p") == TYPE).select(F.col("s").alias("name")))
        elif shape.target[0] != "node":
            found.append(changed.where(F.col("p") == shape.target[1]).select(F.col("s" if shape.target[0] == "subjects" else "o").alias("name")))
        again = settle(_union(found).select(F.col("name").alias("focus")).distinct()) if found else None
        kept = report.where(F.col("shape") == shape.name)
        if again is None:
            parts.append(kept)
            continue
        parts.append(kept.join(again, "focus", "left_anti").select(*report.columns))
        parts.append(validate(graph, [shape], catalog, only=again).select(*report.columns))
    return _union(parts) if parts else report
