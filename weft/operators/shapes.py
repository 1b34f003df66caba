"""Constraints over a graph: conformance as a boolean column, violations as rows.

A constraint is data. ``conforms`` gives (focus, ok) for every focus node, also for
those without values; boolean composition (not, or, xone, and, node) combines these
columns, all partitioned by focus. ``violations`` gives (focus, value, n) rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Catalog
from ..sources.graph import Graph
from .paths import dealt, pairs, pairs_from, parts_for, recursive


@dataclass(frozen=True)
class Constraint:
    kind: str
    path: object = None
    arg: object = None
    parts: tuple = ()
    severity: str = "Violation"
    message: str | None = None


def min_count(path, n, **more):
    return Constraint("minCount", path, n, **more)


def max_count(path, n, **more):
    return Constraint("maxCount", path, n, **more)


def forbidden(path, **more):
    """No value at all (a maximum of zero)."""
    return Constraint("forbidden", path, 0, **more)


def of_class(path, *types, **more):
    """Every value is an instance of one of the types."""
    return Constraint("class", path, types, **more)


def values_are(path, test: Callable[[Column], Column], **more):
    """Every value passes a test, such as a datatype or a range."""
    return Constraint("values", path, test, **more)


def datatype(path, name: str, declared: str | None = None, **more):
    """Every value's text reads as this Spark type; where a graph keeps the declared
    datatypes of its literals, they must be ``declared`` as well."""
    return Constraint("datatype", path, lambda v: v.cast("string").try_cast(name).isNotNull(), (declared,) if declared else (), **more)


def has_value(path, value, **more):
    return Constraint("hasValue", path, value, **more)


def is_in(path, *values, **more):
    return Constraint("in", path, values, **more)


def qualified_min(path, constraint, n, **more):
    return Constraint("qualifiedMinCount", path, n, (constraint,), **more)


def qualified_max(path, constraint, n, **more):
    return Constraint("qualifiedMaxCount", path, n, (constraint,), **more)


def node(path, constraint, **more):
    """Every value conforms itself."""
    return Constraint("node", path, None, (constraint,), **more)


def not_(constraint, **more):
    return Constraint("not", None, None, (constraint,), **more)


def and_(*parts, **more):
    return Constraint("and", None, None, parts, **more)


def or_(*parts, **more):
    return Constraint("or", None, None, parts, **more)


def xone(*parts, **more):
    return Constraint("xone", None, None, parts, **more)


@dataclass(frozen=True)
class Shape:
    """``target``: a class, or ("node", term), ("subjects", relation), ("objects", relation)."""

    name: str
    target: str | tuple[str, str]
    constraints: tuple = field(default_factory=tuple)


def focus_of(graph: Graph, target: str | tuple[str, str], catalog: Catalog | None = None) -> DataFrame:
    """(focus): instances of the target class and of its subclasses; or a node, or what
    stands at one end of a relation."""
    if isinstance(target, tuple):
        kind, term = target
        if kind == "node":
            return graph.spark.range(1).select(F.lit(term).alias("focus"))
        return graph.edges(term).select(F.col("s" if kind == "subjects" else "o").alias("focus")).distinct()
    types = [target] if catalog is None or target not in catalog.classes else list(dict.fromkeys(catalog.classes[c].type for c in catalog.subclasses(target)))
    known = [t for t in types if graph.triples is not None or t in graph.types]
    return graph.instances(*known).select(F.col("name").alias("focus")).distinct()


def _values(graph: Graph, focus: DataFrame, path) -> DataFrame:
    found = pairs_from(graph, path, focus.select(F.col("focus").alias("name"))) if recursive(path) else pairs(graph, path)
    edge = found.select(F.col("s").alias("focus"), F.col("o").alias("value"))
    return edge.join(focus.select("focus"), "focus", "left_semi")


def _bad_values(graph: Graph, focus: DataFrame, c: Constraint) -> DataFrame | None:
    """(focus, value) that break a constraint on values; None: no such constraint."""
    if c.kind not in ("forbidden", "class", "values", "datatype", "in", "node"):
        return None
    values = _values(graph, focus, c.path)
    if c.kind == "class":
        return values.join(graph.instances(*c.arg).select(F.col("name").alias("value")), "value", "left_anti").select("focus", "value")
    if c.kind == "datatype" and c.parts and isinstance(c.path, str) and graph.triples is not None and "o_dt" in graph.triples.columns:
        typed = graph.triples.where((F.col("p") == c.path) & (F.col("o_dt") == c.parts[0])).select(F.col("s").alias("focus"), F.col("o").alias("value"))
        wrong = values.join(typed, ["focus", "value"], "left_anti")
        return wrong.unionByName(values.where(~F.coalesce(c.arg(F.col("value")), F.lit(False)))).distinct()
    if c.kind in ("values", "datatype"):
        return values.where(~F.coalesce(c.arg(F.col("value")), F.lit(False)))
    if c.kind == "in":
        return values.where(~F.col("value").isin(*c.arg))
    if c.kind == "node":
        good = conforms(graph, values.select(F.col("value").alias("focus")).distinct(), c.parts[0]).where("ok").select(F.col("focus").alias("value"))
        return values.join(good, "value", "left_anti").select("focus", "value")
    return values


def _satisfied(graph: Graph, c: Constraint) -> DataFrame | None:
    """(focus) of all nodes that conform, for a constraint that asks for something to be
    there: a value, a type, all or one of such. None for others, to which a node without
    values may conform. Rows may repeat."""
    if c.kind == "hasValue" and not recursive(c.path):
        return pairs(graph, c.path, distinct=False).where(F.col("o") == F.lit(c.arg)).select(F.col("s").alias("focus"))
    if c.kind == "type":
        known = [t for t in c.arg if graph.triples is not None or t in graph.types]
        return graph.instances(*known).select(F.col("name").alias("focus")) if known else None
    if c.kind in ("and", "or") and c.parts:
        parts = [_satisfied(graph, p) for p in c.parts]
        if any(p is None for p in parts):
            return None
        return reduce(lambda a, b: a.join(b, "focus", "left_semi") if c.kind == "and" else a.unionByName(b), parts)
    return None


def _counted(graph: Graph, focus: DataFrame, c: Constraint, few: bool = False) -> DataFrame:
    """(focus, n): values of the path, of those that conform if qualified. ``few``: whether
    the focus nodes are known to be few, so values of others are dropped first."""
    least = c.kind in ("minCount", "qualifiedMinCount")
    if recursive(c.path):
        values, parts = _values(graph, focus, c.path), None
    else:
        values = pairs(graph, c.path, distinct=False).select(F.col("s").alias("focus"), F.col("o").alias("value"))
        parts = parts_for(values)
        if few or not least:  # else the join with the focus drops other subjects
            values = values.join(focus.select("focus"), "focus", "left_semi")
    if c.parts and (found := _satisfied(graph, c.parts[0])) is not None:
        values = values.join(found.select(F.col("focus").alias("value")), "value", "left_semi")
    elif c.parts:
        good = conforms(graph, values.select(F.col("value").alias("focus")).distinct(), c.parts[0]).where("ok").select(F.col("focus").alias("value"))
        values = values.join(good, "value", "left_semi")
    # dealt by subject: equal values meet there, and are counted there
    counts = (values if recursive(c.path) else dealt(values, parts, "focus").distinct()).groupBy("focus").agg(F.count("*").alias("n"))
    if c.kind in ("maxCount", "qualifiedMaxCount"):
        return counts  # a focus without values cannot have too many
    return focus.select("focus").join(counts, "focus", "left").select("focus", F.coalesce("n", F.lit(0)).alias("n"))


_COUNT_FAILS = {"minCount": lambda n, k: n < k, "qualifiedMinCount": lambda n, k: n < k, "maxCount": lambda n, k: n > k, "qualifiedMaxCount": lambda n, k: n > k}


def conforms(graph: Graph, focus: DataFrame, c: Constraint) -> DataFrame:
    """(focus, ok) of every focus node."""
    if c.kind == "type":
        known = [t for t in c.arg if graph.triples is not None or t in graph.types]
        typed = graph.instances(*known).select(F.col("name").alias("focus")).distinct().withColumn("typed", F.lit(True))
        return focus.select("focus").join(typed, "focus", "left").select("focus", F.coalesce("typed", F.lit(False)).alias("ok"))
    if c.kind in ("not", "and", "or", "xone"):
        if not c.parts:  # nothing is asked
            return focus.select("focus").distinct().withColumn("ok", F.lit(c.kind != "or"))
        oks = [conforms(graph, focus, p).withColumnRenamed("ok", f"ok{i}") for i, p in enumerate(c.parts)]
        both = reduce(lambda a, b: a.join(b, "focus"), oks)
        columns = [F.col(f"ok{i}") for i in range(len(oks))]
        total = reduce(lambda a, b: a + b, [x.cast("int") for x in columns])
        ok = {"not": ~columns[0], "and": total == len(columns), "or": total >= 1, "xone": total == 1}[c.kind]
        return both.select("focus", ok.alias("ok"))
    bad = violations(graph, focus, c).select("focus").distinct().withColumn("bad", F.lit(True))
    return focus.select("focus").distinct().join(bad, "focus", "left").select("focus", F.col("bad").isNull().alias("ok"))


def violations(graph: Graph, focus: DataFrame, c: Constraint, few: bool = False) -> DataFrame:
    """(focus, value, n); ``value`` for constraints on values, ``n`` for counts. ``few``:
    whether the focus nodes are known to be few."""
    none = lambda kind: F.lit(None).cast(kind)
    if c.kind in _COUNT_FAILS:
        return _counted(graph, focus, c, few).where(_COUNT_FAILS[c.kind](F.col("n"), c.arg)).select("focus", none("string").alias("value"), "n")
    if c.kind == "hasValue":
        has = _values(graph, focus, c.path).where(F.col("value") == F.lit(c.arg))
        return focus.select("focus").join(has, "focus", "left_anti").select("focus", none("string").alias("value"), none("long").alias("n"))
    bad = _bad_values(graph, focus, c)
    if bad is not None:
        return bad.select("focus", "value", none("long").alias("n"))
    return conforms(graph, focus, c).where(~F.col("ok")).select("focus", none("string").alias("value"), none("long").alias("n"))


def validate(graph: Graph, shapes: list[Shape], catalog: Catalog | None = None, only: DataFrame | None = None) -> DataFrame:
    """The report: shape, focus, constraint_id, value, n, severity, message. ``only``
    (focus): the nodes that are looked at, of those that the shapes are about."""
    parts = []
    for shape in shapes:
        focus = focus_of(graph, shape.target, catalog)
        focus = focus if only is None else focus.join(only, "focus", "left_semi")
        counts: dict[object, list[Constraint]] = {}
        for c in shape.constraints:
            if c.kind in ("minCount", "maxCount"):
                counts.setdefault(c.path, []).append(c)
        together = {path: same for path, same in counts.items() if len(same) > 1}
        parts += [_count_report(graph, shape.name, focus, same, only is not None) for same in together.values()]
        for c in shape.constraints:
            if c.kind in ("minCount", "maxCount") and c.path in together:
                continue
            v = violations(graph, focus, c, only is not None)
            parts.append(v.select(F.lit(shape.name).alias("shape"), F.col("focus").cast("string"), F.lit(c.kind).alias("constraint_id"), F.col("value").cast("string"), "n", F.lit(c.severity).alias("severity"), F.lit(c.message).cast("string").alias("message")))
    if not parts:  # no shape, or none that is active
        return graph.spark.createDataFrame([], "shape string, focus string, constraint_id string, value string, n long, severity string, message string")
    return reduce(lambda a, b: a.unionByName(b), parts)


def _count_report(graph: Graph, name: str, focus: DataFrame, same: list[Constraint], few: bool = False) -> DataFrame:
    """Report rows of several bounds on the values of one path: counted once."""
    text = lambda x: F.lit(x).cast("string")
    n = _counted(graph, focus, replace(same[0], kind="minCount"), few)
    broken = [F.when(_COUNT_FAILS[c.kind](F.col("n"), c.arg), F.struct(text(c.kind).alias("constraint_id"), text(c.severity).alias("severity"), text(c.message).alias("message"))) for c in same]
    rows = n.select(F.col("focus").cast("string"), "n", F.explode(F.array_compact(F.array(*broken))).alias("found"))
    return rows.select(text(name).alias("shape"), "focus", "found.constraint_id", text(None).alias("value"), "n", "found.severity", "found.message")


def conforms_to(graph: Graph, shapes: list[Shape], catalog: Catalog | None = None) -> DataFrame:
    """One row: whether no violation is in the report (warnings and notes do not count)."""
    return ask(validate(graph, shapes, catalog).where("severity = 'Violation'")).select((~F.col("answer")).alias("conforms"))


def ask(df: DataFrame) -> DataFrame:
    """One row: whether there is any row. Reads no further than the first."""
    return df.limit(1).agg((F.count("*") > 0).alias("answer"))


def shape_of(catalog: Catalog, name: str, strict: bool = False) -> Shape:
    """The shape that a class declaration stands for: a constraint per field, with
    its declared bounds, and per exact value. ``strict`` asks as many values of a path
    as it has fields, and one of each qualified field, whatever they declare."""
    out = []
    count: dict[str, int] = {}
    for f in catalog.fields(name):
        if (r := catalog.relation_of(name, f)) and f.exact is None and f.value is None:
            count[r] = count.get(r, 0) + 1
    for f in catalog.fields(name):
        relation = catalog.relation_of(name, f)
        if relation is None or f.skipped:
            continue
        if strict and f.exact is None and f.value is None:
            out += [min_count(relation, count[relation])] if min_count(relation, count[relation]) not in out else []
            f = replace(f, min=1 if f.qualified else count[relation])
        if f.exact is not None:
            out += [has_value(relation, v) for v in f.exact] or [forbidden(relation)]
            continue
        if f.value is not None:
            out.append(has_value(relation, f.value))
            continue
        typed = None if f.literal or f.target not in catalog.classes else of_type(*dict.fromkeys(catalog.classes[c].type for c in catalog.subclasses(f.target)))
        if typed and f.qualified:
            out.append(qualified_min(relation, typed, f.min))
            if f.max is not None:
                out.append(qualified_max(relation, typed, f.max))
            continue
        out.append(min_count(relation, f.min))
        if f.max is not None:
            out.append(max_count(relation, f.max))
        if f.literal and f.target:
            out.append(datatype(relation, f.target))
        elif typed:
            out.append(of_class(relation, *typed.arg))
    return Shape(name, catalog.classes[name].type, tuple(out))


def of_type(*types) -> Constraint:
    """The node itself is an instance of one of the types."""
    return Constraint("type", None, types)

