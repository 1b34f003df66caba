"""Rules: inferred types and entailed edges, run to a fixed point."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Catalog
from ..sources.graph import TYPE, Graph
from .paths import dealt, parts_for, settle
from .shapes import Constraint, and_, conforms, focus_of, shape_of


@dataclass(frozen=True)
class TypeRule:
    """What conforms among the instances of ``target`` is also a ``inferred``."""

    target: str
    inferred: str
    condition: Constraint


def rules_of(catalog: Catalog, *names: str) -> list[TypeRule]:
    """One rule for each concrete class: conforming instances carry its type."""
    if not names:
        raise ValueError("name the classes or give rules")
    return [TypeRule(catalog.classes[n].type, n, and_(*shape_of(catalog, n).constraints)) for n in names if not catalog.classes[n].abstract and shape_of(catalog, n).constraints]


def new_types(graph: Graph, rules: list[TypeRule]) -> DataFrame:
    """(name, inferred): one round of all rules, known types left out."""
    parts = []
    for r in rules:
        found = conforms(graph, focus_of(graph, r.target), r.condition).where("ok").select(F.col("focus").alias("name"))
        if graph.triples is not None or r.inferred in graph.types:
            found = found.join(graph.instances(r.inferred), "name", "left_anti")
        parts.append(found.withColumn("inferred", F.lit(r.inferred)))
    return reduce(lambda a, b: a.unionByName(b), parts).distinct()


def infer_types(graph: Graph, rules: list[TypeRule]) -> tuple[Graph, DataFrame]:
    """Run rules over triples until nothing is new: (graph with types, new rows)."""
    every = None
    while True:
        fresh = settle(new_types(graph, rules))
        if fresh.isEmpty():
            return graph, every if every is not None else fresh
        every = fresh if every is None else every.unionByName(fresh)
        graph = graph.with_triples(fresh.select(F.col("name").cast("string").alias("s"), F.lit(TYPE).alias("p"), F.col("inferred").alias("o")))


def inverse_edges(graph: Graph, relation: str) -> DataFrame:
    """(s, o) of the inverse relation."""
    return graph.edges(relation).select(F.col("o").alias("s"), F.col("s").alias("o")).distinct()


def symmetric_edges(edges: DataFrame) -> DataFrame:
    """Both directions of (s, o), each once."""
    return edges.select("s", "o").unionByName(edges.select(F.col("o").alias("s"), F.col("s").alias("o"))).distinct()


def sub_relation_edges(graph: Graph, catalog: Catalog, relation: str) -> DataFrame:
    """(s, o) of a relation and of all that are declared below it."""
    below, level = [relation], [relation]
    while level:
        level = [r.name for r in catalog.relations.values() if r.subproperty_of in level and r.name not in below]
        below += level
    known = [r for r in below if graph.triples is not None or r in graph.relations or r in graph.paths]
    return reduce(lambda a, b: a.unionByName(b), [graph.edges(r).select("s", "o") for r in known]).distinct()


_KEY = ["s", "p", "o"]
_FORM = "array<struct<s:string,own_s:boolean,p:string,o:string,own_o:boolean>>"


def _forms(catalog: Catalog) -> tuple[dict, dict, bool]:
    """What follows in any number of steps from a triple of each relation, and from a type
    triple of each class; a form is (end, relation, end), of which an end is ``True`` for the
    triple's subject, ``False`` for its object, or a class. Each consequence rests on one triple, so
    declarations alone are followed. Last: whether objects of the data may be classes in turn."""
    rules: dict[str, list] = {}
    add = lambda p, rule: rules.setdefault(p, []).append(rule)
    for r in catalog.relations.values():
        if r.subproperty_of:
            add(r.name, lambda a, b, q=r.subproperty_of: (a, q, b))
        if r.inverse_of:
            add(r.name, lambda a, b, q=r.inverse_of: (b, q, a))
            add(r.inverse_of, lambda a, b, q=r.name: (b, q, a))
        if r.symmetric:
            add(r.name, lambda a, b, q=r.name: (b, q, a))
        if r.domain:
            add(r.name, lambda a, b, c=r.domain: (a, TYPE, c))
        if r.range:
            add(r.name, lambda a, b, c=r.range: (b, TYPE, c))
    up = {c: [a for a, d in catalog.mro(c) if d] for c in catalog.classes}

    def follow(start: tuple) -> list[tuple]:
        found, todo = {start: None}, [start]
        while todo:
            a, p, b = todo.pop()
            new = [rule(a, b) for rule in rules.get(p, [])] + [(a, TYPE, c) for c in (up.get(b, []) if p == TYPE else [])]
            new = [f for f in new if f not in found]
            found |= dict.fromkeys(new)
            todo += new
        return [f for f in found if f != start]

    relations = {p: follow((True, p, False)) for p in rules}
    classes = {c: follow((True, TYPE, c)) for c in up}
    again = any(p == TYPE and isinstance(b, bool) for forms in (*relations.values(), *classes.values()) for _, p, b in forms)
    return relations, {c: forms for c, forms in classes.items() if forms}, again


def _follow(spark, catalog: Catalog):
    """(function, rows made of one at most, whether once is not enough): the function gives the
    triples of a table with all that follows from each, in one pass; other columns stay. Rows may
    repeat."""
    relations, classes, again = _forms(catalog)
    end = lambda e: (None, e) if isinstance(e, bool) else (e, None)
    table = lambda forms, key: F.broadcast(spark.createDataFrame([(k, [(*end(a), p, *end(b)) for a, p, b in fs]) for k, fs in forms.items()], f"__{key} string, __{key}_forms {_FORM}"))  # noqa: E731  as many rows as declarations

    def expand(df: DataFrame) -> DataFrame:
        more, every = [c for c in df.columns if c not in _KEY], [F.array().cast(_FORM)]
        out = df
        if relations:
            out = out.join(table(relations, "relation"), F.col("p") == F.col("__relation"), "left")
            every.append(F.col("__relation_forms"))
        if classes:
            out = out.join(table(classes, "class"), F.when(F.col("p") == TYPE, F.col("o")) == F.col("__class"), "left")
            every.append(F.col("__class_forms"))
        at = lambda f, side: F.when(f[f"own_{side}"].isNull(), f[side]).otherwise(F.when(f[f"own_{side}"], F.col("s")).otherwise(F.col("o")))
        made = F.transform(F.concat(*[F.coalesce(x, every[0]) for x in every]), lambda f: F.struct(at(f, "s").alias("s"), f["p"].alias("p"), at(f, "o").alias("o")))
        return out.select(F.explode(F.concat(F.array(F.struct(*_KEY)), made)).alias("__t"), *more).select("__t.*", *more)

    most = 1 + max((len(f) for f in relations.values()), default=0) + max((len(f) for f in classes.values()), default=0)
    return expand, most, again


def _followed(df: DataFrame, catalog: Catalog) -> tuple[DataFrame, int]:
    """(table, rows made of one at most): ``df`` (s, p, o, ...) with all that follows."""
    expand, most, again = _follow(df.sparkSession, catalog)
    out = expand(df)
    if again:  # a class that is another one's value: until no row is new
        every, n = settle(df.distinct()), -1
        while (now := every.count()) != n:
            every, n = settle(expand(every).distinct()), now
        out = every
    return out, most


def entail(graph: Graph, catalog: Catalog) -> DataFrame:
    """All triples that follow from subclasses, sub-relations, domains, ranges,
    inverses and symmetry; (s, p, o), set semantics, known ones included.

    Declarations are followed to their end first, so one pass over the triples is enough."""
    asserted = graph.triples.select(*_KEY)
    found, most = _followed(asserted, catalog)
    return dealt(found, parts_for(asserted, times=most), *_KEY).distinct()


def entail_changes(entailed: DataFrame, before: DataFrame, after: DataFrame, catalog: Catalog) -> DataFrame:
    """What ``entail`` gives of the triples ``after``, from what it gave of ``before``.

    Of each triple it is told whether it is gone; what follows from one that is there stays, or
    is new, what follows from those that are gone alone is taken away. All meet in one
    aggregation."""
    flags = lambda df, **values: df.select(*_KEY, *[F.lit(v).alias(c) for c, v in values.items()])
    some = lambda *names: [F.bool_or(c).alias(c) for c in names]
    parts = parts_for(before, after)
    both = flags(before, there=False).unionByName(flags(after, there=True))
    state = dealt(both, parts, *_KEY).groupBy(*_KEY).agg(*some("there"))
    found, most = _followed(state, catalog)
    every = found.withColumn("known", F.lit(False)).withColumn("lost", ~F.col("there")).unionByName(flags(entailed, there=False, known=True, lost=False))
    parts = parts_for(before, after, times=most)
    every = dealt(every, parts, *_KEY).groupBy(*_KEY).agg(*some("there", "known", "lost"))
    return every.where("there or (known and not lost)").select(*_KEY)
