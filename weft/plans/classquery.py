"""Class queries: a declaration becomes a join plan over a graph.

Fields that lie in the class's own table are projected; others are joined by
subject. Pinned fields are filters that reach the scan, object fields are checked
by a semi-join on their type, forbidden ones by an anti-join, always after the
joins. Over triples of which statistics are known, fields of few values are not joined
one by one: one aggregation by subject gathers them (a property table), and each is
spread out again where it has several. The result has one column for the subject, ``name``, and one for each field;
its rows are distinct.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Catalog, Field
from ..operators.paths import dealt, holding, parts_for
from ..sources.graph import TYPE, Graph

WIDE = 1000  # values of one subject that a property table holds in a row


def class_query(graph: Graph, catalog: Catalog, name: str, *, match: str = "any", subclasses: bool = False, check_types: bool = True, optional: bool = False, fields: list[str] | None = None, distinct: bool = True) -> DataFrame:
    """``match`` of fields with exact values: "any" gives a row for each value that
    is listed (column ``name_exact_values``), "exact" subjects that have precisely
    the listed ones. ``optional`` adds optional fields by left joins, or as they are
    where they lie in the class's own table. Pinned fields that are not for templates
    are left out. Without ``distinct`` rows may repeat."""
    spec = catalog.classes[name]
    wanted = [f for f in catalog.fields(name) if (fields is None or f.name in fields) and not f.skipped]
    types = dict.fromkeys([spec.type, *(catalog.classes[c].type for c in catalog.subclasses(name))]) if subclasses else {spec.type: None}
    own = graph.types.get(spec.type) if len(types) == 1 and graph.triples is None else None
    inside = {f.name: graph.in_table_of(spec.type, catalog.relation_of(name, f)) for f in wanted if own and f.exact is None and catalog.relation_of(name, f)}
    if own:
        columns = [F.col(own.subject).alias("name")]
        base = own.table
        for f in wanted:
            if column := inside.get(f.name):
                if f.value is not None:
                    base = base.where(F.col(column) == F.lit(f.value))
                elif not f.optional:
                    base = base.where(F.col(column).isNotNull())
                    columns.append(F.col(column).alias(f.name))
                elif optional:
                    columns.append(F.col(column).alias(f.name))
        out = base.select(*columns)
    else:
        out = None
    typed = lambda f: not f.literal and f.target in catalog.classes and check_types and not f.optional
    joined = [f for f in wanted if not inside.get(f.name) and f.value is None and f.exact is None and catalog.relation_of(name, f) and (optional or not f.optional)]
    gathered: dict[str, Field] = {}
    if out is None:
        some = [f for f in wanted if f in joined or (f.value is not None and f.exact is None and catalog.relation_of(name, f))]
        gathered = {f.name: f for f in some if graph.few_values(catalog.relation_of(name, f), WIDE)}
        if gathered and not any(t in graph.types for t in types) and graph.few_values(TYPE, WIDE):
            checks = {f.name: _of_type(graph, catalog, f).withColumnRenamed("name", f.name) for f in gathered.values() if f.value is None and typed(f)}
            out = _property_table(graph, list(types), {f.name: (catalog.relation_of(name, f), f) for f in gathered.values()}, checks)
        else:
            gathered, out = {}, graph.instances(*types)
    for f in wanted:
        relation = catalog.relation_of(name, f)
        if f.name in gathered:
            continue
        if inside.get(f.name):
            if f.value is None and typed(f):
                out = out.join(_of_type(graph, catalog, f).withColumnRenamed("name", f.name), f.name, "left_semi")
        elif f.value is not None and f.exact is None and relation:
            only = graph.edges(relation).where(F.col("o") == F.lit(f.value)).select(F.col("s").alias("name"))
            out = out.join(only, "name", "left_semi")
    steps = {}
    for f in joined:
        if f.name not in gathered:
            step = graph.edges(catalog.relation_of(name, f)).select(F.col("s").alias("name"), F.col("o").alias(f.name))
            # edges are narrow: their objects are checked before they are joined
            steps[f.name] = step.join(_of_type(graph, catalog, f).withColumnRenamed("name", f.name), f.name, "left_semi") if typed(f) else step
    # of distinct subjects and edges the joined rows are distinct: they are many more, and are not compared
    unique = bool(gathered or (distinct and steps))
    if distinct and steps:
        parts = parts_for(out, *steps.values())
        out = dealt(out, parts, "name").distinct()
        steps = {c: dealt(step, parts, "name").distinct() for c, step in steps.items()}
    for f in joined:
        if f.name in steps:
            step = steps[f.name] if distinct or len(joined) == 1 else steps[f.name].distinct()  # repeated edges would multiply
            out = out.join(step, "name", "left" if f.optional else "inner")
    for b in catalog.between(name):
        if b.relation in graph.paths and b.relation not in graph.relations and graph.triples is None:
            out, unique = holding(graph, out, b.source, graph.paths[b.relation], b.target), False
            continue
        edge = graph.edges(b.relation).select(F.col("s").alias(b.source), F.col("o").alias(b.target)).distinct()
        out = out.join(edge, [b.source, b.target])
    out = reduce(lambda df, f: _exact(graph, df, catalog.relation_of(name, f), f, match), [f for f in wanted if f.exact is not None], out)
    order = [c for c in ["name", *(f.name for f in wanted)] if c in out.columns]
    out = out.select(*order, *[c for c in out.columns if c not in order])
    unique = unique and not any(f.exact for f in wanted)
    return out.distinct() if distinct and not unique else out


def _property_table(graph: Graph, types: list[str], fields: dict[str, tuple[str, Field]], checks: dict[str, DataFrame]) -> DataFrame:
    """(name, field, ...) of the subjects of the types, distinct: one scan of all relations, one
    aggregation by subject. Pinned fields are conditions; others are spread out, after
    those without a value are gone. Fields with ``checks``, a table of their values, are spread
    and checked before others multiply their rows."""
    p, o = F.col("p"), F.col("o")
    is_type = F.bool_or((p == TYPE) & o.isin(*types)).alias("__type")
    parts = []
    for name, (relation, f) in fields.items():
        on = p == relation
        parts.append(F.bool_or(on & (o == F.lit(f.value))).alias(f"__{name}") if f.value is not None else F.collect_set(F.when(on, o)).alias(f"__{name}"))
    relations = [TYPE, *dict.fromkeys(r for r, _ in fields.values())]
    out = graph.triples.where(p.isin(*relations)).groupBy(F.col("s").alias("name")).agg(is_type, *parts).where("__type")
    for name, (_, f) in fields.items():
        if f.value is not None:
            out = out.where(F.col(f"__{name}"))
        elif not f.optional:
            out = out.where(F.size(f"__{name}") > 0)
    spread = [name for name, (_, f) in fields.items() if f.value is None]
    for name in sorted(spread, key=lambda n: n not in checks):
        optional = fields[name][1].optional
        out = out.withColumn(name, (F.explode_outer if optional else F.explode)(f"__{name}")).drop(f"__{name}")
        if name in checks:
            out = out.join(checks[name], name, "left_semi")
    return out.select("name", *spread)


def _of_type(graph: Graph, catalog: Catalog, f: Field) -> DataFrame:
    """(name) of the field's class, with what that class pins."""
    pinned = [x.name for x in catalog.fields(f.target) if x.value is not None]
    return class_query(graph, catalog, f.target, check_types=False, fields=pinned, distinct=False).select("name")


def _exact(graph: Graph, out: DataFrame, relation: str, f: Field, match: str) -> DataFrame:
    values = graph.edges(relation).select(F.col("s").alias("name"), F.col("o").alias("value"))
    if not f.exact:
        return out.join(values, "name", "left_anti")
    if match == "any":
        suffix = "name_exact_values" if "name_exact_values" not in out.columns else f"{f.name}_exact_values"
        return out.join(values.where(F.col("value").isin(*f.exact)).withColumnRenamed("value", suffix), "name")
    inside = F.col("value").isin(*f.exact)
    full = values.groupBy("name").agg(F.countDistinct("value").alias("n"), F.bool_and(inside).alias("only")).where(F.col("only") & (F.col("n") == len(set(f.exact))))
    return out.join(full.select("name"), "name", "left_semi")


def load_many(graph: Graph, catalog: Catalog, classes: dict[str, str], **options) -> DataFrame:
    """Several classes in one table: ``key`` names the class query of each row."""
    parts = [class_query(graph, catalog, name, **options).withColumn("key", F.lit(key)) for key, name in classes.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def objects(graph: Graph, catalog: Catalog, name: str, depth: int = 3, **options) -> DataFrame:
    """Instances with nested structs: an object field becomes (name, fields...) of
    its class, to ``depth`` levels; deeper ones stay keys, so cycles end. Shared
    objects are no cycles."""
    out = class_query(graph, catalog, name, **options)
    for f in catalog.fields(name):
        if f.literal or f.name not in out.columns or f.target not in catalog.classes or depth <= 0:
            continue
        inner = objects(graph, catalog, f.target, depth - 1)
        nested = inner.select(F.col("name").alias("__key"), F.struct(*inner.columns).alias("__object"))
        out = out.join(nested, F.col(f.name) == F.col("__key"), "left").drop("__key", f.name).withColumnRenamed("__object", f.name)
    return out
