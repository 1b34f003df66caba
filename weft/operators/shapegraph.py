"""Shape graphs: class declarations to shape triples, and shape triples to constraints.

A shape graph is a schema: it has as many triples as its declarations ask for, so it is
read on the driver, up to ``MAX_TRIPLES``; data are checked by the constraints' plans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Catalog
from ..sources.graph import SCHEMA, TYPE
from . import paths, shapes
from .ingest import OWL, RDFS, SH
from .shapes import Constraint, Shape

MAX_TRIPLES = 1_000_000
XSD = "http://www.w3.org/2001/XMLSchema#"
_RDF = TYPE.removesuffix("type")

#: fixed values: literal types of declarations, and what a datatype reads as
_DATATYPES = {"string": "string", "long": "integer", "double": "decimal", "boolean": "boolean"}
_READS_AS = {"string": "string", "boolean": "boolean", "integer": "bigint", "int": "int", "decimal": "double", "double": "double", "float": "float", "date": "date", "dateTime": "timestamp"}


#: fixed values: parts of a shape that ``shapes_of`` turns into constraints
_CONSTRAINTS = {
    "property", "path", "class", "datatype", "hasValue", "value", "in", "minCount", "maxCount", "qualifiedValueShape", "qualifiedMinCount", "qualifiedMaxCount", "node", "not", "or", "xone", "and",
    "pattern", "flags", "minLength", "maxLength", "minInclusive", "maxInclusive", "minExclusive", "maxExclusive",
    "severity", "message", "deactivated", "targetClass", "targetNode", "targetSubjectsOf", "targetObjectsOf",
}
#: fixed values: parts that constrain nothing, and texts of a query language, which are left out
_ADVISORY = {"name", "description", "order", "group", "defaultValue", "sparql", "prefixes", "declare", "codeIdentifier"}
#: fixed values: parts that a node shape may have about its focus itself
_ON_FOCUS = _CONSTRAINTS - {"path", "datatype", "hasValue", "value", "in", "minCount", "maxCount", "qualifiedValueShape", "qualifiedMinCount", "qualifiedMaxCount", "pattern", "flags", "minLength", "maxLength", "minInclusive", "maxInclusive", "minExclusive", "maxExclusive"}
_TESTS = {
    "minLength": lambda v, n: F.length(v.cast("string")) >= int(n), "maxLength": lambda v, n: F.length(v.cast("string")) <= int(n),
    "minInclusive": lambda v, n: _number(v) >= float(n), "maxInclusive": lambda v, n: _number(v) <= float(n), "minExclusive": lambda v, n: _number(v) > float(n), "maxExclusive": lambda v, n: _number(v) < float(n),
}


def _number(value):
    return value.cast("string").try_cast("double")


def shape_rows(catalog: Catalog, *names: str, inherited: bool = True, strict: bool = False) -> list[tuple]:
    """Rows of SCHEMA: the node shape of each class, with label, comment, the nearest
    named ancestor, a property shape for each field (own ones only without
    ``inherited``) and each valid relation. ``strict`` counts fields on a path instead
    of declared bounds and asks one value of each qualified field."""
    rows: list[tuple] = []
    iri = lambda s, p, o: rows.append((s, p, o, "bnode" if o.startswith("_:") else "iri", None, None))
    text = lambda s, p, o, dt=XSD + "string": rows.append((s, p, str(o), "literal", dt, None))
    for name in names or tuple(catalog.classes):
        spec, n = catalog.classes[name], 0
        iri(name, TYPE, SH + "NodeShape")
        iri(name, TYPE, OWL + "Class")
        if spec.type != name:
            iri(name, SH + "targetClass", spec.type)
        for part, value in (("label", spec.label), ("comment", spec.comment)):
            if value:
                text(name, RDFS + part, value)
        if spec.parents:
            iri(name, RDFS + "subClassOf", spec.parents[0])
        above = set() if inherited else {f.name for p in spec.parents for f in catalog.fields(p)}
        fields = [f for f in catalog.fields(name) if f.name not in above and not f.skipped and catalog.relation_of(name, f)]
        for f in fields:
            relation, node, n = catalog.relation_of(name, f), f"_:{name}-{n}", n + 1
            on_path = [x for x in fields if catalog.relation_of(name, x) == relation]
            iri(name, SH + "property", node)
            iri(node, SH + "path", relation)
            if f.exact is not None or f.value is not None:
                for v in f.exact if f.exact is not None else [f.value]:
                    if v in catalog.classes:  # an individual of its own
                        iri(node, SH + "value", v)
                    else:
                        text(node, SH + "hasValue", v)
                if f.exact is not None and not f.exact:
                    text(node, SH + "maxCount", 0, XSD + "integer")
                continue
            least = len(on_path) if strict else f.min
            most = next((x.max for x in on_path if x.max is not None), None) if strict else f.max
            if f.target in catalog.classes and f.qualified:
                inner = node + "-value"
                iri(node, SH + "qualifiedValueShape", inner)
                iri(inner, SH + "class", f.target)
                text(node, SH + "qualifiedMinCount", 1 if strict else least, XSD + "integer")
                if strict:
                    text(node, SH + "minCount", least, XSD + "integer")
                if most is not None:
                    text(node, SH + ("maxCount" if strict else "qualifiedMaxCount"), most, XSD + "integer")
                continue
            text(node, SH + "minCount", least, XSD + "integer")
            if most is not None:
                text(node, SH + "maxCount", most, XSD + "integer")
            if f.target in catalog.classes:
                iri(node, SH + "class", f.target)
            elif f.target in _DATATYPES:
                iri(node, SH + "datatype", XSD + _DATATYPES[f.target])
        for relation, target in spec.valid:
            node, n = f"_:{name}-{n}", n + 1
            iri(name, SH + "property", node)
            iri(node, SH + "path", relation)
            iri(node, SH + "class", name if target == "Self" else target)
    return rows


def relation_rows(catalog: Catalog) -> list[tuple]:
    """Rows of SCHEMA: sub-relation, domain, range and inverse of each relation."""
    rows = []
    for r in catalog.relations.values():
        rows.append((r.name, TYPE, OWL + "ObjectProperty", "iri", None, None))
        for part, value in ((RDFS + "subPropertyOf", r.subproperty_of), (RDFS + "domain", r.domain), (RDFS + "range", r.range), (OWL + "inverseOf", r.inverse_of)):
            if value:
                rows.append((r.name, part, value, "iri", None, None))
    return rows


def shape_triples(spark, catalog: Catalog, *names: str, **options) -> DataFrame:
    return spark.createDataFrame(shape_rows(catalog, *names, **options) + relation_rows(catalog), SCHEMA)


def shapes_of(triples: DataFrame) -> list[Shape]:
    """The shapes of a graph as constraints that ``validate`` takes. A shape with a part
    that is not understood raises, so that no data pass for want of a check; parts that
    constrain nothing and texts of a query language (``sparql``) are left out by name.
    ``value`` pins an individual and asks for it as ``hasValue`` does. Deactivated shapes
    are left out. A shape without a target of its own is about its own instances."""
    about: dict[str, list[tuple]] = {}
    found = triples.select("s", "p", "o", *(["o_dt"] if "o_dt" in triples.columns else [F.lit(None).cast("string").alias("o_dt")])).limit(MAX_TRIPLES + 1).collect()
    if len(found) > MAX_TRIPLES:
        raise ValueError(f"a shape graph of more than {MAX_TRIPLES} triples is data")
    for s, p, o, dt in found:
        about.setdefault(s, []).append((p, o, dt))
    above = {s: [o for p, o, _ in ps if p == RDFS + "subClassOf"] for s, ps in about.items()}

    def below(name: str) -> list[str]:
        out, level = {name}, {name}
        while level:
            level = {s for s, ups in above.items() if level & set(ups)} - out
            out |= level
        return sorted(out)

    every = lambda node, part: sorted((o, dt) for p, o, dt in about.get(node, ()) if p == SH + part)
    one = lambda node, part: next((o for o, _ in every(node, part)), None)

    def items(node: str) -> list[tuple]:
        out = []
        while node and node != _RDF + "nil":
            out += [(o, dt) for p, o, dt in about[node] if p == _RDF + "first"]
            node = next(o for p, o, _ in about[node] if p == _RDF + "rest")
        return out

    def path_of(node: str):
        if (inner := one(node, "inversePath")) is not None:
            return paths.inverse(path_of(inner))
        if (inner := one(node, "alternativePath")) is not None:
            return paths.alt(*[path_of(o) for o, _ in items(inner)])
        for part, make in (("oneOrMorePath", paths.plus), ("zeroOrMorePath", paths.star), ("zeroOrOnePath", paths.maybe)):
            if (inner := one(node, part)) is not None:
                return make(path_of(inner))
        if any(p == _RDF + "first" for p, _, _ in about.get(node, ())):
            return paths.seq(*[path_of(o) for o, _ in items(node)])
        if node.startswith("_:") or any(p.startswith(SH) and p.endswith("Path") for p, _, _ in about.get(node, ())):
            raise ValueError(f"the path {node} has no form here")
        return node

    def understood(node: str, parts: set[str]) -> None:
        for p, o, _ in about.get(node, ()):
            part = p.removeprefix(SH)
            if p.startswith(SH) and part not in parts | _ADVISORY and (part, o) != ("closed", "false"):
                raise ValueError(f"{part} of the shape {node} has no form here")

    off = lambda node: one(node, "deactivated") == "true"

    def value(o: str, dt: str | None):
        kind = (dt or "").removeprefix(XSD)
        return int(o) if kind in ("integer", "int", "long") else float(o) if kind in ("decimal", "double", "float") else o == "true" if kind == "boolean" else o

    def parts_of(node: str, path) -> list[Constraint]:
        """Constraints of a node (``path`` None: on the focus itself)."""
        if off(node):
            return []
        understood(node, _ON_FOCUS if path is None else _CONSTRAINTS)
        level = (one(node, "severity") or SH + "Violation").removeprefix(SH)
        more = {"severity": level, "message": one(node, "message")}
        number = lambda part: None if one(node, part) is None else int(one(node, part))
        inner = [(shape, one(shape, "path")) for shape, _ in every(node, "property")]
        if missing := [shape for shape, at in inner if at is None]:
            raise ValueError(f"the property shape {missing[0]} has no path")
        out = [c for shape, at in inner for c in parts_of(shape, path_of(at))]
        if path is not None:  # what a property shape asks of its values' properties
            out = [shapes.node(path, c, **more) for c in out]
        if path is None:
            out += [shapes.of_type(*below(o)) for o, _ in every(node, "class")]
        else:
            out += [shapes.of_class(path, *below(o), **more) for o, _ in every(node, "class")]
            out += [shapes.datatype(path, _READS_AS.get(o.removeprefix(XSD), "string"), declared=o, **more) for o, _ in every(node, "datatype")]
            out += [shapes.has_value(path, value(o, dt), **more) for o, dt in [*every(node, "hasValue"), *every(node, "value")]]
            mark = "".join(f"(?{c})" for c in one(node, "flags") or "")
            out += [shapes.values_are(path, lambda v, text=mark + o: v.cast("string").rlike(text), **more) for o, _ in every(node, "pattern")]
            out += [shapes.values_are(path, lambda v, n=o, test=test: test(v, n), **more) for part, test in _TESTS.items() for o, _ in every(node, part)]
            out += [shapes.is_in(path, *[value(o, dt) for o, dt in items(head)], **more) for head, _ in every(node, "in")]
            if (n := number("minCount")):
                out.append(shapes.min_count(path, n, **more))
            if (n := number("maxCount")) is not None:
                out.append(shapes.max_count(path, n, **more) if n else shapes.forbidden(path, **more))
            for inner, _ in every(node, "qualifiedValueShape"):
                condition = shapes.and_(*parts_of(inner, None))
                if (n := number("qualifiedMinCount")):
                    out.append(shapes.qualified_min(path, condition, n, **more))
                if (n := number("qualifiedMaxCount")) is not None:
                    out.append(shapes.qualified_max(path, condition, n, **more))
        wrap = (lambda c: c) if path is None else (lambda c: shapes.node(path, c, **more))
        out += [wrap(shapes.and_(*parts_of(o, None))) for o, _ in every(node, "node")]
        out += [wrap(shapes.not_(shapes.and_(*parts_of(o, None)))) for o, _ in every(node, "not")]
        for part, make in (("or", shapes.or_), ("xone", shapes.xone), ("and", shapes.and_)):
            out += [wrap(make(*[shapes.and_(*parts_of(o, None)) for o, _ in items(head)])) for head, _ in every(node, part)]
        return out

    out = []
    for s in sorted(about):
        if (TYPE, SH + "NodeShape") not in {(p, o) for p, o, _ in about[s]} or "_:" in s:
            continue
        constraints = tuple(parts_of(s, None))
        ends = [(kind, o) for kind, part in (("node", "targetNode"), ("subjects", "targetSubjectsOf"), ("objects", "targetObjectsOf")) for o, _ in every(s, part)]
        classes = [o for o, _ in every(s, "targetClass")] or ([] if ends else [s])
        if constraints:
            out += [Shape(s, t, constraints) for target in classes for t in below(target)] + [Shape(s, end, constraints) for end in ends]
    return out
