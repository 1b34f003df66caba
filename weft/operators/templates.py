"""Templates: a class declaration expands rows of field values into triples."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Catalog
from ..sources.graph import TYPE


def template_triples(catalog: Catalog, name: str) -> list[dict]:
    """(subject param, relation, object param or constant) of a class. The type is
    the asserted one; optional and relation-less fields give none of their own."""
    spec = catalog.classes[name]
    out = [{"s": "name", "p": TYPE, "param": None, "const": spec.type}]
    for f in catalog.fields(name):
        relation = catalog.relation_of(name, f)
        if relation is None or f.skipped:
            continue
        values = f.exact if f.exact is not None else [f.value]
        for v in values:
            out.append({"s": "name", "p": relation, "param": f.name if v is None else None, "const": v})
    out += [{"s": b.source, "p": b.relation, "param": b.target, "const": None} for b in catalog.between(name)]
    return out


def relation_template(catalog: Catalog, name: str) -> dict:
    r = catalog.relations[name]
    return {"body": [{"s": "name", "p": name, "param": "target", "const": None}], "domain": r.domain, "range": r.range}


def dependencies(catalog: Catalog, name: str) -> list[dict]:
    """Templates of the classes that a class's free object fields refer to.
    Abstract classes have none and are skipped."""
    return [{"template": f.target, "args": {"name": f.name}} for f in catalog.fields(name) if not f.literal and f.value is None and f.exact is None and f.target in catalog.classes and not catalog.classes[f.target].abstract]


def template(catalog: Catalog, name: str) -> dict:
    """{body, dependencies, optional}: a string if one field is optional."""
    left = [f.name for f in catalog.fields(name) if f.optional]
    out = {"body": template_triples(catalog, name), "dependencies": dependencies(catalog, name)}
    return out | ({"optional": left[0] if len(left) == 1 else left} if left else {})


def load_templates(catalog: Catalog, *names: str) -> dict[str, dict]:
    """Templates of all related classes, each once."""
    return {c: template(catalog, c) for c in catalog.related(*names)[1]}


def as_json(catalog: Catalog, *names: str) -> str:
    return json.dumps(load_templates(catalog, *names), indent=1, default=str)


def as_yaml(catalog: Catalog, *names: str) -> str:
    import yaml

    return yaml.safe_dump(json.loads(as_json(catalog, *names)), sort_keys=False)


def expand(values: DataFrame, catalog: Catalog, name: str) -> DataFrame:
    """Distinct (s, p, o) of rows that have a column for ``name`` and each field.

    One explode of constant-size arrays: no shuffle but that of set semantics. A
    field that is null or has no column gives no triple."""

    def term(param: str) -> Column:
        return F.col(f"`{param}`").cast("string") if param in values.columns else F.lit(None).cast("string")

    rows = [F.struct(term(t["s"]).alias("s"), F.lit(t["p"]).alias("p"), (F.lit(str(t["const"])) if t["param"] is None else term(t["param"])).alias("o")) for t in template_triples(catalog, name)]
    return values.select(F.explode(F.array(*rows)).alias("t")).select("t.*").where("s is not null and o is not null").distinct()


def flatten(df: DataFrame, mark: str = "-") -> DataFrame:
    """Nested structs become columns with joined names."""
    out, again = [], False
    for f in df.schema.fields:
        if f.dataType.typeName() == "struct":
            again = True
            out += [F.col(f"`{f.name}`.`{x}`").alias(f"{f.name}{mark}{x}") for x in f.dataType.names]
        else:
            out.append(F.col(f"`{f.name}`"))
    return flatten(df.select(*out), mark) if again else df


def mint(df: DataFrame, class_name: str, *order: str) -> DataFrame:
    """A ``name`` for each row: the class and a number in the order of its key.
    Numbers go on from range to range, so no single task sorts all rows."""
    from .naming import number_rows

    return number_rows(df, *order).withColumn("name", F.concat(F.lit(f"{class_name}_"), F.col("row") + 1)).drop("row")


def build(values: DataFrame, catalog: Catalog, name: str) -> DataFrame:
    """Distinct (s, p, o) of objects with nested ones: a field may hold a struct with a
    ``name`` and fields of its own class, to any depth. The object's own triples refer to
    the nested one by its name; the nested one's triples are added."""
    flat, parts = values, []
    for f in catalog.fields(name):
        if f.name not in values.columns or values.schema[f.name].dataType.typeName() != "struct":
            continue
        if f.target in catalog.classes:
            parts.append(build(values.where(F.col(f"`{f.name}`").isNotNull()).select(f"`{f.name}`.*"), catalog, f.target))
        flat = flat.withColumn(f.name, F.col(f"`{f.name}`.name"))
    out = expand(flat, catalog, name)
    for p in parts:
        out = out.unionByName(p)
    return out.distinct() if parts else out


def template_set(catalog: Catalog, values: tuple[str, ...] = ()) -> dict[str, dict]:
    """Templates by kind: relations, entities, and the classes named as values."""
    bodies = {n: template(catalog, n) for n, c in catalog.classes.items() if not c.abstract}
    return {
        "relations": {r: relation_template(catalog, r) for r in catalog.relations},
        "entities": {n: t for n, t in bodies.items() if n not in values},
        "values": {n: t for n, t in bodies.items() if n in values},
    }


def write_template_set(catalog: Catalog, folder: str, values: tuple[str, ...] = (), overwrite: bool = True) -> None:
    """One YAML file a kind, in a folder of the driver; without ``overwrite`` templates
    are added to those there."""
    import os

    import yaml

    os.makedirs(folder, exist_ok=True)
    for kind, found in template_set(catalog, values).items():
        path = os.path.join(folder, f"{kind}.yml")
        if not overwrite and os.path.exists(path):
            with open(path) as file:
                found = (yaml.safe_load(file) or {}) | found
        with open(path, "w") as file:
            yaml.safe_dump(json.loads(json.dumps(found, default=str)), file, sort_keys=False)


def read_template_set(folder: str) -> dict[str, dict]:
    """The templates that ``write_template_set`` wrote, by kind; kinds without a file are
    empty. A name that two kinds have is refused: it would name two templates."""
    import os

    import yaml

    found, seen = {}, {}
    for kind in ("relations", "entities", "values"):
        path = os.path.join(folder, f"{kind}.yml")
        if os.path.exists(path):
            with open(path) as file:
                found[kind] = yaml.safe_load(file) or {}
        else:
            found[kind] = {}
        for name in found[kind]:
            if name in seen:
                raise ValueError(f"{name} is a template of {seen[name]} and of {kind}")
            seen[name] = kind
    return found
