"""Declarations: classes with typed fields, relations, and the catalogue of them.

A class is declared once. Its query, constraints, rule, template and table schema
are derived from the declaration elsewhere; nothing here touches data. The
catalogue is small and lives on the driver; ``tables`` gives it as DataFrames.
"""

from __future__ import annotations

import typing
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace
from typing import Any


@dataclass(frozen=True)
class Field:
    """One field. ``relation`` None: inferred from the catalogue if ``infer``, else
    the field has no triple of its own. ``value`` pins it; ``exact`` lists allowed
    values (an empty list forbids any)."""

    name: str = ""
    target: str | None = None  # a class name, or a literal type: string, long, double, boolean
    relation: str | None = None
    min: int = 1
    max: int | None = None
    qualified: bool = True
    optional: bool = False
    infer: bool = True
    value: Any = None
    exact: tuple | None = None
    templatize: bool = True
    label: str | None = None
    comment: str | None = None

    @property
    def literal(self) -> bool:
        return self.target in LITERALS or self.target is None

    @property
    def skipped(self) -> bool:
        """A pinned field that is not for templates: in no query and no template."""
        return self.value is not None and not self.templatize


LITERALS = {"string": str, "long": int, "double": float, "boolean": bool}


@dataclass(frozen=True)
class Between:
    """A relation between the values of two fields of one subject."""

    source: str
    relation: str
    target: str
    min: int = 1
    max: int | None = None


@dataclass(frozen=True)
class Relation:
    name: str
    subproperty_of: str | None = None
    domain: str | None = None
    range: str | None = None
    inverse_of: str | None = None
    symmetric: bool = False
    label: str | None = None


@dataclass(frozen=True)
class ClassSpec:
    name: str
    fields: tuple[Field, ...] = ()
    parents: tuple[str, ...] = ()
    asserted: str | None = None  # type that instances carry, if not the class itself
    valid: tuple[tuple[str, str], ...] = ()  # (relation, target class); "Self" allowed
    between: tuple[Between, ...] = ()
    abstract: bool = False
    label: str | None = None
    comment: str | None = None

    @property
    def type(self) -> str:
        return self.asserted or self.name


def required(relation: str | None = None, *, min: int = 1, max: int | None = None, qualified: bool = True, **more) -> Field:
    return Field(relation=relation, min=min, max=max, qualified=qualified, **more)


def exclusive(relation: str | None = None, **more) -> Field:
    return Field(relation=relation, min=1, max=1, **more)


def optional(relation: str | None = None, **more) -> Field:
    return Field(relation=relation, min=0, optional=True, **more)


def exact(relation: str, values: Iterable, **more) -> Field:
    return Field(relation=relation, exact=tuple(values), **more)


def pinned(relation: str | None, value, **more) -> Field:
    return Field(relation=relation, value=value, **more)


def _unwrap(hint) -> Any:
    """Optional[X], list[X] and X | None are declared as X."""
    args = [a for a in typing.get_args(hint) if a is not type(None)]
    return _unwrap(args[0]) if args else hint


class Catalog:
    """All declared classes and relations, with what follows from them."""

    def __init__(self) -> None:
        self.classes: dict[str, ClassSpec] = {}
        self.relations: dict[str, Relation] = {}

    def add(self, *specs: ClassSpec | Relation) -> Catalog:
        for spec in specs:
            (self.classes if isinstance(spec, ClassSpec) else self.relations)[spec.name] = spec
        return self

    def entity(self, *, parents: Sequence[str] = (), **more):
        """Class decorator: annotations and field helpers become a ClassSpec.

        A plain class attribute without an annotation pins the inherited field."""

        def declare(cls: type) -> type:
            own, hints = [], dict(getattr(cls, "__annotations__", {}))
            names = {v: k for k, v in LITERALS.items()}
            for name, hint in hints.items():
                hint = _unwrap(hint)
                target = names.get(hint) or (hint if isinstance(hint, str) else getattr(hint, "__name__", None))
                given = getattr(cls, name, None)
                given = given if isinstance(given, Field) else Field(value=given)
                own.append(replace(given, name=name, target=given.target or target))
            upper = tuple(parents) + tuple(b.__name__ for b in cls.__bases__ if b.__name__ in self.classes)
            inherited = {f.name: f for p in upper for f in self.fields(p)}
            for name, value in vars(cls).items():
                if name in inherited and name not in hints:
                    own.append(replace(inherited[name], value=value))
            self.add(ClassSpec(cls.__name__, tuple(own), upper, **more))
            return cls

        return declare

    def mro(self, name: str) -> list[tuple[str, int]]:
        """(ancestor, depth): the class itself first, then nearer ones; cycle-safe."""
        depth, level, at = {name: 0}, [name], 0
        while level:
            at += 1
            level = [p for c in level if c in self.classes for p in self.classes[c].parents if p not in depth and not depth.update({p: at})]
        return sorted(depth.items(), key=lambda x: x[1])

    def fields(self, name: str) -> list[Field]:
        """Own and inherited fields; the nearest declaration of a name wins, and a
        pinned value keeps what it does not set from the next declaration."""
        found: dict[str, Field] = {}
        for ancestor, _ in self.mro(name):
            for f in self.classes[ancestor].fields if ancestor in self.classes else ():
                if f.name not in found:
                    found[f.name] = f
                elif found[f.name].relation is None and found[f.name].infer:
                    found[f.name] = replace(found[f.name], relation=f.relation, infer=f.infer)
        return list(found.values())

    def between(self, name: str) -> list[Between]:
        return list(dict.fromkeys(b for a, _ in self.mro(name) if a in self.classes for b in self.classes[a].between))

    def infer_relation(self, source: str, target: str) -> str:
        """The valid relation that is nearest: by the source's ancestors, then the
        target's, then the order of declaration."""
        targets = dict(self.mro(target))
        best = min(
            (
                (depth, targets[end], place, relation)
                for ancestor, depth in self.mro(source)
                if ancestor in self.classes
                for place, (relation, end) in enumerate(self.classes[ancestor].valid)
                for end in [source if end == "Self" else end]
                if end in targets
            ),
            default=None,
        )
        if best is None:
            raise ValueError(f"no valid relation leads from {source} to {target}")
        return best[3]

    def relation_of(self, name: str, f: Field) -> str | None:
        if f.relation or not f.infer:
            return f.relation
        if f.target is None:
            raise ValueError(f"{name}.{f.name} has neither a relation nor a target")
        return self.infer_relation(name, f.target)

    def subclasses(self, name: str) -> list[str]:
        return [c for c in self.classes if any(a == name for a, _ in self.mro(c))]

    def edges(self) -> list[tuple[str, str]]:
        """(class, class it refers to) over fields and valid relations."""
        out = []
        for c in self.classes.values():
            ends = [f.target for f in self.fields(c.name) if not f.literal] + [c.name if t == "Self" else t for a, _ in self.mro(c.name) if a in self.classes for _, t in self.classes[a].valid]
            out += [(c.name, t) for t in ends if t in self.classes]
        return list(dict.fromkeys(out))

    def related(self, *names: str) -> tuple[list[str], list[str]]:
        """(relations, concrete classes) that can be reached from the classes."""
        edges, seen, level = self.edges(), dict.fromkeys(names), list(names)
        while level:
            level = list(dict.fromkeys(o for s, o in edges if s in level and o not in seen))
            seen |= dict.fromkeys(level)
        relations = [r for c in seen for a, _ in self.mro(c) if a in self.classes for r in [*(f.relation for f in self.classes[a].fields), *(x for x, _ in self.classes[a].valid)] if r]
        return list(dict.fromkeys(relations)), [c for c in seen if not self.classes[c].abstract]

    def parents_by_depth(self, name: str) -> list[str]:
        """Direct parents without those that another one already descends from."""
        own = self.classes[name].parents
        above = {p: {a for a, d in self.mro(p) if d} for p in own}
        return [p for p in own if not any(p in above[q] for q in own if q != p)]

    def dependency_order(self) -> list[str]:
        """Parents and field targets first; ties and cycles by name."""
        left = {c: {p for p in [*s.parents, *(f.target for f in s.fields if not f.literal)] if p in self.classes and p != c} for c, s in self.classes.items()}
        out: list[str] = []
        while left:
            free = sorted(c for c, need in left.items() if not need & left.keys()) or [min(left)]
            out += free
            for c in free:
                del left[c]
        return out

    def nearest(self, name: str, among: Iterable[str]) -> str | None:
        """The nearest ancestor of a set of classes (the type to assert)."""
        among = set(among)
        return next((a for a, _ in self.mro(name) if a in among), None)

    def tables(self, spark) -> dict:
        """classes, class_parent, class_mro, fields, valid_relations, relations."""
        cs = self.classes.values()
        rows = {
            "classes": ([(c.name, c.label, c.comment, c.abstract, c.type) for c in cs], "name string, label string, comment string, abstract boolean, asserted string"),
            "class_parent": ([(c.name, p, i) for c in cs for i, p in enumerate(c.parents)], "class string, parent string, position int"),
            "class_mro": ([(c.name, a, d) for c in cs for a, d in self.mro(c.name)], "class string, ancestor string, depth int"),
            "fields": ([(c.name, f.name, self.relation_of(c.name, f) if f.target or f.relation else None, f.target, f.min, f.max, f.qualified, f.optional, i) for c in cs for i, f in enumerate(self.fields(c.name))], "class string, field string, relation string, target string, min int, max int, qualified boolean, optional boolean, position int"),
            "valid_relations": ([(c.name, r, c.name if t == "Self" else t, i) for c in cs for i, (r, t) in enumerate(c.valid)], "class string, relation string, target string, position int"),
            "relations": ([(r.name, r.subproperty_of, r.domain, r.range, r.inverse_of, r.symmetric) for r in self.relations.values()], "name string, subproperty_of string, domain string, range string, inverse_of string, symmetric boolean"),
        }
        return {name: spark.createDataFrame(data, schema) for name, (data, schema) in rows.items()}
