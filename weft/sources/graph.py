"""A graph: triples in a DataFrame, relational tables mapped to one, or both.

A mapped relation is two columns of a table. Nothing is ever turned into triples
to be queried: a star of fields that lie in one table is a projection of it.
Results have set semantics.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
SCHEMA = "s string, p string, o string, o_kind string, o_dt string, o_lang string"


@dataclass(frozen=True)
class Mapped:
    table: DataFrame
    subject: str
    object: str | None = None


class Graph:
    def __init__(self, triples: DataFrame | None = None) -> None:
        if triples is not None and not {"s", "p", "o"} <= set(triples.columns):
            raise ValueError(f"triples need columns s, p, o; got {triples.columns}")
        self.triples = triples
        self.types: dict[str, Mapped] = {}
        self.relations: dict[str, list[Mapped]] = {}
        self.paths: dict = {}  # relations that stand for a path
        self.statistics: dict | None = None  # of the triples' relations, where they are known

    @property
    def spark(self):
        tables = [self.triples, *(m.table for m in self.types.values()), *(m.table for ms in self.relations.values() for m in ms)]
        return next(t for t in tables if t is not None).sparkSession

    def map_type(self, name: str, table: DataFrame, key: str) -> Graph:
        self.types[name] = Mapped(table, key)
        return self

    def map_relation(self, name: str, table: DataFrame, subject: str, object_: str) -> Graph:
        self.relations.setdefault(name, []).append(Mapped(table, subject, object_))
        return self

    def map_path(self, name: str, path) -> Graph:
        """A relation that stands for a path over others. Between bound ends it is walked;
        its pairs are made only where one asks for its edges."""
        self.paths[name] = path
        return self

    def map_table(self, type_: str, table: DataFrame, key: str, **relations: str) -> Graph:
        self.map_type(type_, table, key)
        for relation, column in relations.items():
            self.map_relation(relation, table, key, column)
        return self

    def instances(self, *types: str) -> DataFrame:
        """(name): subjects of exactly these types, not of subclasses."""
        parts = [self.types[t].table.select(F.col(self.types[t].subject).alias("name")) for t in types if t in self.types]
        if self.triples is not None:
            parts.append(self.triples.where((F.col("p") == TYPE) & F.col("o").isin(*types)).select(F.col("s").alias("name")))
        if not parts:
            raise KeyError(f"no instances of {types}")
        return _union(parts)

    def edges(self, relation: str) -> DataFrame:
        """(s, o) of a relation; duplicates may remain. ``a`` is the type relation."""
        if relation in ("a", TYPE):
            return self._type_edges()
        parts = [m.table.select(F.col(m.subject).alias("s"), F.col(m.object).alias("o")) for m in self.relations.get(relation, [])]
        if self.triples is not None:
            parts.append(self.triples.where(F.col("p") == relation).select("s", "o"))
        if relation in self.paths:
            from ..operators.paths import pairs

            parts.append(pairs(self, self.paths[relation]))
        if not parts:
            raise KeyError(f"no relation {relation}")
        return _union(parts).where(F.col("s").isNotNull() & F.col("o").isNotNull())

    def _type_edges(self) -> DataFrame:
        parts = [m.table.select(F.col(m.subject).alias("s"), F.lit(t).alias("o")) for t, m in self.types.items()]
        if self.triples is not None:
            parts.append(self.triples.where(F.col("p") == TYPE).select("s", "o"))
        if not parts:
            raise KeyError("no types")
        if len({p.schema["s"].dataType for p in parts}) > 1:  # keys of different kinds
            parts = [p.withColumn("s", F.col("s").cast("string")) for p in parts]
        return _union(parts).where(F.col("s").isNotNull())

    def in_table_of(self, type_: str, relation: str) -> str | None:
        """The column that holds the relation in the type's own table, if it alone does."""
        own, found = self.types.get(type_), self.relations.get(relation, [])
        if own and len(found) == 1 and relation not in self.paths and self.triples is None and found[0].table is own.table and found[0].subject == own.subject:
            return found[0].object
        return None

    def as_triples(self) -> DataFrame:
        """Everything as one triples table, for sinks; set semantics."""
        text = lambda c: F.col(c).cast("string")
        parts = [m.table.select(text(m.subject).alias("s"), F.lit(TYPE).alias("p"), F.lit(t).alias("o")) for t, m in self.types.items()]
        parts += [m.table.where(F.col(m.object).isNotNull()).select(text(m.subject).alias("s"), F.lit(r).alias("p"), text(m.object).alias("o")) for r, ms in self.relations.items() for m in ms]
        parts += [self.edges(r).select(text("s").alias("s"), F.lit(r).alias("p"), text("o").alias("o")) for r in self.paths if r not in self.relations]
        if self.triples is not None:
            parts.append(self.triples.select("s", "p", "o"))
        return _union(parts).distinct()

    def with_statistics(self, statistics: dict) -> Graph:
        """The same graph, with what is known of each relation of its triples."""
        out = Graph(self.triples)
        out.types, out.relations, out.statistics = dict(self.types), {k: list(v) for k, v in self.relations.items()}, dict(statistics)
        out.paths = dict(self.paths)
        return out

    def few_values(self, relation: str, most: int) -> bool:
        """Whether the relation lies in the triples alone, and is known to have no more
        than ``most`` values of one subject."""
        known = (self.statistics or {}).get(relation)
        return self.triples is not None and relation not in self.relations and relation not in self.paths and self.statistics is not None and (known is None or known.most_values <= most)

    def with_triples(self, more: DataFrame) -> Graph:
        """Set union with more triples."""
        out = Graph(more if self.triples is None else self.triples.unionByName(more, allowMissingColumns=True).distinct())
        out.types, out.relations = dict(self.types), {k: list(v) for k, v in self.relations.items()}
        out.paths = dict(self.paths)
        return out


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
