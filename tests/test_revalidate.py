"""Reports brought up to date equal full ones."""

from __future__ import annotations

import random

import pytest

from weft.operators import paths as P
from weft.operators import revalidate, shapes
from weft.operators.shapes import Shape, validate
from weft.sources.graph import TYPE, Graph

rnd = random.Random(4)
NODES = [f"n{i}" for i in range(25)]


def triples(count):
    return sorted({(rnd.choice(NODES), p, rnd.choice(["A", "B"]) if p == TYPE else rnd.choice(NODES)) for p in (TYPE, "p", "q", "r") for _ in range(count)})


BEFORE = triples(22)
AFTER = sorted(set(BEFORE[3:-4]) | {("n3", "p", "n4"), ("n5", TYPE, "A"), ("n6", "q", "n7"), ("n6", "r", "n9"), ("new", TYPE, "A"), ("new", "p", "n1")})

SHAPES = [
    Shape("counts", "A", (shapes.min_count("p", 1), shapes.max_count("q", 0), shapes.of_class(P.inverse("r"), "B", severity="Warning"))),
    Shape("deep", "A", (shapes.qualified_min("p", shapes.and_(shapes.of_type("B"), shapes.min_count("q", 1)), 1), shapes.node(P.seq("p", "q"), shapes.or_(shapes.has_value("r", "n9"), shapes.min_count(P.inverse("p"), 1))))),
    Shape("paths", "B", (shapes.min_count(P.plus("p"), 3), shapes.has_value(P.seq("r", P.star("q")), "n7"), shapes.not_(shapes.min_count(P.inverse(P.seq("q", "r")), 1)))),
    Shape("ends", ("subjects", "q"), (shapes.min_count(P.alt("p", "r"), 2),)),
]


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("which", range(len(SHAPES)))
def test_reports_equal_full_ones(spark, which):
    before, after = (spark.createDataFrame(x, "s string, p string, o string") for x in (BEFORE, AFTER))
    asked = SHAPES[which : which + 1]
    report = validate(Graph(before), asked)
    full, stepwise = rows(validate(Graph(after), asked)), rows(revalidate.revalidate(before, after, asked, report))
    assert stepwise == full and full != rows(report)


def test_only_touched_nodes_are_checked(spark, monkeypatch):
    before = spark.createDataFrame(BEFORE, "s string, p string, o string")
    after = spark.createDataFrame([*BEFORE, ("n2", "p", "n3")], "s string, p string, o string")
    seen = []

    def spy(graph, asked, catalog=None, only=None):
        seen.append({r.focus for r in only.collect()})
        return validate(graph, asked, catalog, only)

    monkeypatch.setattr(revalidate, "validate", spy)
    asked = [Shape("counts", "A", (shapes.min_count("p", 1), shapes.max_count("q", 0)))]
    revalidate.revalidate(before, after, asked, validate(Graph(before), asked)).collect()
    assert seen == [{"n2"}]


def test_entailment_after_changes(spark):
    """Deleted triples take with them what rests on them alone, cycles of inverses too."""
    from weft.model import Catalog, ClassSpec, Relation
    from weft.operators.rules import entail, entail_changes

    c = Catalog().add(
        ClassSpec("Top"), ClassSpec("A", parents=("Top",)), ClassSpec("B", parents=("A",)), Relation("above"), Relation("near", subproperty_of="above", domain="A", range="B", inverse_of="by"), Relation("by", inverse_of="near"), Relation("like", symmetric=True)
    )
    before = [("x", "near", "y"), ("x", "near", "z"), ("u", "by", "x"), ("p", "like", "q"), ("y", TYPE, "A"), ("w", TYPE, "B")]
    after = [("x", "near", "z"), ("q", "like", "p"), ("y", TYPE, "A"), ("w", TYPE, "Top"), ("n", "above", "m"), ("x", "above", "y")]
    frame = lambda x: spark.createDataFrame(x, "s string, p string, o string")
    for old, new in ((before, after), (after, before), (before, before[:1]), (before, before)):
        full = entail(Graph(frame(new)), c)
        assert rows(entail_changes(entail(Graph(frame(old)), c), frame(old), frame(new), c)) == rows(full)
