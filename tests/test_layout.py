"""Stored graphs and property tables: rows as before, exchanges and scans fewer."""

from __future__ import annotations

import re

import pytest

from weft.model import Catalog, ClassSpec, Field
from weft.operators import paths as P
from weft.plans import classquery
from weft.plans.classquery import class_query
from weft.plans.pattern import EXACT, join_order, match
from weft.sources import layout
from weft.sources.graph import TYPE, Graph

ROWS = [
    ("a", TYPE, "Box"), ("b", TYPE, "Box"), ("c", TYPE, "Box"), ("d", TYPE, "Lid"), ("e", TYPE, "Lid"), ("a", "holds", "d"), ("a", "holds", "e"), ("a", "holds", "x"), ("b", "holds", "d"), ("c", "holds", "x"),
    ("a", "size", "1"), ("b", "size", "2"), ("c", "size", "2"), ("a", "colour", "red"), ("b", "colour", "red"), ("c", "colour", "blue"), ("b", "note", "n1"), ("b", "note", "n2"), ("a", "size", "1"), ("z", "size", "1"),
]


@pytest.fixture(scope="module")
def triples(spark):
    return spark.createDataFrame(ROWS, "s string, p string, o string")


def catalog():
    f = Field
    return Catalog().add(
        ClassSpec("Lid"),
        ClassSpec("Box", (f("lid", "Lid", "holds"), f("other", None, "holds"), f("size", "string", "size"), f("colour", "string", "colour", value="red"), f("note", "string", "note", optional=True, min=0))),
        ClassSpec("Plain", (f("size", "string", "size"), f("colour", "string", "colour"), f("note", "string", "note", optional=True, min=0)), asserted="Box"),
    )


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("name", ["Box", "Plain"])
@pytest.mark.parametrize("options", [{}, {"optional": True}, {"check_types": False}, {"fields": ["size"]}])
def test_property_tables_give_the_rows_of_joins(triples, name, options):
    plain, known = Graph(triples), layout.measured(Graph(triples))
    joined, gathered = class_query(plain, catalog(), name, **options), class_query(known, catalog(), name, **options)
    assert joined.columns == gathered.columns and rows(joined) == rows(gathered) != []


def test_hot_subjects_are_joined(triples, monkeypatch):
    """A relation with more values of one subject than the bound keeps its join."""
    monkeypatch.setattr(classquery, "WIDE", 2)
    known = layout.measured(Graph(triples))
    assert not known.few_values("holds", 2) and known.few_values("size", 2)
    assert rows(class_query(known, catalog(), "Box")) == rows(class_query(Graph(triples), catalog(), "Box"))


def exchanges(df) -> int:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"Exchange", plan.split("== Initial Plan ==")[0]))


@pytest.fixture()
def large(spark):
    """Plans as for large tables: nothing is broadcast."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def test_fields_take_one_exchange(triples, large):
    known = layout.measured(Graph(triples))
    one = class_query(known, catalog(), "Plain", distinct=False)
    assert exchanges(one) == 1
    assert exchanges(class_query(Graph(triples), catalog(), "Plain", distinct=False)) > 2


def test_stored_graphs_join_without_an_exchange(spark, triples, large):
    g = layout.store(triples, "weft_boxes", buckets=4)
    assert {r: (k.triples, k.subjects, k.most_values) for r, k in g.statistics.items()} == {TYPE: (5, 5, 1), "holds": (5, 3, 3), "size": (4, 4, 1), "colour": (3, 3, 1), "note": (2, 1, 2)}
    star = g.edges("size").join(g.edges("colour").withColumnRenamed("o", "c"), "s")
    assert exchanges(star) == 0 and star.count() == 3
    assert exchanges(class_query(g, catalog(), "Plain", distinct=False)) == 0
    plan = g.edges("size")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*p#\d+ = size", plan)
    again = layout.open_stored(spark, "weft_boxes")
    assert rows(class_query(again, catalog(), "Box")) == rows(class_query(Graph(triples), catalog(), "Box"))
    assert rows(match(again, [("?s", "size", "2"), ("?s", "colour", "?c")], select=["s", "c"])) == [("b", "red"), ("c", "blue")]


def test_empty_and_odd_triples(spark):
    schema = "s string, p string, o string"
    assert layout.store(spark.createDataFrame([("a", None, "x"), (None, "p", "x"), ("a", "p q/r=s", "x")], schema), "weft_odd", buckets=2).edges("p q/r=s").collect() == [("a", "x")]
    none = layout.measured(Graph(spark.createDataFrame([], schema)))
    assert class_query(none, catalog(), "Plain").count() == 0


# --- join order ---


def many(spark):
    """1,000 people in two towns, each with a job; one of them has a medal."""
    people = [(f"p{i}", r, o) for i in range(1000) for r, o in (("town", f"t{i % 2}"), ("job", f"j{i % 50}"), ("knows", f"p{(i + 1) % 1000}"))]
    return layout.measured(Graph(spark.createDataFrame([*people, ("p7", "medal", "gold"), ("p7", TYPE, "Person")], "s string, p string, o string")))


def test_order_by_statistics_keeps_intermediates_small(spark):
    g = many(spark)
    asked = [("?a", "town", "t1"), ("?a", "knows", "?b"), ("?b", "job", "?j"), ("?a", "medal", "?m")]
    order = join_order(g, asked)
    assert order[0] == asked[3] and sorted(order) == sorted(asked)
    largest = lambda g, ps: max(prefix(g, ps, k) for k in range(1, len(ps) + 1))
    assert largest(g, asked) >= 10 * largest(g, order)
    for graph in (g, Graph(g.triples)):
        assert rows(match(graph, asked, select=["a", "b", "j", "m"])) == [("p7", "p8", "j8", "gold")]


def prefix(g, patterns, k):
    """Rows after the first k patterns, joined as they stand."""
    out = None
    for s, p, o in patterns[:k]:
        edge = g.edges(p)
        edge = edge.where(edge.o == o).selectExpr(f"s as {s[1:]}") if not o.startswith("?") else edge.selectExpr(f"s as {s[1:]}", f"o as {o[1:]}")
        out = edge if out is None else out.join(edge, [c for c in edge.columns if c in out.columns])
    return out.count()


def test_orders_stay_connected(spark):
    g = many(spark)
    chain = [(f"?x{i}", "knows", f"?x{i + 1}") for i in range(EXACT + 2)]
    for asked in (chain, chain[:4]):
        order, seen = join_order(g, asked), set()
        for s, _, o in order:
            assert not seen or seen & {s, o}
            seen |= {s, o}
        assert sorted(order) == sorted(asked)
    assert join_order(g, [("?a", "nothing", "?b"), ("?a", "town", "?t")])[0][1] == "nothing"
    assert match(g, [("?a", "medal", "gold"), ("?a", "a", "Person"), ("?a", "?r", "?o")], select=["r"]).count() == 5


def test_count_bounds_share_a_pass(spark, triples, large):
    """Bounds on one path are one aggregation; a qualified count asks for what is there."""
    from weft.operators import shapes

    g = Graph(triples)
    bounds = (shapes.min_count("holds", 2), shapes.max_count("holds", 2, severity="Info"), shapes.min_count("note", 1))
    report = shapes.validate(g, [shapes.Shape("B", "Box", bounds)])
    assert {(r.focus, r.constraint_id, r.n, r.severity) for r in report.collect()} == {("b", "minCount", 1, "Violation"), ("c", "minCount", 1, "Violation"), ("a", "maxCount", 3, "Info"), ("a", "minCount", 0, "Violation"), ("c", "minCount", 0, "Violation")}
    focus = shapes.focus_of(g, "Box")
    for part in (shapes.of_type("Lid"), shapes.and_(shapes.of_type("Lid"), shapes.has_value(P.inverse("holds"), "b")), shapes.or_(shapes.has_value("size", "1"), shapes.of_type("Lid"))):
        asked = shapes.qualified_min("holds", part, 2)
        slow = shapes.qualified_min("holds", shapes.and_(part, shapes.min_count("never", 0)), 2)
        assert rows(shapes.violations(g, focus, asked)) == rows(shapes.violations(g, focus, slow))
    assert exchanges(shapes.violations(g, focus, shapes.qualified_min("holds", shapes.has_value("size", "1"), 1))) <= 6
