"""Blank nodes named by the graph alone: relabelled copies give one text."""

from __future__ import annotations

import random

import pytest

from weft.operators.canonical import canonical, graph_difference
from weft.sources.files import as_ntriples
from weft.sources.graph import SCHEMA

P, Q = "http://e/p", "http://e/q"


def graph(*rows):
    kind = lambda o: "bnode" if o.startswith("_:") else "iri" if o.startswith("http") else "literal"
    return [(s, p, o, kind(o), None, None) for s, p, o in rows]


GRAPHS = {
    "no_blank": graph(("http://e/a", P, "http://e/b")),
    "empty": [],
    "equal_nodes": graph(*[(f"_:n{i}", P, "x") for i in range(4)], ("http://e/a", Q, "_:n0")),
    "list": graph(*[(f"_:l{i}", P, f"_:l{i + 1}") for i in range(6)], ("_:l6", P, "http://e/nil")),
    "ring": graph(*[(f"_:r{i}", P, f"_:r{(i + 1) % 5}") for i in range(5)], ("_:x", P, "_:x")),
    "two_rings": graph(*[(f"_:r{i}", P, f"_:r{(i + 1) % 3}") for i in range(3)], *[(f"_:t{i}", P, f"_:t{(i + 1) % 3}") for i in range(3)], ("_:r0", Q, "x")),
    "star_of_equals": graph(*[("_:hub", P, f"_:leaf{i}") for i in range(5)], ("_:leaf0", Q, "_:leaf1")),
}


@pytest.mark.parametrize("name", GRAPHS)
def test_relabelled_copies_give_one_text(spark, name):
    rows = GRAPHS[name]
    nodes = sorted({x for r in rows for x in (r[0], r[2]) if x.startswith("_:")})
    texts = []
    for seed in (0, 1):
        fresh = random.Random(seed).sample(range(10**6), len(nodes))
        to = dict(zip(nodes, (f"file{seed}#_:{k}" for k in fresh)))
        copy = [(to.get(r[0], r[0]), r[1], to.get(r[2], r[2]), *r[3:]) for r in rows]
        got = canonical(spark.createDataFrame(copy, SCHEMA))
        found = got.collect()
        assert len({tuple(r) for r in found}) == len(rows)
        assert len({x for r in found for x in (r.s, r.o) if x.startswith("_:")}) == len(nodes)
        texts.append(sorted(r.value for r in as_ntriples(got).collect()))
    assert texts[0] == texts[1]


def test_a_change_shows(spark):
    a = spark.createDataFrame(graph(("_:1", P, "_:2"), ("_:2", P, "x"), ("_:3", Q, "y")), SCHEMA)
    b = spark.createDataFrame(graph(("_:7", P, "_:8"), ("_:8", P, "x"), ("_:9", Q, "z")), SCHEMA)
    assert sorted((r.p, r.o, r.change) for r in graph_difference(a, b).collect()) == [(Q, "y", "removed"), (Q, "z", "added")]


def test_nodes_without_links_take_no_rounds(spark, monkeypatch):
    """such nodes are named by what they see; of equal ones each has a name of its own."""
    from weft.operators import canonical as module

    monkeypatch.setattr(module, "_refined", None)
    monkeypatch.setattr(module, "_connected", None)
    rows = graph(*[(f"_:n{i}", P, str(i // 2)) for i in range(6)], ("http://e/a", Q, "_:n0"), ("http://e/a", P, "http://e/b"), ("_:n5", P, "2"))
    found = [{(r.s, r.p, r.o) for r in canonical(spark.createDataFrame(part, SCHEMA)).collect()} for part in (rows, [(r[0].replace("_:n", "x#_:m"), r[1], r[2].replace("_:n", "x#_:m"), *r[3:]) for r in rows])]
    assert found[0] == found[1] and len(found[0]) == 8
    assert len({x for r in found[0] for x in (r[0], r[2]) if x.startswith("_:")}) == 6


def test_linked_and_single_nodes_in_one_graph(spark):
    rows = graph(("_:1", P, "_:2"), ("_:2", P, "x"), ("_:3", Q, "y"), ("_:4", Q, "y"), ("http://e/a", Q, "_:1"))
    a = spark.createDataFrame(rows, SCHEMA)
    b = spark.createDataFrame([(r[0].replace("_:", "z#_:9"), r[1], r[2].replace("_:", "z#_:9"), *r[3:]) for r in rows], SCHEMA)
    assert canonical(a).distinct().count() == 5 and graph_difference(a, b).isEmpty()


def exchanges(df) -> int:
    """Exchanges of the plan that ran."""
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning")


def test_nodes_are_named_where_they_lie(spark):
    """triples that are dealt by their node are not moved again, and get the names that they get elsewhere."""
    from pyspark.sql import functions as F

    rows = graph(*[(f"_:n{i}", P, str(i // 2)) for i in range(60)], *[("http://e/a", Q, f"_:n{i}") for i in range(0, 60, 3)], *[(f"_:s{i}", Q, f"only {i}") for i in range(40)])
    given = spark.createDataFrame(rows, SCHEMA)
    node = F.when(F.col("o_kind") == "bnode", F.col("o")).otherwise(F.col("s"))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for few in ("10m", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", few)
        try:
            placed = given.repartition(4, F.xxhash64(node)).select("*", node.alias("node"), F.xxhash64(node).alias("place"))
            found = canonical(placed, repeats=False, at=("node", "place"))
            assert found.columns == given.columns
            got = sorted((r.s, r.p, r.o) for r in found.collect())
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
        assert exchanges(found) <= (1 if few == "10m" else 2)  # with "-1" the names of tied nodes move too
        assert len(set(got)) == len(rows) and len({x for r in got for x in (r[0], r[2]) if x.startswith("_:")}) == 100
        # tied nodes are numbered in the order of their labels, elsewhere too
        assert got == sorted((r.s, r.p, r.o) for r in canonical(given).collect())


@pytest.mark.parametrize("differ", [0, 1, 30])
def test_graphs_are_compared_by_sums_first(spark, differ):
    """what two graphs share, repeats counted; only triples of buckets that differ are compared."""
    from collections import Counter

    from weft.operators.canonical import shared_triples

    one = graph(*[(f"http://e/{i}", P if i % 3 else Q, str(i)) for i in range(900)], *[("http://e/r", P, "twice")] * 2)
    two = [r for i, r in enumerate(one) if i >= differ] + graph(*[("http://e/new", "http://e/only", str(i)) for i in range(differ)]) + one[600:601] * (differ > 0)
    found = shared_triples(*[spark.createDataFrame(g, SCHEMA).repartition(3) for g in (one, two)])
    both = Counter(one) & Counter(two)
    want = {p: (sum(r[1] == p for r in one), sum(n for r, n in both.items() if r[1] == p)) for p in (P, Q)}
    assert {r.p: (r.n, r.shared) for r in found.collect()} == want
