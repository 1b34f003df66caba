"""Labels, seeded paths and chains against brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from weft.operators import paths as P
from weft.operators import reach
from weft.plans import pattern
from weft.plans.pattern import match
from weft.sources.graph import Graph


def brute(edges):
    after = {}
    for s, o in edges:
        after.setdefault(s, set()).add(o)
    out = set()
    for s in {n for e in edges for n in e}:
        todo, seen = list(after.get(s, ())), set()
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += after.get(n, ())
        out |= {(s, n) for n in seen}
    return out


def rows(df):
    found = [tuple(r) for r in df.select("s", "o").collect()]
    assert len(found) == len(set(found))
    return set(found)


def frame(spark, edges):
    return spark.createDataFrame(edges, "s long, o long")


rnd = random.Random(11)
GRAPHS = {
    "path": [(i, i + 1) for i in range(70)],
    "ring": [(i, (i + 1) % 40) for i in range(40)],
    "ring_with_tail_and_loop": [(i, (i + 1) % 20) for i in range(20)] + [(5, 100), (100, 101), (101, 101), (200, 3)],
    "tree": [(i, (i - 1) // 2) for i in range(1, 40)],
    "comb": [(i, i + 1) for i in range(20)] + [(i, 100 + i) for i in range(20)],
    "ladder": [(i, i + 1) for i in range(15)] + [(50 + i, 51 + i) for i in range(15)] + [(i, 50 + i) for i in range(0, 15, 2)] + [(51 + i, i) for i in range(0, 5)],
    "two_way": [(a, b) for a in range(6) for b in range(6) if a != b] + [(5, 9), (9, 9)],
    "sparse": [(rnd.randrange(40), rnd.randrange(40)) for _ in range(45)],
    "dense": [(rnd.randrange(15), rnd.randrange(15)) for _ in range(60)],
    "acyclic": [(a, b) for a, b in ((rnd.randrange(30), rnd.randrange(30)) for _ in range(70)) if a < b],
}


#: all of them side by side, nodes moved apart
EVERY = [(1000 * k + s, 1000 * k + o) for k, edges in enumerate(GRAPHS.values()) for s, o in edges]


def test_labels_hold_what_paths_reach(spark):
    want = brute(EVERY)
    labels = reach.Reach.of(frame(spark, EVERY + EVERY[::9] + [(None, 1), (1, None)]))
    assert rows(labels.pairs()) == want
    nodes = sorted({n for e in EVERY for n in e})
    some = set(nodes[::7])
    seeds = spark.createDataFrame([(n,) for n in [*some, 10**6]], "name long")
    assert rows(labels.ahead(seeds)) == {p for p in want if p[0] in some}
    assert rows(labels.behind(seeds)) == {p for p in want if p[1] in some}
    asked = [(s, o) for s in nodes[::5] for o in nodes if s // 1000 == o // 1000] + [(nodes[0], 10**6), (0, 1001)]
    assert rows(labels.holding(frame(spark, asked))) == want & set(asked)


def test_empty_graph(spark):
    assert rows(reach.Reach.of(frame(spark, [])).pairs()) == set()


def test_long_path_has_few_entries(spark):
    """Labels grow with the nodes, not with the pairs."""
    n = 5000
    edges = spark.range(n).select(F.col("id").alias("s"), (F.col("id") + 1).alias("o"))
    labels = reach.Reach.of(edges.unionByName(spark.range(n).select((F.col("id") + 10**6).alias("s"), ((F.col("id") + 1) % n + 10**6).alias("o"))))
    assert labels.entries.count() == 1 and labels.nodes.select("chain").distinct().count() == 2  # a path; a ring and its way back
    assert labels.behind(spark.createDataFrame([(n,)], "name long")).count() == n
    asked = [(10**6 + 7, 10**6 + 3), (10**6 + 3, 10**6 + 3), (7, 3), (3, 7), (3, 3), (3, 10**6)]
    assert rows(labels.holding(frame(spark, asked))) == {*asked[:2], (3, 7)}


def triples(edges, relation="next"):
    return [(str(s), relation, str(o)) for s, o in edges]


@pytest.fixture(scope="module")
def mixed(spark):
    data = triples(GRAPHS["sparse"]) + triples(GRAPHS["tree"], "up") + [("3", "mark", "x"), ("9", "mark", "x"), ("none", "mark", "x")]
    return Graph(spark.createDataFrame(data, "s string, p string, o string"))


PATHS = {
    "plus": P.plus("next"), "star": P.star("next"), "inverse": P.plus(P.inverse("next")), "steps": P.seq("up", P.star("next")), "back": P.inverse(P.seq(P.plus("up"), "next")),
    "either": P.alt("up", P.plus(P.alt("next", "up"))), "nested": P.plus(P.seq("next", P.star("up"))),
}


@pytest.mark.parametrize("name, levels", [("plus", 24), ("star", 1), ("inverse", 24), ("steps", 24), ("back", 2), ("either", 24), ("nested", 24)])
def test_seeded_paths_equal_filtered_ones(spark, mixed, monkeypatch, name, levels):
    monkeypatch.setattr(P, "LEVELS", levels)
    seeds = spark.createDataFrame([("3",), ("9",), ("12",)], "name string")
    every = P.pairs(mixed, PATHS[name], nodes=seeds)
    wanted = [r.name for r in seeds.collect()]
    assert rows(P.pairs_from(mixed, PATHS[name], seeds)) == {p for p in rows(every) if p[0] in wanted}
    assert rows(P.pairs_from(mixed, PATHS[name], seeds, back=True)) == {p for p in rows(every) if p[1] in wanted}


def test_bound_ends_never_make_all_pairs(mixed, monkeypatch):
    def all_pairs(*a, **k):
        raise AssertionError("the whole closure")

    want = brute(GRAPHS["sparse"])
    monkeypatch.setattr(P, "closure", all_pairs)
    monkeypatch.setattr(pattern, "pairs", lambda g, p, **k: all_pairs() if P.recursive(p) else P.pairs(g, p, **k))
    ahead = {r.o for r in match(mixed, [("3", P.plus("next"), "?o")]).collect()}
    assert ahead == {str(o) for s, o in want if s == 3}
    behind = {r.s for r in match(mixed, [("?s", P.plus("next"), "9")]).collect()}
    assert behind == {str(s) for s, o in want if o == 9}
    bound = {tuple(r) for r in match(mixed, [("?s", "mark", "x"), ("?s", P.star("next"), "?o")], select=["s", "o"]).collect()}
    assert bound == {(str(s), str(o)) for s, o in want if s in (3, 9)} | {(n, n) for n in ("3", "9", "none")}
    with pytest.raises(AssertionError):
        match(mixed, [("?s", P.plus("next"), "?o")])
