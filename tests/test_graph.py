"""Readers, writers, paths, shapes, rules and streams on small graphs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from weft.functions import terms
from weft.operators import naming, paths, shapes
from weft.operators.rules import TypeRule, infer_types
from weft.sources import files
from weft.sources.graph import SCHEMA, TYPE, Graph
from weft.streaming import triples as streaming


def graph(spark, *rows):
    return Graph(spark.createDataFrame(list(rows), "s string, p string, o string"))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# --- paths ---


def test_paths_on_a_cycle(spark):
    g = graph(spark, ("a", "r", "b"), ("b", "r", "c"), ("c", "r", "a"), ("c", "q", "d"))
    assert rows(paths.pairs(g, paths.plus("r"))) == sorted((x, y) for x in "abc" for y in "abc")
    assert rows(paths.pairs(g, paths.seq("r", "q"))) == [("b", "d")]
    assert rows(paths.pairs(g, paths.inverse("q"))) == [("d", "c")]
    assert rows(paths.pairs(g, paths.alt("q", paths.inverse("q")))) == [("c", "d"), ("d", "c")]
    assert ("d", "d") in rows(paths.pairs(g, paths.star(paths.alt("r", "q"))))


def test_closure_of_a_long_path(spark):
    chain = spark.range(130).select(F.lit(1).alias("conv_id"), F.col("id").alias("s"), (F.col("id") + 1).alias("o"))
    got = paths.closure(chain, within=["conv_id"])
    assert got.count() == 130 * 131 // 2 and got.where("s >= o").count() == 0


def test_closure_stops_at_its_levels(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(6)], "s long, o long")
    assert paths.closure(chain).count() == 21
    with pytest.raises(RecursionError):
        paths.closure(chain, levels=3)


def test_empty_graph(spark):
    g = Graph(spark.createDataFrame([], "s string, p string, o string"))
    assert paths.pairs(g, paths.plus("r")).count() == 0
    with pytest.raises(ValueError):
        Graph(spark.createDataFrame([], "s string, p string"))


# --- readers and writers ---

TURTLE = '''
@prefix : <http://x/> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
:a a :C ; :v 1, 2.5, true ; :t "x\\"y"@en, """long "text" """ ; :p [ :q ( :b :c ) ] .
_:n :r "3"^^xsd:int . # comment
'''


def test_turtle(spark, tmp_path):
    (tmp_path / "a.ttl").write_text(TURTLE)
    got = files.read_turtle(spark, f"{tmp_path}/*.ttl")
    values = {(r.p.rsplit("/")[-1], r.o, r.o_lang) for r in got.collect()}
    assert {("v", "1", None), ("v", "2.5", None), ("v", "true", None), ("t", 'x"y', "en"), ("t", 'long "text" ', None), ("r", "3", None)} <= values
    assert got.where(F.col("o_kind") == "bnode").count() == 3  # the node and two list cells
    assert got.count() == 13


def test_ntriples_round_trip(spark, tmp_path):
    given = spark.createDataFrame([("http://x/a", "http://x/p", 'q"\\\nz', "literal", None, "en"), ("http://x/a", TYPE, "http://x/C", "iri", None, None), ("http://x/a", "http://x/n", "1", "literal", "http://x/int", None)], SCHEMA)
    files.write_ntriples(given, f"{tmp_path}/nt")
    assert {tuple(map(str, r)) for r in files.read_ntriples(spark, f"{tmp_path}/nt").collect()} == {tuple(map(str, r)) for r in given.collect()}


def test_checksums(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    assert files.checksums(spark, f"{tmp_path}/*.txt").first().sha256 == "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"


# --- shapes and rules ---


def test_counts_see_nodes_without_values(spark):
    g = graph(spark, ("a", TYPE, "C"), ("b", TYPE, "C"), ("a", "p", "1"), ("a", "p", "2"))
    focus = shapes.focus_of(g, "C")
    assert [r.focus for r in shapes.violations(g, focus, shapes.min_count("p", 1)).collect()] == ["b"]
    assert [r.focus for r in shapes.violations(g, focus, shapes.max_count("p", 1)).collect()] == ["a"]
    assert {r.focus: r.ok for r in shapes.conforms(g, focus, shapes.not_(shapes.min_count("p", 1))).collect()} == {"a": False, "b": True}


def test_rules_run_to_a_fixed_point(spark):
    g = graph(spark, ("a", TYPE, "C"), ("b", TYPE, "C"), ("a", "p", "1"))
    rules = [TypeRule("C", "D", shapes.min_count("p", 1)), TypeRule("D", "E", shapes.min_count("p", 1))]
    _, new = infer_types(g, rules)
    assert rows(new.select("name", "inferred")) == [("a", "D"), ("a", "E")]


# --- names ---


def test_names(spark):
    df = spark.createDataFrame([("http://x/y#hasFooBar",), ("http://x/isOf/",), ("http://x/class",)], "iri string")
    got = [tuple(r) for r in df.select(terms.local_name("iri"), terms.field_name_for_path("iri")).collect()]
    assert got == [("hasFooBar", "foo_bar"), ("isOf", "of"), ("class", "class_")]


def test_make_unique_skips_taken_names(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a_2"), (4, "a")], "k long, name string")
    names = [r.unique_name for r in naming.make_unique(df, "name", ["k"]).orderBy("k").collect()]
    assert len(set(names)) == 4 and names[0] == "a" and names[2] == "a_2"


# --- streams ---


def test_stream(spark, tmp_path):
    spark.createDataFrame([("a", "r", "b", 0), ("a", "r", "c", 60), ("b", "q", "c", 0)], "s string, p string, o string, t long").withColumn("ts", F.col("t").cast("timestamp")).drop("t").write.parquet(f"{tmp_path}/in")
    counts = streaming.relation_counts(streaming.read_stream(spark, f"{tmp_path}/in"))
    query = counts.writeStream.format("memory").queryName("relation_counts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    assert query.awaitTermination(120)
    found = spark.table("relation_counts")
    assert found.count() == 2
    known = spark.createDataFrame([("b",)], "name string")
    related = streaming.relate(streaming.read_stream(spark, f"{tmp_path}/in"), known, "r")
    query = related.writeStream.format("memory").queryName("related").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp2").start()
    assert query.awaitTermination(120) and spark.table("related").count() == 1


def test_ntriples_lines(spark, tmp_path):
    (tmp_path / "a.nt").write_text('<s><p>"x # y"@en.# said\n<s> <p> _:b . # more\n_:b<p><o>.\n# all\n\n')
    got = {(r.p, r.o_kind, r.o_lang) for r in files.read_ntriples(spark, str(tmp_path / "a.nt")).collect()}
    assert got == {("p", "literal", "en"), ("p", "bnode", None), ("p", "iri", None)}
    (tmp_path / "b.nt").write_text("<s> <p> .\n")
    with pytest.raises(Exception, match="not a triple"):
        files.read_ntriples(spark, str(tmp_path / "b.nt")).collect()
