"""Shape graphs, adapters, sinks, declarations and the command line on small inputs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from weft import __main__ as command
from weft.functions import terms
from weft.model import Catalog, ClassSpec, Field
from weft.operators import ingest, naming, paths, shapegraph, shapes, templates
from weft.operators.ingest import OWL, RDFS, SH
from weft.plans.classquery import class_query
from weft.plans.pattern import match
from weft.sources import files
from weft.sources.graph import SCHEMA, TYPE, Graph

TURTLE = """
@prefix : <http://x/> . @prefix sh: <http://www.w3.org/ns/shacl#> . @prefix owl: <http://www.w3.org/2002/07/owl#> .
@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
:Pump a owl:Class, sh:NodeShape ; rdfs:subClassOf :Device ;
  sh:property [ sh:path :port ; sh:minCount 2 ; sh:class :Port ; sh:severity sh:Warning ; sh:message "two ports" ] ,
    [ sh:path [ sh:inversePath :feeds ] ; sh:minCount 1 ] ,
    [ sh:path ( :port :medium ) ; sh:in ( :Air :Water ) ] ,
    [ sh:path :speed ; sh:datatype xsd:integer ; sh:maxCount 1 ] ,
    [ sh:path :broken ; sh:maxCount 0 ] ,
    [ sh:path [ sh:alternativePath ( :a :b ) ] ; sh:hasValue 3 ] ;
  sh:or ( [ sh:property [ sh:path :a ; sh:minCount 1 ] ] [ sh:property [ sh:path :b ; sh:minCount 1 ] ] ) ;
  sh:not [ sh:class :Retired ] .
:Port a owl:Class . :Device a :Abstract, sh:NodeShape . :SmallPump a owl:Class, sh:NodeShape ; rdfs:subClassOf :Pump .
:port a owl:ObjectProperty ; owl:inverseOf :portOf .
"""

DATA = """
@prefix : <http://x/> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
:good a :Pump ; :port :p1, :p2 ; :speed 5 ; :a 3 . :p1 a :Port ; :medium :Air . :p2 a :Port ; :medium :Water . :z :feeds :good .
:bad a :SmallPump, :Retired ; :port :p3, :p4 ; :speed "x", 7 ; :broken true . :p3 a :Port ; :medium :Oil .
"""


@pytest.fixture(scope="module")
def ontology(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("ontology")
    (folder / "o.ttl").write_text(TURTLE)
    (folder / "d.ttl").write_text(DATA)
    return folder, files.read_turtle(spark, f"{folder}/o.ttl").cache(), files.read_turtle(spark, f"{folder}/d.ttl").cache()


def test_turtle_shapes_validate_data(spark, ontology):
    _, triples, data = ontology
    report = shapes.validate(Graph(data), shapegraph.shapes_of(triples))
    got = {(r.focus.rsplit("/")[-1], r.constraint_id, (r.value or "").rsplit("/")[-1], r.severity) for r in report.collect()}
    assert got == {
        ("bad", "class", "p4", "Warning"), ("bad", "minCount", "", "Violation"), ("bad", "in", "Oil", "Violation"), ("bad", "datatype", "x", "Violation"),
        ("bad", "maxCount", "", "Violation"), ("bad", "forbidden", "true", "Violation"), ("bad", "hasValue", "", "Violation"), ("bad", "or", "", "Violation"), ("bad", "not", "", "Violation"),
    }
    assert shapes.conforms_to(Graph(data), shapegraph.shapes_of(triples)).first().conforms is False
    assert shapes.conforms_to(Graph(data.where(~F.col("s").endswith("bad"))), shapegraph.shapes_of(triples)).first().conforms is True


def test_adapters(ontology):
    _, triples, _ = ontology
    own = {r.local_name: r for r in ingest.classes(triples, ingest.shape_classes("http://x/", "http://x/Abstract", meta=("http://x/SmallPump",))).collect()}
    assert {n: r.is_abstract for n, r in own.items()} == {"Pump": False, "Device": True}
    plain = {r.local_name: r.is_abstract for r in ingest.classes(triples, ingest.plain_classes("http://x/")).collect()}
    assert plain == {"Pump": False, "Device": False, "SmallPump": False, "Port": True}
    base = triples.where(F.col("s").isin("http://x/Pump", "http://x/Device"))
    more = ingest.classes(triples.where(F.col("s") == "http://x/SmallPump"), ingest.plain_classes("http://x/"), base).collect()
    assert [(r.local_name, r.asserted) for r in more] == [("SmallPump", "http://x/Pump")]


def test_only_fields_are_unresolved(ontology):
    _, triples, _ = ontology
    kinds = ingest.classify_shapes(triples)
    relations, classes = ingest.relations(triples, ingest.plain_classes("http://x/")), ingest.classes(triples, ingest.plain_classes("http://x/"))
    got = {(r.path.rsplit("/")[-1], r.reason) for r in ingest.unresolved(kinds, classes, relations).collect()}
    assert got == {("speed", "relation-out-of-scope")}  # neither inverse, forbidden nor value-only shapes


def test_command_line(spark, ontology, tmp_path, capsys):
    folder, _, _ = ontology
    command.main([f"{folder}/o.ttl", "--kind", "plain", "--namespace", "http://x/", "--out", f"{tmp_path}/out"])
    assert "classes 4" in capsys.readouterr().out
    recorded = files.read_tables(spark, f"{tmp_path}/out", "sources")["sources"]
    now = files.checksums(spark, f"{folder}/*.ttl")
    assert [(r.file.rsplit("/")[-1], r.state) for r in files.stale(now, recorded).collect()] == [("d.ttl", "new")]
    assert files.stale(now.where("file like '%o.ttl'").withColumn("sha256", F.lit("x")), recorded).first().state == "changed"


def test_declarations_round_trip(spark):
    c = Catalog().add(ClassSpec("Port"), ClassSpec("Pump", (Field("inlet", "Port", "port", max=2), Field("n", "long", "count", qualified=False, max=1), Field("kind", value="x", relation="kind"), Field("none", relation="never", exact=()))))
    data = [("p", TYPE, "Pump"), ("p", "port", "a"), ("a", TYPE, "Port"), ("p", "count", "3"), ("p", "kind", "x"), ("q", TYPE, "Pump"), ("q", "count", "y"), ("q", "count", "4"), ("q", "never", "z")]
    graph = Graph(spark.createDataFrame(data, "s string, p string, o string"))
    key = lambda df: sorted((r.focus, r.constraint_id, r.value or "", r.n or 0) for r in df.collect())
    direct = shapes.validate(graph, [shapes.shape_of(c, "Pump")])
    read = shapes.validate(graph, shapegraph.shapes_of(shapegraph.shape_triples(spark, c, "Pump")))
    assert key(direct) == key(read) == sorted([("q", "qualifiedMinCount", "", 0), ("q", "maxCount", "", 2), ("q", "datatype", "y", 0), ("q", "hasValue", "", 0), ("q", "forbidden", "z", 0)])
    own = shapegraph.shape_rows(Catalog().add(ClassSpec("A", (Field("x", "long", "r"),)), ClassSpec("B", (Field("y", "long", "r"),), parents=("A",))), "B", inherited=False)
    assert sum(p == SH + "path" for _, p, *_ in own) == 1 and ("B", RDFS + "subClassOf", "A", "iri", None, None) in own


def test_strict_shapes_count_fields():
    c = Catalog().add(ClassSpec("P"), ClassSpec("D", (Field("a", "P", "port", min=0), Field("b", "P", "port", max=4))))
    asked = {(x.kind, x.arg) for x in shapes.shape_of(c, "D", strict=True).constraints}
    assert {("minCount", 2), ("qualifiedMinCount", 1)} <= asked
    rows = {(p.removeprefix(SH), o) for _, p, o, *_ in shapegraph.shape_rows(c, "D", strict=True)}
    assert {("minCount", "2"), ("maxCount", "4"), ("qualifiedMinCount", "1")} <= rows and ("qualifiedMinCount", "0") not in rows


def test_optional_fields_of_the_own_table(spark):
    table = spark.createDataFrame([(1, "a", None), (2, "b", 5)], "k long, name string, size long")
    g = Graph().map_table("T", table, "k", hasName="name", hasSize="size")
    c = Catalog().add(ClassSpec("T", (Field("label", "string", "hasName"), Field("size", "long", "hasSize", optional=True), Field("mark", value="a", relation="hasName", templatize=False))))
    assert sorted(map(tuple, class_query(g, c, "T", optional=True).collect())) == [(1, "a", None), (2, "b", 5)]
    assert class_query(g, c, "T").columns == ["name", "label"]


def test_blank_subjects_in_turtle(spark, tmp_path):
    (tmp_path / "a.ttl").write_text('@prefix : <http://x/> . :a :p [ :q "v" ] . _:n :r _:n .')
    given = files.read_turtle(spark, f"{tmp_path}/a.ttl")
    files.as_turtle(given).write.text(f"{tmp_path}/out")
    again = files.read_turtle(spark, f"{tmp_path}/out/*.txt")
    assert again.count() == 3
    assert paths.pairs(Graph(again), paths.seq("http://x/p", "http://x/q")).first().o == "v"
    assert again.where("s = o").count() == 1


def test_names_never_clash(spark):
    rows = [(1, "a"), (2, "a"), (3, "a_2"), (4, "a_2_2"), (5, "a"), (6, "a_2"), (7, "a_4"), (8, "a"), (9, "b_1"), (10, "b")]
    got = [r.unique_name for r in naming.make_unique(spark.createDataFrame(rows, "k long, name string"), "name", ["k"]).orderBy("k").collect()]
    assert len(set(got)) == len(got)
    assert got == ["a", "a_3", "a_2", "a_2_2", "a_5", "a_2_3", "a_4", "a_6", "b_1", "b"]


def test_names_go_on_beyond_the_numbers_of_the_sql(spark, tmp_path):
    """the SQL lists numbers below 400; with more of them it names every row as the query does."""
    import duckdb

    import __spark_entry__ as entry

    spark.range(2000).select(F.col("id").alias("p_partkey"), F.concat(F.lit("Brand#"), F.col("id") % 2).alias("p_brand")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    got = {r.p_partkey: r.uname for r in entry.queries()["make_unique_among_taken"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
    sql = entry.oracle_sql()["make_unique_among_taken"]
    cut, whole = (dict(con.execute(t).fetchall()) for t in (sql, sql.replace("range(2, 400)", "range(2, 3000)")))
    assert None not in got.values() and got == whole
    assert None in cut.values() and all(got[k] == v for k, v in cut.items() if v is not None)


def test_variable_relations_and_type_edges(spark):
    g = Graph(spark.createDataFrame([("a", TYPE, "C"), ("a", "p", "x"), ("C", "up", "D"), ("b", TYPE, "D"), ("b", "p", "b")], "s string, p string, o string"))
    assert {r.s for r in match(g, [("?s", paths.seq("a", paths.star("up")), "D")]).collect()} == {"a", "b"}
    assert {tuple(r) for r in match(g, [("?s", "p", "x"), ("?s", "?r", "?o")], select=["r", "o"]).collect()} == {(TYPE, "C"), ("p", "x")}
    assert [r.s for r in match(g, [("?s", "?r", "?s")]).select("s").collect()] == ["b"]


def test_template_files(tmp_path):
    import yaml

    c = Catalog().add(ClassSpec("Unit"), ClassSpec("Thing", (Field("unit", "Unit", "hasUnit"),)), ClassSpec("Base", abstract=True))
    templates.write_template_set(c, f"{tmp_path}/t", ("Unit",))
    templates.write_template_set(Catalog().add(ClassSpec("More")), f"{tmp_path}/t", overwrite=False)
    read = lambda k: yaml.safe_load((tmp_path / "t" / f"{k}.yml").read_text())
    assert set(read("entities")) == {"Thing", "More"} and set(read("values")) == {"Unit"}
    assert read("entities")["Thing"]["dependencies"] == [{"template": "Unit", "args": {"name": "unit"}}]


def test_entity_classes_and_segments(spark):
    c = Catalog()

    @c.entity()
    class Space:
        area: float = Field(relation="hasArea")

    @c.entity(parents=("Space",))
    class Office(Space):
        area = 9.0

    assert [(f.name, f.value, f.relation) for f in c.fields("Office")] == [("area", 9.0, "hasArea")]
    names = spark.createDataFrame([("AHUs",), ("VAV",), ("SetPoints",), ("Set-Up",), ("Class",)], "n string")
    assert [r[0] for r in names.select(terms.module_segment("n")).collect()] == ["ah_us", "vav", "set_points", "set_up", "class_"]
    assert OWL and SCHEMA
