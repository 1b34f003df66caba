"""Block documents as they are written, and shape graphs with parts of every kind."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from weft.model import Catalog, ClassSpec, Field
from weft.operators import ingest, naming, paths, shapegraph, shapes
from weft.operators.ingest import RDFS, SH
from weft.sources.graph import SCHEMA, TYPE, Graph

ROOT = "ex:" + ingest.BLOCK_ROOT


@pytest.fixture(scope="module")
def nodes(spark):
    ref = lambda n: {"@id": ROOT + n}
    controller = [
        {
            "@id": ROOT + "Units.Controller", "@type": "S231:Block", "S231:documentation": "", "S231:description": "Controller of a box", "S231:hasInput": [ref("Units.Controller.TZon"), ref("Units.Controller.uOpe"), ref("Units.Controller.odd")],
            "S231:hasOutput": ref("Units.Controller.y"), "S231:hasParameter": [ref(f"Units.Controller.{n}") for n in ("gain", "zone", "venStd", "damCon", "kind", "gone")],
            "S231:containsBlock": [ref("Units.Controller.dam"), ref("Units.Controller.gain"), ref("Units.Controller.leaf"), ref("Units.Controller.bare"), ref("Units.Controller.far")],
        },
        {"@id": ROOT + "Units.Controller.TZon", "@type": "S231:RealInput", "S231:label": "TZon", "qudt:hasQuantityKind": {"@id": "q:ThermodynamicTemperature"}, "qudt:hasUnit": {"@id": "unit:K"}, "S231:description": "Zone"},
        {"@id": ROOT + "Units.Controller.uOpe", "@type": "S231:BooleanInput", "qudt:hasQuantityKind": {"@id": "http://q/kind#Flow"}},
        {"@id": ROOT + "Units.Controller.odd", "@type": "S231:OddInput", "S231:label": "renamed"},
        {"@id": ROOT + "Units.Controller.y", "@type": "S231:IntegerOutput"},
        {"@id": ROOT + "Units.Controller.gain", "@type": "S231:Parameter", "S231:isOfDataType": {"@id": "S231:Real"}, "S231:value": {"@value": "0.25", "@type": "xsd:decimal"}},
        {"@id": ROOT + "Units.Controller.zone", "S231:value": ingest.BLOCK_ROOT + "Types.Zone.Not_Specified"},
        {"@id": ROOT + "Units.Controller.venStd", "S231:description": "Ventilation standard"},
        {"@id": ROOT + "Units.Controller.damCon", "S231:value": "Buildings.Controls.OBC.CDL.Types.SimpleController.PI"},
        {"@id": ROOT + "Units.Controller.kind", "S231:isOfDataType": ref("Types.Zone"), "S231:value": 3},
        {"@id": ROOT + "Units.Controller.dam", "@type": ROOT + "Units.Dampers", "S231:label": "dam"}, {"@id": ROOT + "Units.Controller.leaf", "@type": "S231:Parameter"}, {"@id": ROOT + "Units.Controller.bare"},
        {"@id": ROOT + "Units.Controller.far", "@type": "ex:Buildings.Elsewhere.PID"},
    ]
    zone = [{"@id": ROOT + "Types.Zone", "@type": "S231:EnumerationType"}, {"@id": ROOT + "Types.Zone.Not_Specified", "@type": ROOT + "Types.Zone"}, {"@id": ROOT + "Types.Zone.One", "@type": ROOT + "Types.Zone", "S231:label": "Zone_1", "S231:description": "first"}]
    files = {"a": controller, "b": zone, "c": [{"@id": ROOT + "Units.Dampers", "@type": "S231:Block"}], "d": [{"@id": "ex:nothing"}]}
    return ingest.graph_nodes(spark.createDataFrame([(k, json.dumps({"@graph": v})) for k, v in files.items()], "file string, value string")).cache()


def test_fields_of_a_block(nodes):
    got = {r.name: r for r in ingest.block_fields(nodes).collect()}
    assert {(n, r.kind, r.value_type, r.helper) for n, r in got.items()} == {
        ("TZon", "input", "Real", "real_input_field"), ("uOpe", "input", "Boolean", "boolean_input_field"), ("renamed", "input", "Unknown", "unknown_input_field"), ("y", "output", "Integer", "integer_output_field"),
        ("gain", "parameter", "Real", "real_parameter_field"), ("zone", "parameter", "Types.Zone", "enum_parameter_field"), ("venStd", "parameter", "Unknown", "unknown_parameter_field"), ("damCon", "parameter", "Unknown", "unknown_parameter_field"),
        ("kind", "parameter", "Types.Zone", "enum_parameter_field"),
    }
    assert (got["TZon"].quantitykind, got["TZon"].unit, got["TZon"].description) == ("ThermodynamicTemperature", "K", "Zone") and got["uOpe"].quantitykind == "Flow"
    assert got["zone"].default.text == "Not_Specified" and got["damCon"].default.text.endswith("SimpleController.PI")
    assert got["gain"].default.number == 0.25 and got["kind"].default.kind == "long" and {r.block for r in got.values()} == {"Units.Controller"}


def test_blocks_and_what_they_contain(nodes):
    assert {tuple(r) for r in ingest.blocks(nodes).select("dotted_path", "class_name", "description").collect()} == {("Units.Controller", "Controller", "Controller of a box"), ("Units.Dampers", "Dampers", None)}
    assert {(r.name, r.block_type, r.resolved) for r in ingest.sub_blocks(nodes).collect()} == {("dam", "Units.Dampers", True), ("far", "Buildings.Elsewhere.PID", False)}
    assert {tuple(r) for r in ingest.enum_literals(nodes).collect()} == {("Types.Zone", "Not_Specified", None), ("Types.Zone", "Zone_1", "first")}
    said = {r.message for r in ingest.block_warnings(nodes).collect()}
    assert {f"unresolved parameter reference: {ROOT}Units.Controller.gone", "no block or enumeration", "external block type Buildings.Elsewhere.PID of Units.Controller.far", "unknown type of parameter Units.Controller.damCon"} <= said
    assert not [m for m in said if "zone" in m or "bare" in m]


def corpus(n: int = 400):
    """Documents of every shape that one may have, made by chance."""
    import random

    rnd = random.Random(4)
    text = lambda: rnd.choice(["", "x", "a.b", "é", '{"@id":"i1"}', ' {"@id":"i1"}', "[1]", "Unknown", "5", '"q"', "S231:Block"])
    ids = ["i1", "i2", ROOT + "A.B", ROOT + "C", "S231:Block", None, 5, "", text]
    pick = lambda xs: (lambda x: x() if callable(x) else x)(rnd.choice(xs))
    ref = lambda: pick([lambda: {"@id": pick(ids)}] * 12 + ["i1", "odd", None, True, 5, 2.50, ["i1"], {}, {"x": 1}, text])
    value = lambda: pick([None, True, 3, -0.0, 1.50, "Types.Zone.One", ROOT + "Types.Z.L", text, {}, {"@value": "T.L"}, {"@value": 3}, {"@value": {"a": 1}}, ["a"]])
    types = lambda: pick(["S231:RealInput", "S231:Parameter", "S231:Block", "S231:EnumerationType", ROOT + "C", "ex:Far", ["S231:Block", "x"], [None], [], [ROOT + "A.B"], {"@id": "x"}, ["S231:RealInput", 5], text])

    def node():
        n = {}
        for key, share, made in (("@id", 0.9, lambda: pick(ids)), ("@type", 0.7, types), ("S231:label", 0.3, value), ("S231:value", 0.4, value), ("S231:isOfDataType", 0.4, ref)):
            if rnd.random() < share:
                n[key] = made()
        for key in ("S231:hasInput", "S231:hasOutput", "S231:hasParameter", "S231:containsBlock"):
            if rnd.random() < 0.35:
                n[key] = pick([lambda: [ref() for _ in range(rnd.randrange(4))], ref])
        return n

    plain = [json.dumps({"@graph": [node() for _ in range(rnd.randrange(5))]}, ensure_ascii=rnd.random() < 0.5) for _ in range(n)]
    odd = [None, "", "{", "[]", "5", "{}", '{"@graph":null}', '{"@graph":{"@id":"a"}}', '{"@graph":[{"@id":"a"},"odd",null]}', '{"@graph":[{"@id":"b","S231:hasInput":{"@id":"\\ud800"}}]}', '{"@graph":[]} x', '{"@graph":[{"@id":-0,"S231:hasInput":[-0,0]}]}']
    return [(None if k == 7 else f"f{k}", v) for k, v in enumerate(plain + odd)]


def test_warnings_where_documents_are_parsed(spark):
    """one look at each document says what nodes and references that meet in a window say;
    plain documents make no rows of what is right, and are not set aside."""
    from weft.operators import documents

    made = spark.createDataFrame(corpus(), "file string, value string").repartition(3).localCheckpoint()
    want = ingest.block_warnings(ingest.graph_nodes(made))
    got = ingest.document_warnings(made)
    count = lambda df: sorted((str(r.file), str(r.message), r["count"]) for r in df.groupBy("file", "message").count().collect())
    assert count(got) == count(want) and len(count(want)) > 100
    taken = 0
    for _, value in corpus():
        try:
            taken += bool(documents.facts(value or ""))
        except ValueError:
            pass
    assert 40 < taken < 400
    right = {"@graph": [{"@id": "b", "@type": "S231:Block", "S231:hasInput": [{"@id": f"i{k}"} for k in range(50)]}, *[{"@id": f"i{k}", "@type": "S231:RealInput"} for k in range(50)]]}
    assert [r[0] for r in documents.facts(json.dumps(right))] == ["type"]


def shape(*parts, node=()):
    """Rows of a node shape with one property shape."""
    rows = [("S", TYPE, SH + "NodeShape", "iri", None, None), ("S", SH + "property", "_:p", "bnode", None, None), ("_:p", SH + "path", "v", "iri", None, None)]
    for subject, (part, value) in [*(("_:p", x) for x in parts), *(("S", x) for x in node)]:
        rows.append((subject, SH + part, value, "literal", None, None))
    return rows


DATA = [("a", TYPE, "S"), ("a", "v", "x1"), ("b", TYPE, "S"), ("b", "v", "long text"), ("c", TYPE, "S"), ("c", "v", "7"), ("d", "w", "a"), ("a", "next", "b")]


def breaks(spark, rows):
    report = shapes.validate(Graph(spark.createDataFrame(DATA, "s string, p string, o string")), shapegraph.shapes_of(spark.createDataFrame(rows, SCHEMA)))
    return {r.focus for r in report.collect()}


@pytest.mark.parametrize("part", ["equals", "disjoint", "lessThan", "uniqueLang", "nodeKind", "languageIn", "closed", "qualifiedValueShapesDisjoint", "invented"])
def test_unknown_parts_are_refused(spark, part):
    with pytest.raises(ValueError, match=part):
        shapegraph.shapes_of(spark.createDataFrame(shape((part, "true")), SCHEMA))
    with pytest.raises(ValueError, match=part):
        shapegraph.shapes_of(spark.createDataFrame(shape(node=[(part, "true")]), SCHEMA))


def test_parts_without_a_form_there_are_refused(spark):
    with pytest.raises(ValueError, match="datatype"):  # of the focus itself
        shapegraph.shapes_of(spark.createDataFrame(shape(node=[("datatype", "x")]), SCHEMA))
    with pytest.raises(ValueError, match="path"):
        shapegraph.shapes_of(spark.createDataFrame([("S", TYPE, SH + "NodeShape", "iri", None, None), ("S", SH + "property", "_:p", "bnode", None, None)], SCHEMA))
    with pytest.raises(ValueError, match="path"):
        shapegraph.shapes_of(spark.createDataFrame([*shape(("minCount", "1"))[:2], ("_:p", SH + "path", "_:q", "bnode", None, None), ("_:q", SH + "oddPath", "v", "iri", None, None)], SCHEMA))


@pytest.mark.parametrize("parts, wrong", [
    ([("pattern", "^X")], {"a", "b", "c"}), ([("pattern", "^X"), ("flags", "i")], {"b", "c"}), ([("minLength", "2")], {"c"}), ([("maxLength", "2")], {"b"}), ([("minInclusive", "7")], {"a", "b"}), ([("maxExclusive", "7")], {"a", "b", "c"}),
    ([("value", "x1")], {"b", "c"}), ([("name", "a name"), ("order", "1"), ("minCount", "1")], set()), ([("minCount", "5"), ("deactivated", "true")], set()), ([("closed", "false"), ("minCount", "2")], {"a", "b", "c"}),
])
def test_parts_with_a_form(spark, parts, wrong):
    assert breaks(spark, shape(*parts)) == wrong


def test_targets(spark):
    assert breaks(spark, shape(("minCount", "5"), node=[("targetNode", "b")])) == {"b"}
    assert breaks(spark, shape(("minCount", "5"), node=[("targetSubjectsOf", "w")])) == {"d"}
    assert breaks(spark, shape(("minCount", "5"), node=[("targetObjectsOf", "w")])) == {"a"}
    assert breaks(spark, shape(("minCount", "5"), node=[("deactivated", "true")])) == set()


def test_optional_steps(spark):
    g = Graph(spark.createDataFrame(DATA, "s string, p string, o string"))
    assert {tuple(r) for r in paths.pairs(g, paths.maybe("next")).collect()} == {("a", "a"), ("b", "b"), ("a", "b")}
    rows = [*shape(("hasValue", "b"))[:2], ("_:p", SH + "path", "_:q", "bnode", None, None), ("_:q", SH + "zeroOrOnePath", "next", "iri", None, None), ("_:p", SH + "hasValue", "b", "iri", None, None)]
    assert breaks(spark, rows) == {"c"}  # a by one step, b by none


def test_pinned_individuals(spark):
    c = Catalog().add(ClassSpec("Hot"), ClassSpec("S", (Field("kind", value="Hot", relation="v"), Field("n", value="x1", relation="v"))))
    rows = shapegraph.shape_rows(c, "S")
    assert {(p.removeprefix(SH), o) for _, p, o, *_ in rows if o in ("Hot", "x1")} == {("value", "Hot"), ("hasValue", "x1")}
    assert {(x.kind, x.arg) for x in shapegraph.shapes_of(spark.createDataFrame(rows, SCHEMA))[0].constraints} == {("hasValue", "Hot"), ("hasValue", "x1")}


def test_long_chains_are_followed(spark):
    n = 7
    up = [(f"c{i}", RDFS + "subClassOf", f"c{i + 1}") for i in range(n)] + [(f"c{n}", RDFS + "subClassOf", "c0")]
    triples = spark.createDataFrame(up, "s string, p string, o string")
    one = lambda x: spark.createDataFrame([(x,)], "name string")
    assert [tuple(r) for r in ingest.nearest_in(triples, one("c0"), one(f"c{n}")).collect()] == [("c0", f"c{n}")]
    assert ingest.nearest_in(triples, one("c0"), one("none")).count() == 0  # the cycle ends
    c = Catalog().add(*[ClassSpec(f"k{i}", parents=(f"k{i + 1}",)) for i in range(300)])
    assert len(c.mro("k0")) == 301
    paths_ = [("x", ".".join(["same"] * 20)), ("x", ".".join(["other", *["same"] * 19])), ("y", "a.b"), ("y", "b")]
    assert {tuple(r) for r in naming.alias_depth(spark.createDataFrame(paths_, "n string, p string"), "n", "p").select("n", "depth").collect()} == {("x", 20), ("y", 2)}
    assert F is not None


def test_only_changed_files_are_parsed(spark, tmp_path):
    import os

    from weft.sources import files

    folder = tmp_path / "docs"
    folder.mkdir()
    document = lambda n: json.dumps({"@graph": [{"@id": f"ex:B{n}", "@type": "S231:Block"}]})
    for k in range(6):
        (folder / f"{k}.jsonld").write_text(document(k))
    first = files.manifest(spark, str(folder)).cache()
    assert first.count() == 6
    parsed = ingest.graph_nodes(files.read_documents(spark, str(folder)))
    rows = spark.createDataFrame(parsed.collect(), parsed.schema)  # as they were: a cached plan would answer for the new files too
    assert rows.count() == 6
    (folder / "1.jsonld").write_text(document("one"))
    os.remove(folder / "2.jsonld")
    (folder / "9.jsonld").write_text(document(9))
    name = lambda path: path.rsplit("/", 1)[-1]
    second = files.manifest(spark, str(folder), first)
    state = files.stale(second, first).cache()
    assert {(name(r.file), r.state) for r in state.collect()} == {("1.jsonld", "changed"), ("2.jsonld", "gone"), ("9.jsonld", "new")}
    changed = files.read_changed(spark, state)
    assert {name(f) for f in changed.inputFiles()} == {"1.jsonld", "9.jsonld"}
    strip = lambda c: F.regexp_extract(c, "([^/]*)$", 1).alias("file")  # noqa: E731  path forms of readers differ
    now = files.refreshed(rows.withColumn("file", strip("file")), state.withColumn("file", strip("file")), ingest.graph_nodes(changed).withColumn("file", strip("file")))
    whole = ingest.graph_nodes(files.read_documents(spark, str(folder))).withColumn("file", strip("file"))
    assert sorted(map(str, now.collect())) == sorted(map(str, whole.collect()))
    assert files.read_changed(spark, state.limit(0)).count() == 0


def test_template_sets_are_read_back(tmp_path):
    from weft.operators import templates

    c = Catalog().add(ClassSpec("Unit"), ClassSpec("Thing", (Field("unit", "Unit", "hasUnit"),)))
    templates.write_template_set(c, f"{tmp_path}/t", ("Unit",))
    read = templates.read_template_set(f"{tmp_path}/t")
    assert read == json.loads(json.dumps(templates.template_set(c, ("Unit",)), default=str)) and set(read["values"]) == {"Unit"}
    assert templates.read_template_set(f"{tmp_path}/none") == {"relations": {}, "entities": {}, "values": {}}
    (tmp_path / "t" / "entities.yml").write_text("Unit: {}")
    with pytest.raises(ValueError, match="Unit"):
        templates.read_template_set(f"{tmp_path}/t")
