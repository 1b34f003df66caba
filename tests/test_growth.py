"""Steps whose work grows no faster than their input."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import ingest


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_of_one_type_are_spread(spark):
    """types are few; the rows of one are not one task's."""
    rows = spark.range(2000).select(F.col("id"), F.lit("Types.Levels").alias("value_type"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = ingest._with_known(rows, spark.createDataFrame([("Types.Levels",)], "value_type string"), "value_type", "known")
        parts = [r["count"] for r in found.where("known").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert sum(parts) == 2000 and max(parts) < 1500


def test_references_read_their_documents_once(spark):
    """nodes and references come of one pass; each node of an id is found."""
    value = '{"@graph":[{"@id":"b","@type":"S231:Block","S231:hasInput":{"@id":"i"},"S231:containsBlock":["j",{"@id":"i"}]},{"@id":"i","@type":["t","u"]},{"@id":"i","@type":"v"},{"@type":"S231:Block","S231:hasOutput":{"@id":"i"}},"odd",null]}'
    found = ingest.block_references(ingest.graph_nodes(spark.createDataFrame([("f", value), ("g", '{"@graph":[{"@id":"j"}]}'), ("h", None)], "file string, value string")))
    assert plan(found).count("ExistingRDD") == 1
    got = sorted((str(r.block), r.kind, r.position, r.ref_id, str(r.target_types), r.unresolved) for r in found.collect())
    assert got == sorted(
        [(b, k, at, "i", str(t), False) for b, k, at in (("b", "input", 0), ("b", "sub_block", 1), ("None", "output", 0)) for t in (["t", "u"], ["v"])] + [("b", "sub_block", 0, "j", "None", True)]
    )


def far_apart(spark, n: int):
    """n customers and n suppliers of one nation; each order has one of both."""
    from weft.sources.graph import Graph

    rows = spark.range(n).select(F.col("id").alias("k"), F.lit(1).alias("nation"), (F.col("id") + n).alias("sup"))
    g = Graph().map_type("Order", rows, "k").map_relation("placedBy", rows, "k", "k").map_relation("suppliedBy", rows, "k", "sup")
    return g.map_relation("hasNation", rows, "k", "nation").map_relation("supplierNation", rows, "sup", "nation")


def most_rows(df) -> int:
    """The largest number of rows that an operator of the plan that ran put out."""
    import re

    df.collect()
    text = df._jdf.queryExecution().executedPlan()
    found, todo = [0], [text]
    while todo:
        node = todo.pop()
        metric = node.metrics().get("numOutputRows")
        if metric.isDefined():
            found.append(metric.get().value())
        inner = node.getClass().getSimpleName()
        if inner == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif re.search("QueryStageExec$", inner):
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return max(found)


def test_absent_groups_start_at_what_is_bound(spark):
    """pairs that only share a node are not made."""
    from weft.plans.pattern import match

    g, n = far_apart(spark, 300), 300
    found = match(g, [("?name", "suppliedBy", "?s"), ("?name", "placedBy", "?c")], absent=[[("?c", "hasNation", "?n"), ("?s", "supplierNation", "?n")]])
    assert most_rows(found) < 10 * n and found.count() == 0
    other = g.map_relation("suppliedBy", spark.range(1).select(F.lit(7).alias("k"), F.lit(-1).alias("sup")), "k", "sup")
    kept = match(other, [("?name", "suppliedBy", "?s"), ("?name", "placedBy", "?c")], absent=[[("?c", "hasNation", "?n"), ("?s", "supplierNation", "?n")]])
    assert [tuple(r) for r in kept.select("name", "s", "c").collect()] == [(7, -1, 7)]


def test_what_only_has_to_exist_is_dropped(spark):
    """a path through a node that all share makes no pairs."""
    from weft.operators import paths as P
    from weft.plans.pattern import match

    found = match(far_apart(spark, 300), [("?name", "a", "Order")], present=[[[("?name", P.seq("hasNation", P.inverse("supplierNation")), "?s")]]])
    assert most_rows(found) < 3000 and found.count() == 300


def test_a_path_between_two_fields_is_walked(spark):
    """a relation that stands for a path is checked at the pairs there are."""
    from weft.model import Between, Catalog, ClassSpec, Field
    from weft.operators import paths as P
    from weft.plans.classquery import class_query

    g = far_apart(spark, 300).map_path("sameNation", P.seq("hasNation", P.inverse("supplierNation")))
    c = Catalog().add(ClassSpec("Order", (Field("customer", "long", "placedBy"), Field("supplier", "long", "suppliedBy")), between=(Between("customer", "sameNation", "supplier"),)))
    found = class_query(g, c, "Order")
    assert most_rows(found) < 3000 and found.count() == 300
    assert g.edges("sameNation").count() == 300 * 300


def test_notes_are_distinct(spark):
    """of shapes that say the same of one path there is one note, not one each."""
    sh = ingest.SH
    rows = [t for i in range(5) for t in (("o", sh + "property", f"_:p{i}"), (f"_:p{i}", sh + "path", "r"), (f"_:p{i}", sh + "qualifiedValueShape", f"_:v{i}"), (f"_:v{i}", sh + "nodeKind", "x"))]
    assert [tuple(r) for r in ingest.supplementary(spark.createDataFrame(rows, "s string, p string, o string")).collect()] == [("o", "r", "nodeKind")]


def test_documents_are_parsed_as_a_whole(spark):
    """Keys of a node are read with its document, also beside what is no object; only
    references of the kinds that are asked for are made."""
    value = '{"@graph":[{"@id":"ex:b","@type":["S231:Block"],"S231:hasInput":[{"@id":"ex:b.i"},"ex:b.j"],"S231:hasParameter":{"@id":"ex:b.p"}},"odd",7,null,[1],{"@id":"ex:b.i","@type":"S231:RealInput","S231:label":{"@value":"in"}},{"@id":"ex:b.j"},{"@id":"ex:b.p","S231:value":true}]}'
    nodes = ingest.graph_nodes(spark.createDataFrame([("f", value), ("g", '{"@graph":{"@id":"x"}}'), ("h", "{")], "file string, value string"))
    every = nodes.select("node", "fields", ingest._fields(F.col("node"), ingest._NODE).alias("own")).collect()
    assert len([r for r in every if r.fields and r.fields["@id"]]) >= 4 and all(r.fields == r.own for r in every)
    whole = ingest.ports(nodes)
    for kind, names in (("input", ["in", "j"]), ("parameter", ["p"])):
        asked = ingest.ports(nodes, kinds=(kind,))
        assert sorted(r.name for r in asked.collect()) == names
        assert sorted(map(str, asked.collect())) == sorted(map(str, whole.where(F.col("kind") == kind).collect()))


def test_an_ontology_is_made_of_distinct_rows(spark, tmp_path):
    """the triples of a brand and type are made once, not for each part."""
    from weft.ontology_queries import _ontology

    spark.range(2000).select(F.concat(F.lit("Brand#"), F.col("id") % 3).alias("p_brand"), F.lit("PROMO").alias("p_type")).write.parquet(f"{tmp_path}/part.parquet")
    found = _ontology(spark, str(tmp_path))
    assert most_rows(found) <= 2000 and found.count() == 3 * 4 + 3 + 2


def two_values(spark, n: int):
    """n orders with 20 parts and 20 suppliers each, rows repeated."""
    from weft.sources.graph import Graph

    orders, line = spark.range(n).select(F.col("id").alias("k")), spark.range(n * 40).select((F.col("id") % n).alias("k"), (F.col("id") % (20 * n)).alias("v"))
    return Graph().map_type("Order", orders.union(orders), "k").map_relation("hasItem", line, "k", "v").map_relation("suppliedBy", line, "k", "v")


def test_rows_of_distinct_fields_are_not_compared(spark):
    """what joins distinct edges is distinct; no aggregation holds the joined rows."""
    from weft.model import Catalog, ClassSpec, Field
    from weft.plans.classquery import class_query

    c = Catalog().add(ClassSpec("Order", (Field("part", "long", "hasItem"), Field("supplier", "long", "suppliedBy"))))
    found = class_query(two_values(spark, 10), c, "Order")
    top = plan(found)
    assert top.index("Join") < top.index("HashAggregate") and found.count() == found.distinct().count() == 10 * 20 * 20


def test_rings_are_known_by_two_times_round(spark):
    """rounds are as the longest ring, not as the number of nodes on rings."""
    from weft.operators import reach

    n, written = 3000, []
    edges = spark.range(n).select(F.col("id").alias("s"), F.when(F.col("id") % 3 == 2, F.col("id") - 2).otherwise(F.col("id") + 1).alias("o"))
    kept, reach.stored = reach.stored, lambda df: written.append(1) or kept(df)
    try:
        labels = reach.Reach.of(edges)
    finally:
        reach.stored = kept
    assert len(written) < 10 and labels.nodes.select("chain").distinct().count() == n // 3
    assert labels.pairs().groupBy("s").count().where("count <> 3").isEmpty() and labels.pairs().count() == 3 * n


def test_joins_of_patterns_are_dealt_by_their_bytes(spark, tmp_path, monkeypatch):
    """the parts of a join, and of what is made distinct there, grow with the input."""
    from weft.operators import paths as P
    from weft.plans.pattern import match
    from weft.sources.graph import Graph

    spark.range(40000).select((F.col("id") % 10000).alias("k"), F.col("id").alias("v")).write.parquet(f"{tmp_path}/line")
    g = Graph().map_relation("has", spark.read.parquet(f"{tmp_path}/line"), "k", "v")
    monkeypatch.setattr(P, "PART_BYTES", 20000)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = match(g, [("?k", "has", "?a"), ("?k", "has", "?b")], where=F.col("a") < F.col("b"))
        parts = found.select(F.spark_partition_id().alias("at")).groupBy("at").count().collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert len(parts) > 10 and sum(r["count"] for r in parts) == 60000


def test_changes_are_told_in_one_pass(spark):
    """one aggregation tells the changes of the relations that shapes look at."""
    from weft.operators import paths as P
    from weft.operators import shapes
    from weft.operators.revalidate import _changed, asked

    looked = asked(shapes.qualified_min(P.seq("p", P.inverse("q")), shapes.has_value("r", 1), 1))
    assert {"p", "q", "r"} < looked and len(looked) == 4
    before = spark.createDataFrame([("a", "p", "b")] * 2 + [("a", "q", "b"), ("a", "other", "b")], "s string, p string, o string")
    found = _changed(before, before.where("p = 'p'").unionByName(before.limit(0)), looked)
    assert [tuple(r) for r in found.collect()] == [("a", "q", "b")] and "Join" not in plan(found)


def test_consequences_take_one_pass(spark, monkeypatch):
    """declarations are followed to their end, so triples are not taken in rounds."""
    from weft.model import Catalog, ClassSpec, Relation
    from weft.operators import rules
    from weft.sources.graph import TYPE, Graph

    monkeypatch.setattr(rules, "settle", lambda df: 1 / 0)
    c = Catalog().add(ClassSpec("Top"), ClassSpec("A", parents=("Top",)), Relation("r0", domain="A"), *[Relation(f"r{i}", subproperty_of=f"r{i - 1}") for i in range(1, 9)])
    frame = lambda *x: spark.createDataFrame(list(x), "s string, p string, o string")
    one = frame(("x", "r8", "y"), ("x", "r8", "y"))
    found = rules.entail(Graph(one), c)
    want = {("x", f"r{i}", "y") for i in range(9)} | {("x", TYPE, "A"), ("x", TYPE, "Top")}
    assert sorted(map(tuple, found.collect())) == sorted(want)
    later = rules.entail_changes(found, one, frame(("x", "r1", "y")), c)
    assert sorted(map(tuple, later.collect())) == sorted(t for t in want if t[1] in ("r0", "r1", TYPE))


def test_types_are_checked_before_other_fields_multiply(spark):
    """rows of a subject whose object has another type are never spread."""
    from weft.model import Catalog, ClassSpec, Field
    from weft.plans.classquery import class_query
    from weft.sources import layout
    from weft.sources.graph import TYPE, Graph

    n = 50
    rows = [("c", TYPE, "Customer")] + [t for k in range(n) for t in ((f"o{k}", TYPE, "Order"), (f"o{k}", "by", "c" if k == 0 else "other"), *[(f"o{k}", r, f"v{i}") for r in ("x", "y") for i in range(20)])]
    c = Catalog().add(ClassSpec("Customer"), ClassSpec("Order", (Field("x", "string", "x"), Field("y", "string", "y"), Field("by", "Customer", "by"))))
    found = class_query(layout.measured(Graph(spark.createDataFrame(rows, "s string, p string, o string"))), c, "Order")
    assert most_rows(found) < 20 * n * 20 and found.count() == 400


def test_documents_are_made_once(spark, tmp_path, monkeypatch):
    """documents before and after changes, checksums and parsing read what was made once."""
    from weft import ontology_queries as Q

    made = []
    value = '{"@graph":[{"@id":"ex:%s","@type":"S231:Block","S231:description":"d"}]}'
    seen = spark.sparkContext.accumulator(0)

    def documents(spark, sf_dir):
        made.append(1)
        text = F.udf(lambda k: (seen.add(1), value % f"Buildings.Controls.OBC.ASHRAE.G36.Orders.O{k}")[1], "string")
        return spark.range(1, 201).repartition(2).select(F.col("id").cast("string").alias("file"), text("id").alias("value"))

    monkeypatch.setattr(Q, "_documents", documents)
    found = Q.incremental_ingest(spark, str(tmp_path))
    assert sorted(r.dotted_path for r in found.collect()) == sorted(f"Orders.O{k}" for k in range(1, 201))
    assert made == [1] and seen.value == 200
