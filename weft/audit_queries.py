"""Audits: graph patterns in the forms that constraint queries of an ontology take.

Each is one ``match`` call. The forms are those of the constraint texts that ontologies
carry: joins with inequality, closures that must or must not lead somewhere, type edges
with a class hierarchy, chains of absent groups, unions, inverse and sequence paths,
variable relations. Texts are not parsed; a pattern is written as Python data.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalogue_queries import graph, query
from .operators import paths as P
from .operators import templates
from .model import Catalog, ClassSpec, Field
from .plans.pattern import match
from .sources.graph import Graph

#: fixed values: the class hierarchy of part types
HIERARCHY = [("PROMO", "Discounted"), ("ECONOMY", "Discounted"), ("Discounted", "PartType"), ("SMALL", "Sized"), ("MEDIUM", "Sized"), ("LARGE", "Sized"), ("Sized", "PartType"), ("STANDARD", "PartType")]
_UP = "(VALUES " + ",".join(f"('{a}','{b}')" for a, b in HIERARCHY) + ")"


def _turn_graph(spark, sf_dir: str) -> Graph:
    """Turns of conversations: the next one, the first one, the role."""
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", (F.col("conv_id") * 1000 + F.col("turn")).alias("k"))
    after = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("k").alias("o"))
    first = t.groupBy("conv_id").agg(F.min("k").alias("o"))
    g = Graph().map_type("Turn", t, "k").map_relation("role", t, "k", "role")
    g.map_relation("next", t.join(after, ["conv_id", "turn"]), "k", "o")
    return g.map_relation("opener", t.join(first, "conv_id"), "k", "o")


_TURNS = "n AS (SELECT conv_id*1000+turn AS k, conv_id, turn, role FROM conversations), e AS (SELECT a.k AS s, b.k AS o FROM n a JOIN n b ON a.conv_id=b.conv_id AND b.turn=a.turn+1), r AS (SELECT s,o FROM e UNION SELECT r.s,e.o FROM r JOIN e ON r.o=e.s)"


def _part_graph(spark, sf_dir: str) -> Graph:
    """Parts typed by their type, under a class hierarchy."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    g = Graph().map_relation("subClassOf", spark.createDataFrame(HIERARCHY, "s string, o string"), "s", "o")
    for kind in ("PROMO", "ECONOMY", "SMALL", "MEDIUM", "LARGE", "STANDARD"):
        g.map_type(kind, part.where(F.col("p_type") == kind), "p_partkey")
    allowed = part.select("p_partkey", F.when(F.col("p_size") <= 25, "Sized").otherwise("PartType").alias("kind"))
    g.map_relation("allows", allowed, "p_partkey", "kind").map_relation("hasType", part, "p_partkey", "p_type")
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_returnflag", "l_quantity")
    return g.map_relation("inReturn", items.where("l_returnflag = 'R' and l_quantity < 10"), "l_partkey", "l_orderkey")


@query("SELECT DISTINCT o_orderkey AS name, c_nationkey AS own, s_nationkey AS other FROM orders JOIN customer ON o_custkey=c_custkey JOIN lineitem ON l_orderkey=o_orderkey JOIN supplier ON l_suppkey=s_suppkey WHERE c_nationkey<>s_nationkey")
def audit_values_differ(spark, sf_dir):
    return match(graph(spark, sf_dir), [("?name", "placedBy", "?c"), ("?c", "hasNation", "?own"), ("?name", "suppliedBy", "?s"), ("?s", "supplierNation", "?other")], where=F.col("own") != F.col("other"), select=["name", "own", "other"])


@query(f"WITH RECURSIVE {_TURNS}, f AS (SELECT k, min(k) OVER (PARTITION BY conv_id) AS first FROM n) SELECT DISTINCT k AS name FROM f WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.s=f.first AND r.o=f.k)")
def audit_no_path(spark, sf_dir):
    return match(_turn_graph(spark, sf_dir), [("?name", "opener", "?first")], absent=[[("?first", P.plus("next"), "?name")]], select=["name"])


@query(f"WITH RECURSIVE {_TURNS} SELECT DISTINCT a.k AS name FROM n a JOIN r ON r.s=a.k JOIN n b ON b.k=r.o WHERE a.role<>b.role")
def audit_differs_along_path(spark, sf_dir):
    return match(_turn_graph(spark, sf_dir), [("?name", P.plus("next"), "?b"), ("?name", "role", "?own"), ("?b", "role", "?other")], where=F.col("own") != F.col("other"), select=["name"])


@query(f"WITH RECURSIVE h(c,p) AS (SELECT * FROM {_UP}), r AS (SELECT c AS s, c AS o FROM h UNION SELECT r.s, h.p FROM r JOIN h ON r.o=h.c) SELECT DISTINCT p_partkey AS name FROM part JOIN r ON p_type=r.s AND r.o='Discounted' WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey=p_partkey AND l_returnflag='R' AND l_quantity<10)")
def audit_class_path(spark, sf_dir):
    """A type edge and the class hierarchy above it, then an absent edge."""
    return match(_part_graph(spark, sf_dir), [("?name", P.seq("a", P.star("subClassOf")), "Discounted")], absent=[[("?name", "inReturn", "?order")]], select=["name"])


@query(f"WITH RECURSIVE h(c,p) AS (SELECT * FROM {_UP}), r AS (SELECT c AS s, c AS o FROM h UNION SELECT r.s, h.p FROM r JOIN h ON r.o=h.c) SELECT DISTINCT p_partkey AS name, p_type AS v FROM part WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.s=p_type AND r.o=CASE WHEN p_size<=25 THEN 'Sized' ELSE 'PartType' END)")
def audit_kind_not_allowed(spark, sf_dir):
    """A value that is not below the kind that its subject allows."""
    return match(_part_graph(spark, sf_dir), [("?name", "hasType", "?v"), ("?name", "allows", "?k")], absent=[[("?v", P.star("subClassOf"), "?k")]], select=["name", "v"])


@query("SELECT DISTINCT a.l_orderkey AS name, a.l_suppkey AS s1, b.l_suppkey AS s2 FROM lineitem a JOIN lineitem b ON a.l_orderkey=b.l_orderkey AND a.l_suppkey<b.l_suppkey JOIN orders ON o_orderkey=a.l_orderkey AND o_orderpriority='2-HIGH' JOIN supplier x ON x.s_suppkey=a.l_suppkey JOIN supplier y ON y.s_suppkey=b.l_suppkey WHERE NOT EXISTS (SELECT 1 FROM nation p JOIN nation q ON p.n_regionkey=q.n_regionkey WHERE p.n_nationkey=x.s_nationkey AND q.n_nationkey=y.s_nationkey)")
def audit_pair_shares_nothing(spark, sf_dir):
    """Two objects of one relation that have no common end of a path."""
    region = P.seq("supplierNation", "inRegion")
    return match(graph(spark, sf_dir), [("?name", "hasPriority", "2-HIGH"), ("?name", "suppliedBy", "?s1"), ("?name", "suppliedBy", "?s2")], where=F.col("s1") < F.col("s2"), absent=[[("?s1", region, "?r"), ("?s2", region, "?r")]], select=["name", "s1", "s2"])


@query("SELECT o_orderkey AS name FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey=o_custkey AND c_mktsegment='BUILDING') AND NOT EXISTS (SELECT 1 FROM lineitem JOIN part ON l_partkey=p_partkey WHERE l_orderkey=o_orderkey AND p_type='PROMO') AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey=o_orderkey AND l_returnflag='R') AND o_orderstatus<>'P' AND o_orderpriority NOT IN ('1-URGENT','5-LOW')")
def audit_dangling(spark, sf_dir):
    """A chain of absent groups around one join."""
    nothing = [[("?name", P.seq("hasItem", "hasType"), "PROMO")], [("?name", "hasReturnFlag", "R")], [("?name", "hasStatus", "P")], [("?name", "hasPriority", "1-URGENT")], [("?name", "hasPriority", "5-LOW")]]
    return match(graph(spark, sf_dir), [("?name", "placedBy", "?c"), ("?c", "hasSegment", "BUILDING")], absent=nothing, select=["name"])


@query("SELECT DISTINCT o.o_orderkey AS name FROM orders o JOIN orders p ON o.o_custkey=p.o_custkey AND p.o_orderpriority='1-URGENT' WHERE o.o_orderpriority<>'1-URGENT' AND NOT EXISTS (SELECT 1 FROM lineitem x JOIN lineitem y ON x.l_suppkey=y.l_suppkey WHERE x.l_orderkey=o.o_orderkey AND y.l_orderkey=p.o_orderkey)")
def audit_leaves_container(spark, sf_dir):
    """Over an inverse step to a sibling that nothing else joins."""
    return match(graph(spark, sf_dir), [("?name", P.seq("placedBy", P.inverse("placedBy")), "?sibling"), ("?sibling", "hasPriority", "1-URGENT"), ("?name", "hasPriority", "?p")], where=F.col("p") != "1-URGENT", absent=[[("?name", "suppliedBy", "?s"), ("?sibling", "suppliedBy", "?s")]], select=["name"])


@query("SELECT n_nationkey AS name FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey=n_nationkey) AND NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey=n_nationkey AND c_acctbal>9800)")
def audit_missing_reverse(spark, sf_dir):
    """A node that is reached one way but not the other."""
    return match(graph(spark, sf_dir), [("?name", "a", "Nation")], present=[[[("?s", "supplierNation", "?name")]]], absent=[([("?c", "hasNation", "?name"), ("?c", "hasBalance", "?b")], F.col("b") > 9800)], select=["name"])


@query("SELECT d.doc_id AS name FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id=d.doc_id AND toxic=0) AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id=d.doc_id AND quality=1)")
def audit_flag_without(spark, sf_dir):
    """One literal is there, the other is not."""
    return match(graph(spark, sf_dir), [("?name", "a", "Document"), ("?name", "hasToxic", 0)], absent=[[("?name", "hasQuality", 1)]])


@query("SELECT DISTINCT o_orderkey AS name FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey AND r_name='ASIA' JOIN lineitem ON l_orderkey=o_orderkey JOIN supplier ON l_suppkey=s_suppkey JOIN nation sn ON s_nationkey=sn.n_nationkey WHERE sn.n_regionkey<>r_regionkey")
def audit_chain(spark, sf_dir):
    """Four steps to a literal, and a second way that ends elsewhere."""
    return match(graph(spark, sf_dir), [("?name", P.seq("placedBy", "hasNation", "inRegion"), "?r"), ("?r", "regionName", "ASIA"), ("?name", P.seq("suppliedBy", "supplierNation", "inRegion"), "?other")], where=F.col("r") != F.col("other"), select=["name"])


@query("SELECT DISTINCT c_custkey AS name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_orderpriority='1-URGENT') OR EXISTS (SELECT 1 FROM supplier WHERE s_nationkey=c_nationkey AND s_acctbal<0)")
def audit_union_of_paths(spark, sf_dir):
    poor = graph(spark, sf_dir)
    poor.map_relation("owes", poor.types["Supplier"].table.where("s_acctbal < 0").withColumn("flag", F.lit("yes")), "s_suppkey", "flag")
    ways = [[("?o", "placedBy", "?name"), ("?o", "hasPriority", "1-URGENT")], [("?name", P.seq("hasNation", P.inverse("supplierNation")), "?s"), ("?s", "owes", "yes")]]
    return match(poor, [("?name", "a", "Customer")], present=[ways], select=["name"])


@query("SELECT name, relation, value FROM (SELECT 'c'||c_custkey AS name, 'hasNation' AS relation, 'n'||c_nationkey AS value, c_mktsegment AS m FROM customer UNION ALL SELECT 'c'||c_custkey, 'hasSegment', c_mktsegment, c_mktsegment FROM customer UNION ALL SELECT 'c'||c_custkey, 'type', 'Customer', c_mktsegment FROM customer) t WHERE m='MACHINERY'")
def audit_any_relation(spark, sf_dir):
    """A variable relation: all that is said of a node."""
    c = Catalog().add(ClassSpec("Customer", (Field("nation", "Nation", "hasNation"), Field("segment", "string", "hasSegment"))))
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("c"), "c_custkey").alias("name"), F.concat(F.lit("n"), "c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    found = match(Graph(templates.expand(rows, c, "Customer")), [("?name", "hasSegment", "MACHINERY"), ("?name", "?relation", "?value")], select=["name", "relation", "value"])
    return found.withColumn("relation", F.regexp_replace("relation", "^.*#", ""))
