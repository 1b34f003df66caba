"""Queries of the graph engine on the driver's tables, with oracle SQL.

The tables are mapped to a graph, never turned into triples. ``lineitem`` has no
key of its own; its rows are edges from orders to parts and suppliers.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import terms
from .model import Between, Catalog, ClassSpec, Field, Relation
from .operators import ingest, naming, shapes, templates
from .operators import paths as P
from .operators.reach import Reach
from .operators.revalidate import revalidate
from .operators.rules import TypeRule, inverse_edges, new_types, sub_relation_edges, symmetric_edges
from .operators.shapes import Shape, validate, violations
from .plans.classquery import class_query, load_many
from .plans.pattern import match
from .sources import layout
from .sources.graph import TYPE, Graph


def catalog() -> Catalog:
    c = Catalog()
    c.add(Relation("hasItem", subproperty_of="involves"), Relation("involves"), Relation("placedBy", domain="Order", range="Customer", inverse_of="placed"))
    f = Field
    c.add(
        ClassSpec("Thing", valid=(("relatedTo", "Thing"),), abstract=True),
        ClassSpec("Region", valid=(("hasNation", "Nation"),)),
        ClassSpec("Nation", (f("region", "Region", "inRegion"),)),
        ClassSpec("Customer"),
        ClassSpec("Supplier"),
        ClassSpec("Part"),
        ClassSpec("CustomerBalance", (f("balance", "double", "hasBalance"),), asserted="Customer"),
        ClassSpec("CustomerNation", (f("nation", "Nation", "hasNation"),), asserted="Customer"),
        ClassSpec("CustomerLoad", (f("nation", "Nation", "hasNation"), f("balance", "double", "hasBalance")), asserted="Customer"),
        ClassSpec("Builder", (f("segment", "string", "hasSegment", value="BUILDING"), f("nation", "long", "hasNation")), asserted="Customer"),
        ClassSpec("BuilderOrder", (f("customer", "Builder", "placedBy"),), asserted="Order"),
        ClassSpec("OrderPair", (f("part", "Part", "hasItem"), f("supplier", "Supplier", "suppliedBy")), asserted="Order"),
        ClassSpec("CheapOrder", (f("kind", None, "hasItemType", exact=("PROMO", "ECONOMY")),), asserted="Order"),
        ClassSpec("EmptyOrder", (f("item", None, "hasItem", exact=()),), asserted="Order"),
        ClassSpec("Document", (f("quality", "long", "hasQuality", optional=True, min=0),)),
        ClassSpec("LocalOrder", (f("customer", "Customer", "placedBy"), f("supplier", "Supplier", "suppliedBy")), asserted="Order", between=(Between("customer", "sameNation", "supplier"),)),
        ClassSpec("Order", (f("customer", "Customer", "placedBy"), f("total", "double", "hasTotal")), parents=("Thing",), valid=(("placedBy", "Customer"), ("hasItem", "Part"))),
        ClassSpec("Urgent", (f("priority", "string", "hasPriority", value="1-URGENT"),), parents=("Order",), asserted="Order"),
    )
    return c


def graph(spark, sf_dir: str) -> Graph:
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    customer, supplier, orders, lineitem, part = (t(n) for n in ("customer", "supplier", "orders", "lineitem", "part"))
    g = Graph()
    g.map_table("Region", t("region"), "r_regionkey", regionName="r_name")
    g.map_table("Nation", t("nation"), "n_nationkey", inRegion="n_regionkey", nationName="n_name")
    g.map_table("Customer", customer, "c_custkey", hasNation="c_nationkey", hasBalance="c_acctbal", hasSegment="c_mktsegment")
    g.map_table("Supplier", supplier, "s_suppkey", supplierNation="s_nationkey")
    g.map_table("Part", part, "p_partkey", hasType="p_type", hasBrand="p_brand", hasSize="p_size", hasPrice="p_retailprice")
    g.map_table("Order", orders, "o_orderkey", placedBy="o_custkey", hasTotal="o_totalprice", hasPriority="o_orderpriority", hasStatus="o_orderstatus")
    g.map_relation("hasItem", lineitem, "l_orderkey", "l_partkey")
    g.map_relation("suppliedBy", lineitem, "l_orderkey", "l_suppkey")
    g.map_relation("hasReturnFlag", lineitem, "l_orderkey", "l_returnflag")
    g.map_table("Event", t("events"), "event_id", byUser="user_id", hasEventType="event_type")
    g.map_relation("userDid", t("events"), "user_id", "event_type")
    g.map_type("Document", t("documents"), "doc_id")
    g.map_relation("hasQuality", t("labels"), "doc_id", "quality")
    g.map_relation("hasToxic", t("labels"), "doc_id", "toxic")
    return g


def _item_types(g: Graph) -> Graph:
    """Order to type of its parts, as a relation of its own."""
    types = P.pairs(g, P.seq("hasItem", "hasType"))
    return g.map_relation("hasItemType", types, "s", "o")


def _same_nation(g: Graph) -> Graph:
    return g.map_path("sameNation", P.seq("hasNation", P.inverse("supplierNation")))


def _turns(spark, sf_dir: str):
    """(conv_id, s, o): a turn and the next one of its conversation."""
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn")
    return t.select("conv_id", F.col("turn").alias("s"), (F.col("turn") + 1).alias("o")).join(t.select("conv_id", F.col("turn").alias("o")), ["conv_id", "o"], "left_semi").select("conv_id", "s", "o")


def flagship(spark, sf_dir: str):
    """Customers with their nation (an object of its own) and balance."""
    return class_query(graph(spark, sf_dir), catalog(), "CustomerLoad")


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


def _cls(name: str, oracle: str, class_name: str, extend=None, **options):
    def run(spark, sf_dir):
        g = graph(spark, sf_dir)
        return class_query(extend(g) if extend else g, catalog(), class_name, **options)

    run.__name__ = name
    return query(oracle)(run)


# --- class queries ---

_cls("class_scan", "SELECT DISTINCT c_custkey AS name FROM customer", "Customer")
_cls("class_literal_field", "SELECT DISTINCT c_custkey AS name, c_acctbal AS balance FROM customer", "CustomerBalance")
_cls("class_object_field", "SELECT DISTINCT c_custkey AS name, n_nationkey AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey", "CustomerNation")
_cls("fixed_value_field", "SELECT DISTINCT c_custkey AS name, c_nationkey AS nation FROM customer WHERE c_mktsegment = 'BUILDING'", "Builder")
_cls("semantic_type_field", "SELECT DISTINCT o_orderkey AS name, o_custkey AS customer FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'", "BuilderOrder")
_cls("qualified_two_fields", "SELECT DISTINCT a.l_orderkey AS name, a.l_partkey AS part, b.l_suppkey AS supplier FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey", "OrderPair")
_cls("exact_values_any", "SELECT DISTINCT l_orderkey AS name, p_type AS name_exact_values FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type IN ('PROMO', 'ECONOMY')", "CheapOrder", _item_types)
_cls("exact_values_empty", "SELECT o_orderkey AS name FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)", "EmptyOrder")
_cls("exact_values_set", "SELECT l_orderkey AS name FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey HAVING count(DISTINCT p_type) = 2 AND bool_and(p_type IN ('PROMO', 'ECONOMY'))", "CheapOrder", _item_types, match="exact")
_cls("optional_field", "SELECT DISTINCT d.doc_id AS name, l.quality AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id", "Document", optional=True)
_cls("inter_field_relation", "SELECT DISTINCT o_orderkey AS name, o_custkey AS customer, l_suppkey AS supplier FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey = s_nationkey", "LocalOrder", _same_nation)
_cls("inherited_fields", "SELECT DISTINCT o_orderkey AS name, o_custkey AS customer, o_totalprice AS total FROM orders WHERE o_orderpriority = '1-URGENT'", "Urgent")


@query("SELECT 'customers' AS key, c_custkey AS name FROM customer UNION ALL SELECT 'suppliers', s_suppkey FROM supplier")
def multi_class_load(spark, sf_dir):
    return load_many(graph(spark, sf_dir), catalog(), {"customers": "Customer", "suppliers": "Supplier"})


@query("SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def graph_union_set(spark, sf_dir):
    return P.pairs(graph(spark, sf_dir), P.alt("hasNation", "supplierNation")).select(F.col("o").alias("nation")).distinct()


def _customer_triples(spark, sf_dir: str):
    """Customers and their orders' parts as triples, values as text."""
    customer, orders, line = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "orders", "lineitem"))
    row = lambda df, s, p, o: df.select(F.concat(F.lit(s[0]), s[1]).alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o"))
    c, o, i = ("c", "c_custkey"), ("o", "o_orderkey"), ("o", "l_orderkey")
    parts = [
        row(customer, c, TYPE, F.lit("Customer")), row(customer, c, "hasNation", F.col("c_nationkey")), row(customer, c, "hasSegment", F.col("c_mktsegment")), row(customer, c, "hasBalance", F.col("c_acctbal")),
        row(orders, o, TYPE, F.lit("Order")), row(orders, o, "placedBy", F.concat(F.lit("c"), "o_custkey")), row(line, i, "hasItem", F.col("l_partkey")), row(line, i, "suppliedBy", F.col("l_suppkey")),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def _triple_catalog() -> Catalog:
    f = Field
    return Catalog().add(
        ClassSpec("Customer", (f("nation", "string", "hasNation"), f("segment", "string", "hasSegment", value="BUILDING"), f("balance", "string", "hasBalance"))),
        ClassSpec("Order", (f("customer", "Customer", "placedBy"), f("part", "string", "hasItem"), f("supplier", "string", "suppliedBy"))),
    )


@query("SELECT DISTINCT 'c'||c_custkey AS name, c_nationkey::VARCHAR AS nation FROM customer WHERE c_mktsegment='BUILDING'")
def property_table(spark, sf_dir):
    """A class over triples: all its fields in one aggregation by subject."""
    g = layout.measured(Graph(_customer_triples(spark, sf_dir)))
    return class_query(g, _triple_catalog(), "Customer", fields=["nation", "segment"])


@query("SELECT DISTINCT 'o'||o_orderkey AS name, 'c'||o_custkey AS customer, a.l_partkey::VARCHAR AS part, b.l_suppkey::VARCHAR AS supplier FROM orders JOIN customer ON o_custkey=c_custkey AND c_mktsegment='BUILDING' JOIN lineitem a ON a.l_orderkey=o_orderkey JOIN lineitem b ON b.l_orderkey=o_orderkey")
def stored_graph(spark, sf_dir):
    """Triples written by relation and subject, read back, and asked for a class."""
    name = f"weft_{uuid.uuid4().hex}"
    return class_query(layout.store(_customer_triples(spark, sf_dir), name), _triple_catalog(), "Order")


@query("SELECT DISTINCT 'o'||o_orderkey AS name, 'c'||o_custkey AS customer, c_nationkey::VARCHAR AS nation FROM orders JOIN customer ON o_custkey=c_custkey AND c_mktsegment='BUILDING' JOIN lineitem ON l_orderkey=o_orderkey WHERE l_partkey=(SELECT min(l_partkey) FROM lineitem)")
def ordered_pattern(spark, sf_dir):
    """Two patterns with a constant each: statistics say that one part has few orders, so
    the joins begin there and not with a fifth of all customers."""
    triples = _customer_triples(spark, sf_dir)
    part = triples.where("p = 'hasItem'").agg(F.min(F.col("o").cast("long"))).first()[0]
    asked = [("?customer", "hasSegment", "BUILDING"), ("?name", "placedBy", "?customer"), ("?customer", "hasNation", "?nation"), ("?name", "hasItem", str(part))]
    return match(layout.measured(Graph(triples)), asked, select=["name", "customer", "nation"])


@query("SELECT p, count(*) AS triples, count(DISTINCT s) AS subjects, max(n) AS most_values FROM (SELECT p, s, count(*) OVER (PARTITION BY p, s) AS n FROM (SELECT DISTINCT 'hasItem' AS p, l_orderkey AS s, l_partkey AS o FROM lineitem UNION SELECT 'suppliedBy', l_orderkey, l_suppkey FROM lineitem UNION SELECT 'placedBy', o_orderkey, o_custkey FROM orders) t) u GROUP BY 1")
def relation_statistics(spark, sf_dir):
    kept = _customer_triples(spark, sf_dir).where(F.col("p").isin("hasItem", "suppliedBy", "placedBy"))
    return layout.statistics_of(kept).select("p", "triples", "subjects", "most_values")


# --- paths and closures ---


@query("WITH RECURSIVE h(c,p) AS (VALUES ('PROMO','Discounted'),('ECONOMY','Discounted'),('Discounted','PartType'),('SMALL','Sized'),('MEDIUM','Sized'),('LARGE','Sized'),('Sized','PartType'),('STANDARD','PartType')), r AS (SELECT c,p FROM h UNION SELECT r.c,h.p FROM r JOIN h ON r.p=h.c) SELECT p AS cls, count(*) AS n FROM part JOIN r ON p_type=r.c GROUP BY p")
def subclass_closure(spark, sf_dir):
    up = [("PROMO", "Discounted"), ("ECONOMY", "Discounted"), ("Discounted", "PartType"), ("SMALL", "Sized"), ("MEDIUM", "Sized"), ("LARGE", "Sized"), ("Sized", "PartType"), ("STANDARD", "PartType")]
    above = P.closure(spark.createDataFrame(up, "s string, o string"))
    typed = graph(spark, sf_dir).edges("hasType").select(F.col("s").alias("part"), F.col("o").alias("s"))
    return typed.join(above, "s").groupBy(F.col("o").alias("cls")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT c_custkey AS name, n_regionkey AS region FROM customer JOIN nation ON c_nationkey = n_nationkey")
def path_sequence(spark, sf_dir):
    return P.pairs(graph(spark, sf_dir), P.seq("hasNation", "inRegion")).select(F.col("s").alias("name"), F.col("o").alias("region"))


@query("SELECT DISTINCT n_regionkey AS name, n_nationkey AS nation FROM nation")
def path_inverse(spark, sf_dir):
    return P.pairs(graph(spark, sf_dir), P.inverse("inRegion")).select(F.col("s").alias("name"), F.col("o").alias("nation"))


@query("WITH RECURSIVE e AS (SELECT a.conv_id, a.turn AS s, b.turn AS o FROM conversations a JOIN conversations b ON a.conv_id=b.conv_id AND b.turn=a.turn+1), r AS (SELECT conv_id,s,o FROM e UNION SELECT r.conv_id,r.s,e.o FROM r JOIN e ON r.conv_id=e.conv_id AND r.o=e.s) SELECT conv_id,s,o FROM r")
def path_plus(spark, sf_dir):
    return P.closure(_turns(spark, sf_dir), within=["conv_id"])


@query("SELECT DISTINCT a.conv_id, a.turn AS s, b.turn AS o FROM conversations a JOIN conversations b ON a.conv_id=b.conv_id AND b.turn>=a.turn")
def path_star(spark, sf_dir):
    own = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", F.col("turn").alias("s"), F.col("turn").alias("o"))
    return path_plus(spark, sf_dir).unionByName(own).distinct()


def _talk(spark, sf_dir: str) -> Graph:
    """Turns as nodes: what follows a turn, its role, its conversation."""
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role")
    node = lambda turn: F.concat(F.col("conv_id").cast("string"), F.lit("/"), turn.cast("string"))
    turns = t.withColumn("node", node(F.col("turn")))
    follows = _turns(spark, sf_dir).select(node(F.col("s")).alias("s"), node(F.col("o")).alias("o"))
    return Graph().map_relation("hasRole", turns, "node", "role").map_relation("follows", follows, "s", "o")


_TURN = "c.conv_id||'/'||c.turn"
_FOLLOWS = "SELECT a.conv_id||'/'||a.turn AS s, b.conv_id||'/'||b.turn AS o FROM conversations a JOIN conversations b ON a.conv_id=b.conv_id AND b.turn=a.turn+1"


@query(f"WITH RECURSIVE e AS ({_FOLLOWS}), r AS (SELECT {_TURN} AS s, {_TURN} AS o FROM conversations c WHERE role='system' UNION SELECT r.s,e.o FROM r JOIN e ON r.o=e.s) SELECT DISTINCT s AS name, o AS later FROM r")
def path_from_bound(spark, sf_dir):
    """``*`` from what another pattern has bound: only turns after those are walked."""
    return match(_talk(spark, sf_dir), [("?name", "hasRole", "system"), ("?name", P.star("follows"), "?later")], select=["name", "later"])


@query(f"WITH RECURSIVE e AS ({_FOLLOWS}), f AS (SELECT min(o) AS x FROM e), r AS (SELECT e.s FROM e, f WHERE e.o=f.x UNION SELECT e.s FROM r JOIN e ON e.o=r.s) SELECT DISTINCT r.s AS name, x AS later FROM r, f")
def path_to_constant(spark, sf_dir):
    """``+`` to a constant object is walked backwards from it."""
    g = _talk(spark, sf_dir)
    last = g.edges("follows").agg(F.min("o")).first()[0] or ""
    return match(g, [("?name", P.plus("follows"), last)]).select("name", F.lit(last).alias("later"))


@query("SELECT DISTINCT a.conv_id||'/'||a.turn AS s, b.conv_id||'/'||b.turn AS o FROM conversations a JOIN conversations b ON a.conv_id=b.conv_id AND b.turn>a.turn")
def path_plus_labels(spark, sf_dir):
    """``+`` by labels of chains in place of all pairs joined round by round."""
    return Reach.of(_talk(spark, sf_dir).edges("follows")).pairs()


@query("WITH u AS (SELECT DISTINCT o_orderkey, o_custkey FROM orders), k AS (SELECT o_custkey, count(*) AS n FROM u GROUP BY 1) SELECT o_orderkey AS name, n FROM u JOIN k USING (o_custkey)")
def reach_in_rings(spark, sf_dir):
    """Each customer's orders in a ring: how many each one leads to, itself included."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey").distinct()
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = orders.select(F.col("o_orderkey").alias("s"), F.coalesce(F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")), F.first("o_orderkey").over(w)).alias("o"))
    return Reach.of(nxt).pairs().groupBy(F.col("s").alias("name")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT n_nationkey AS name, k AS agent FROM nation JOIN (SELECT c_nationkey AS nk, 'c'||c_custkey AS k FROM customer UNION ALL SELECT s_nationkey, 's'||s_suppkey FROM supplier) t ON nk=n_nationkey")
def path_alternative(spark, sf_dir):
    g = graph(spark, sf_dir)
    for relation, source, mark in (("customerOf", "hasNation", "c"), ("supplierOf", "supplierNation", "s")):
        g.map_relation(relation, g.edges(source).select(F.concat(F.lit(mark), "s").alias("agent"), "o"), "agent", "o")
    agents = P.pairs(g, P.inverse(P.alt("customerOf", "supplierOf"))).select(F.col("s").alias("name"), F.col("o").alias("agent"))
    return agents.join(g.instances("Nation"), "name", "left_semi")


# --- patterns ---


@query("SELECT DISTINCT a.l_orderkey AS name, a.l_suppkey AS s1, b.l_suppkey AS s2 FROM lineitem a JOIN lineitem b ON a.l_orderkey=b.l_orderkey AND a.l_suppkey<>b.l_suppkey JOIN supplier x ON x.s_suppkey=a.l_suppkey JOIN supplier y ON y.s_suppkey=b.l_suppkey WHERE x.s_nationkey<>y.s_nationkey")
def theta_self_join(spark, sf_dir):
    return match(graph(spark, sf_dir), [("?name", "suppliedBy", "?s1"), ("?name", "suppliedBy", "?s2"), ("?s1", "supplierNation", "?n1"), ("?s2", "supplierNation", "?n2")], where=(F.col("s1") != F.col("s2")) & (F.col("n1") != F.col("n2")), select=["name", "s1", "s2"])


@query("SELECT DISTINCT o_orderkey AS name, o_custkey AS customer FROM orders JOIN customer ON o_custkey=c_custkey WHERE NOT EXISTS (SELECT 1 FROM lineitem JOIN supplier ON l_suppkey=s_suppkey WHERE l_orderkey=o_orderkey AND s_nationkey=c_nationkey)")
def not_exists_correlated(spark, sf_dir):
    return match(graph(spark, sf_dir), [("?name", "placedBy", "?customer"), ("?customer", "hasNation", "?nation")], absent=[[("?name", "suppliedBy", "?s"), ("?s", "supplierNation", "?nation")]], select=["name", "customer"])


@query("SELECT c_custkey AS name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_orderpriority='1-URGENT') AND NOT EXISTS (SELECT 1 FROM events WHERE user_id=c_custkey AND event_type='error')")
def not_exists_chain(spark, sf_dir):
    return match(graph(spark, sf_dir), [("?name", "a", "Customer")], absent=[[("?o", "placedBy", "?name"), ("?o", "hasPriority", "1-URGENT")], [("?name", "userDid", "error")]])


@query("SELECT DISTINCT c_custkey AS name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_totalprice>400000) OR EXISTS (SELECT 1 FROM events WHERE user_id=c_custkey AND event_type='purchase')")
def union_in_group(spark, sf_dir):
    large = ([("?o", "placedBy", "?name"), ("?o", "hasTotal", "?t")], F.col("t") > 400000)
    return match(graph(spark, sf_dir), [("?name", "a", "Customer")], present=[[large, [("?name", "userDid", "purchase")]]])


@query("SELECT DISTINCT c_custkey AS name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_orderstatus='P') AND EXISTS (SELECT 1 FROM events WHERE user_id=c_custkey AND event_type='signup')")
def coexistence(spark, sf_dir):
    return match(graph(spark, sf_dir), [("?name", "a", "Customer")], present=[[[("?o", "placedBy", "?name"), ("?o", "hasStatus", "P")]], [[("?name", "userDid", "signup")]]])


@query("SELECT count(*)>0 AS answer FROM customer WHERE c_acctbal<0")
def ask(spark, sf_dir):
    return shapes.ask(match(graph(spark, sf_dir), [("?name", "hasBalance", "?b")], where=F.col("b") < 0))


# --- constraints ---


def _check(name: str, oracle: str, target: str, constraint, columns=("focus",), extend=None):
    def run(spark, sf_dir):
        g = graph(spark, sf_dir)
        g = extend(g) if extend else g
        return violations(g, shapes.focus_of(g, target), constraint).select(*columns).distinct()

    run.__name__ = name
    return query(oracle)(run)


_discount = shapes.has_value("hasType", "PROMO")
_small = shapes.values_are("hasSize", lambda v: v <= 10)
_check("shacl_min_count", "SELECT o_orderkey AS focus, count(l_orderkey) AS n FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey,l_partkey FROM lineitem) l ON o_orderkey=l_orderkey GROUP BY o_orderkey HAVING count(l_orderkey)<2", "Order", shapes.min_count("hasItem", 2), ("focus", "n"))
_check("shacl_max_count", "SELECT l_orderkey AS focus, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_partkey)>6", "Order", shapes.max_count("hasItem", 6), ("focus", "n"))
_check("shacl_forbidden", "SELECT DISTINCT d.doc_id AS focus, toxic AS value FROM documents d JOIN labels l ON d.doc_id=l.doc_id WHERE toxic=1", "Document", shapes.forbidden("isToxic"), ("focus", "value"), lambda g: g.map_relation("isToxic", g.relations["hasToxic"][0].table.where("toxic = 1"), "doc_id", "toxic"))
_check("shacl_class", "SELECT DISTINCT o_orderkey AS focus, o_custkey AS value FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal>0)", "Order", shapes.of_class("placedBy", "Solvent"), ("focus", "value"), lambda g: g.map_type("Solvent", g.types["Customer"].table.where("c_acctbal > 0"), "c_custkey"))
_check("shacl_datatype", "SELECT p_partkey AS focus, CASE WHEN p_size<=9 THEN p_brand ELSE p_size::VARCHAR END AS value FROM part WHERE p_size<=9", "Part", shapes.datatype("hasCode", "int"), ("focus", "value"), lambda g: g.map_relation("hasCode", g.types["Part"].table.withColumn("code", F.when(F.col("p_size") <= 9, F.col("p_brand")).otherwise(F.col("p_size").cast("string"))), "p_partkey", "code"))
_check("shacl_has_value", "SELECT o_orderkey AS focus FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey=o_orderkey AND l_returnflag='R')", "Order", shapes.has_value("hasReturnFlag", "R"))
_check("shacl_in", "SELECT event_id AS focus, event_type AS value FROM events WHERE event_type NOT IN ('view','click','purchase')", "Event", shapes.is_in("hasEventType", "view", "click", "purchase"), ("focus", "value"))
_check("shacl_not", "SELECT o_orderkey AS focus FROM orders WHERE o_orderstatus='F' AND o_orderpriority='5-LOW'", "Order", shapes.not_(shapes.and_(shapes.has_value("hasStatus", "F"), shapes.has_value("hasPriority", "5-LOW"))))
_check("shacl_or", "SELECT p_partkey AS focus FROM part WHERE NOT (p_type='PROMO' OR p_size<=10)", "Part", shapes.or_(_discount, _small))
_check("shacl_xone", "SELECT p_partkey AS focus FROM part WHERE (p_type='PROMO')=(p_size<=10)", "Part", shapes.xone(_discount, _small))
_check("shacl_qualified_min", "SELECT o_orderkey AS focus, count(DISTINCT CASE WHEN p_type='PROMO' THEN p_partkey END) AS n FROM orders LEFT JOIN lineitem ON o_orderkey=l_orderkey LEFT JOIN part ON l_partkey=p_partkey GROUP BY 1 HAVING count(DISTINCT CASE WHEN p_type='PROMO' THEN p_partkey END)<1", "Order", shapes.qualified_min("hasItem", _discount, 1), ("focus", "n"))
_check("shacl_qualified_max", "SELECT l_orderkey AS focus, count(DISTINCT p_partkey) AS n FROM lineitem JOIN part ON l_partkey=p_partkey WHERE p_type='SMALL' GROUP BY 1 HAVING count(DISTINCT p_partkey)>1", "Order", shapes.qualified_max("hasItem", shapes.has_value("hasType", "SMALL"), 1), ("focus", "n"))
_check("shacl_inverse_min", "SELECT c_custkey AS focus, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey=c_custkey GROUP BY 1 HAVING count(o_orderkey)<5", "Customer", shapes.min_count(P.inverse("placedBy"), 5), ("focus", "n"))
_check("shacl_nested_node", "SELECT DISTINCT o_orderkey AS focus, o_custkey AS value FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey WHERE r_name<>'ASIA'", "Order", shapes.node("placedBy", shapes.has_value(P.seq("hasNation", "inRegion", "regionName"), "ASIA")), ("focus", "value"))


@query("SELECT severity, constraint_id, count(*) AS n FROM (SELECT 'Violation' AS severity,'minCount' AS constraint_id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey=o_orderkey) UNION ALL SELECT 'Warning','in' FROM events WHERE event_type NOT IN ('view','click') UNION ALL SELECT 'Info','maxCount' FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey)>6)) GROUP BY 1,2")
def validation_report(spark, sf_dir):
    report = validate(graph(spark, sf_dir), [
        Shape("OrderShape", "Order", (shapes.min_count("hasItem", 1), shapes.max_count("hasItem", 6, severity="Info"))),
        Shape("EventShape", "Event", (shapes.is_in("hasEventType", "view", "click", severity="Warning"),)),
    ])
    return report.groupBy("severity", "constraint_id").agg(F.count("*").alias("n"))


_AFTER = "WITH it AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_orderkey%100<>0), seg AS (SELECT c_custkey AS c, CASE WHEN c_custkey%50=0 THEN 'NONE' ELSE c_mktsegment END AS m FROM customer)"


@query(f"{_AFTER} SELECT 'o'||o_orderkey AS focus, 'minCount' AS constraint_id, 0 AS n FROM orders WHERE o_orderkey NOT IN (SELECT k FROM it) UNION ALL SELECT 'o'||o_orderkey, 'maxCount', 2 FROM orders WHERE o_orderkey%97=0 UNION ALL SELECT 'o'||o_orderkey, 'qualifiedMinCount', 0 FROM orders WHERE o_custkey NOT IN (SELECT c FROM seg WHERE m='BUILDING')")
def incremental_validation(spark, sf_dir):
    """A report brought up to date: some orders lost their items, some got a second
    customer, some customers changed their segment. Only what that reaches is checked."""
    before = _customer_triples(spark, sf_dir)
    number = F.substring("s", 2, 20).try_cast("long")
    moved = (F.col("p") == "hasSegment") & (number % 50 == 0)
    after = before.where(~((F.col("p") == "hasItem") & (number % 100 == 0))).withColumn("o", F.when(moved, "NONE").otherwise(F.col("o")))
    after = after.unionByName(before.where((F.col("p") == TYPE) & (F.col("o") == "Order") & (number % 97 == 0)).select("s", F.lit("placedBy").alias("p"), F.lit("c0").alias("o")))
    order = Shape("OrderShape", "Order", (shapes.min_count("hasItem", 1), shapes.max_count("placedBy", 1), shapes.qualified_min("placedBy", shapes.has_value("hasSegment", "BUILDING"), 1)))
    return revalidate(before, after, [order], validate(Graph(before), [order])).select("focus", "constraint_id", "n")


# --- rules ---


@query("SELECT c_custkey AS name, 'VipCustomer' AS inferred FROM customer WHERE (SELECT count(*) FROM orders WHERE o_custkey=c_custkey AND o_totalprice>300000)>=2")
def type_inference(spark, sf_dir):
    large = shapes.values_are("hasTotal", lambda v: v > 300000)
    return new_types(graph(spark, sf_dir), [TypeRule("Customer", "VipCustomer", shapes.qualified_min(P.inverse("placedBy"), large, 2))])


@query("SELECT o_custkey AS s, o_orderkey AS o FROM orders")
def inverse_inference(spark, sf_dir):
    return inverse_edges(graph(spark, sf_dir), "placedBy")


@query("SELECT a.n_nationkey AS s, b.n_nationkey AS o FROM nation a JOIN nation b ON a.n_regionkey=b.n_regionkey AND a.n_nationkey<>b.n_nationkey")
def symmetric_inference(spark, sf_dir):
    one_way = match(graph(spark, sf_dir), [("?s", "inRegion", "?r"), ("?o", "inRegion", "?r")], where=F.col("s") < F.col("o"), select=["s", "o"])
    return symmetric_edges(one_way)


@query("SELECT DISTINCT l_orderkey AS s, l_partkey AS o FROM lineitem")
def subproperty_inference(spark, sf_dir):
    return sub_relation_edges(graph(spark, sf_dir), catalog(), "involves")


# --- templates ---


def _customer_values(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("c"), "c_custkey").alias("name"), F.concat(F.lit("n"), "c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))


@query("SELECT 'c'||c_custkey AS s, p, o FROM (SELECT c_custkey,'type' AS p,'Customer' AS o FROM customer UNION ALL SELECT c_custkey,'hasNation','n'||c_nationkey FROM customer UNION ALL SELECT c_custkey,'hasSegment',c_mktsegment FROM customer) t")
def template_expand(spark, sf_dir):
    c = Catalog().add(ClassSpec("Customer", (Field("nation", "Nation", "hasNation"), Field("segment", "string", "hasSegment"))))
    t = templates.expand(_customer_values(spark, sf_dir), c, "Customer")
    return t.withColumn("p", F.when(terms.local_name("p") == "type", "type").otherwise(F.col("p")))


@query("SELECT count(*) AS n, round(sum(c_acctbal),2) AS total, round(avg(c_acctbal),4) AS mean, count(*) FILTER (WHERE c_acctbal<0) AS negative FROM customer")
def round_trip_total(spark, sf_dir):
    c = Catalog().add(ClassSpec("Customer", (Field("balance", "double", "hasBalance"),)))
    back = _round_trip(spark, sf_dir, c)
    b = F.col("balance").cast("double")
    return back.agg(F.count("*").alias("n"), F.round(F.sum(b), 2).alias("total"), F.round(F.avg(b), 4).alias("mean"), F.count_if(b < 0).alias("negative"))


def _round_trip(spark, sf_dir, c):
    """Rows to triples by the template, and back by the class query."""
    return class_query(Graph(templates.expand(_customer_values(spark, sf_dir), c, "Customer")), c, "Customer")


# --- catalogue ---


@query("WITH RECURSIVE e AS (SELECT DISTINCT o_orderpriority AS s, c_mktsegment AS o FROM orders JOIN customer ON o_custkey=c_custkey UNION SELECT DISTINCT c_mktsegment, n_name FROM customer JOIN nation ON c_nationkey=n_nationkey UNION SELECT n_name, r_name FROM nation JOIN region ON n_regionkey=r_regionkey UNION SELECT r_name, n_name FROM nation JOIN region ON n_regionkey=r_regionkey WHERE n_nationkey%5=0), r AS (SELECT '1-URGENT' AS c UNION SELECT e.o FROM r JOIN e ON e.s=r.c) SELECT c FROM r")
def related_classes(spark, sf_dir):
    """What one class leads to over all relations between classes, cycles included."""
    g = graph(spark, sf_dir)
    edges = P.pairs(g, P.seq(P.inverse("hasPriority"), "placedBy", "hasSegment")).unionByName(P.pairs(g, P.seq(P.inverse("hasSegment"), "hasNation", "nationName")))
    up = P.pairs(g, P.seq(P.inverse("nationName"), "inRegion", "regionName"))
    some = match(g, [("?n", "nationName", "?o"), ("?n", "inRegion", "?r"), ("?r", "regionName", "?s")], where=F.col("n") % 5 == 0, select=["s", "o"])
    return P.reachable(edges.unionByName(up).unionByName(some), spark.range(1).select(F.lit("1-URGENT").alias("name"))).select(F.col("name").alias("c"))


# --- naming, numbering, reference resolution ---


@query("SELECT DISTINCT event_type, regexp_replace(lower(regexp_replace('has'||upper(event_type[1])||event_type[2:],'([A-Z])','_\\1','g')),'_+','_','g') AS snake FROM events")
def naming_functions(spark, sf_dir):
    kinds = graph(spark, sf_dir).edges("hasEventType").select(F.col("o").alias("event_type")).distinct()
    return kinds.select("event_type", terms.snake_case(F.concat(F.lit("has"), terms.pascal_case("event_type"))).alias("snake"))


@query("SELECT p_partkey, CASE WHEN k=1 THEN p_name ELSE p_name||'_'||k END AS uname FROM (SELECT p_partkey,p_name,row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part) t")
def make_unique(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name")
    return naming.make_unique(parts, "p_name", ["p_partkey"], alias="uname").select("p_partkey", "uname")


@query("SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text")
def keep_first(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return naming.keep_first(docs, ["text"], ["doc_id"])


@query("SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*)>1")
def duplicate_detection(spark, sf_dir):
    return naming.duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), "text")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, 1")
def category_counter(spark, sf_dir):
    return naming.counter(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type")


@query("SELECT DISTINCT p_brand FROM part WHERE p_brand LIKE 'Brand#1%'")
def distinct_refs(spark, sf_dir):
    return match(graph(spark, sf_dir), [("?p", "hasBrand", "?p_brand")], where=F.col("p_brand").startswith("Brand#1"), select=["p_brand"])


@query("SELECT l_orderkey AS name, string_agg(DISTINCT l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR) AS suppliers FROM lineitem GROUP BY 1")
def list_collection(spark, sf_dir):
    return graph(spark, sf_dir).edges("suppliedBy").groupBy(F.col("s").alias("name")).agg(F.array_join(F.array_sort(F.collect_set(F.col("o").cast("string"))), ",").alias("suppliers"))


@query("SELECT event_id, value, coalesce(u,'UNITLESS') AS unit FROM events LEFT JOIN (VALUES ('purchase','USD'),('view','SEC')) m(t,u) ON event_type=t")
def default_unit(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", "value", terms.with_default_unit(F.lit(None).cast("string"), "event_type", {"purchase": "USD", "view": "SEC"}, "UNITLESS").alias("unit"))


@query("SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events")
def json_value(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", terms.typed_value(F.get_json_object("props", "$.k"))["number"].cast("long").alias("k"))


@query("SELECT d.doc_id, (l.doc_id IS NULL) AS unresolved FROM documents d LEFT JOIN labels l ON d.doc_id=l.doc_id")
def reference_resolution(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return naming.resolve(docs.select("doc_id"), "doc_id", labels, "doc_id")


@query("SELECT c_custkey AS name, CASE WHEN bool_or(o_orderpriority='1-URGENT') THEN 'enumerationkinds' WHEN bool_or(o_orderstatus='P') THEN 'properties' ELSE 'entities' END AS bucket FROM customer LEFT JOIN orders ON o_custkey=c_custkey GROUP BY 1")
def bucket_assignment(spark, sf_dir):
    g = graph(spark, sf_dir)
    marks = match(g, [("?o", "placedBy", "?name"), ("?o", "hasPriority", "?p"), ("?o", "hasStatus", "?s")])
    mark = naming.first_match((F.col("p") == "1-URGENT", "EnumerationKind"), (F.col("s") == "P", "Property"))
    found = marks.select("name", mark.alias("mark")).groupBy("name").agg(F.collect_set("mark").alias("ancestry"))
    return g.instances("Customer").join(found, "name", "left").select("name", ingest.bucket(F.coalesce("ancestry", F.array().cast("array<string>"))).alias("bucket"))


def queries():
    from . import audit_queries, ontology_queries  # noqa: F401  they add theirs

    return dict(QUERIES)


def oracle_sql():
    queries()
    return dict(ORACLES)
