"""Names of blank nodes that depend on a graph alone, so that graphs can be compared,
merged and written byte-equal whatever labels they came with.

A node's label is refined by hashes of its neighbourhood until no class of equal labels
divides any more. What neighbours add to a label is a sum, so a node with any number of
triples is pre-aggregated like every other. Ties inside a connected set of blank nodes
are then split: one node of its least tied class is marked and labels are refined again.
Equal sets (two nodes with the same triples, say) are numbered. A node that no other blank
node is linked with keeps its first label: neither rounds nor components concern it.

Rounds are as the longest way between blank nodes. Where nodes are tied by refinement and
yet not symmetric (regular graphs of unlike structure), the marked node may decide the
names: two copies may then come out different; different graphs never come out equal but
for 64-bit clashes of two hashes at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import _node_kind
from .naming import number_rows
from .paths import stored


def _halves(seed: int, *parts: Column) -> list[Column]:
    """A hash as two numbers of 32 bits: 2^31 of them add up to a long."""
    h = F.xxhash64(F.lit(seed), *parts)
    return [h.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(h, 32)]


def _sums(*parts, where: Column | None = None, over=None) -> list[Column]:
    """Two sums of hashes: what is added up in any order."""
    parts = [F.col(c) if isinstance(c, str) else c for c in parts]
    add = lambda h: F.sum(h if where is None else F.when(where, h))
    total = lambda h: add(h) if over is None else add(h).over(over)
    return [F.concat_ws(",", *[total(h) for h in _halves(seed, *parts)]).alias(f"sum{seed}") for seed in (1, 2)]


def _label(*parts: str) -> Column:
    return _digest(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in parts]).alias("label")


def _digest(*parts: Column) -> Column:
    """16 bytes: labels are most of what is shuffled and stored."""
    return F.unhex(_digits(*parts))


def _digits(*parts: Column) -> Column:
    """The digest in lower-case digits."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32)


def _named(*parts: Column) -> Column:
    return F.concat(F.lit("_:c"), _digits(*parts)).alias("name")


def _seen(out: Column, kind, dt, lang) -> Column:
    """What a blank node sees of a triple whose other end is not blank."""
    return F.when(out, F.xxhash64(F.lit("out"), "p", kind, "o", dt, lang)).otherwise(F.xxhash64(F.lit("in"), "p", "s"))


def _refined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label) refined over (node, other, salt) until no class divides."""
    classes = labels.agg(F.count_distinct("label")).first()[0]
    while True:
        seen = links.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(*_sums("salt", "label"))
        labels = stored(labels.join(seen, "node", "left").select("node", _label("label", "sum1", "sum2")))
        now = labels.agg(F.count_distinct("label")).first()[0]
        if now == classes:
            return labels
        classes = now


def _connected(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component): the least node that links lead to, by least neighbours and a jump."""
    found = stored(nodes.select("node", F.col("node").alias("component")))
    while True:
        least = links.join(found.select(F.col("node").alias("other"), F.col("component").alias("near")), "other").groupBy("node").agg(F.min("near").alias("near"))
        near = found.join(least, "node", "left").select("node", "component", F.least("component", "near").alias("near"))
        jump = found.select(F.col("node").alias("near"), F.col("component").alias("far"))
        after = stored(near.join(jump, "near").select("node", F.least("near", "far").alias("component"), (F.least("near", "far") != F.col("component")).alias("moved")))
        found = after.select("node", "component")
        if after.where("moved").isEmpty():
            return found


def _ends(triples: DataFrame) -> tuple[Column, Column]:
    """Whether a triple's subject and object are blank nodes."""
    return _node_kind(F.col("s")) == "bnode", F.coalesce(F.col("o_kind") == "bnode", F.lit(False)) if "o_kind" in triples.columns else F.lit(False)


def blank_names(triples: DataFrame, repeats: bool = True) -> DataFrame:
    """(node, name) of every blank node; the names are the same for every relabelled copy.
    Without ``repeats`` no triple is there twice, so none is looked for."""
    return _names(triples, repeats)[0]


def _names(triples: DataFrame, repeats: bool) -> tuple[DataFrame, bool]:
    """``blank_names``, and whether any triple links two blank nodes."""
    none = F.lit(None).cast("string")
    col = lambda c: F.col(c) if c in triples.columns else none
    kind = F.coalesce(col("o_kind"), F.lit("iri"))
    start, end = _ends(triples)
    rows = triples.select("s", "p", "o", kind.alias("kind"), col("o_dt").alias("dt"), col("o_lang").alias("lang"), start.alias("from"), end.alias("to")).where("from or to")
    rows = rows.distinct() if repeats else rows
    # what a blank node sees that is not blank stays the same in all rounds; a link has none of it
    x = _seen(F.col("from"), "kind", "dt", "lang")
    sees = lambda node, x: F.struct(node.alias("node"), x.alias("x"))
    null, s, o = F.lit(None).cast("long"), F.col("s"), F.col("o")
    seen = rows.select(F.explode(F.when(F.col("from") & F.col("to"), F.array(sees(s, null), sees(o, null))).otherwise(F.array(sees(F.when(F.col("from"), s).otherwise(o), x)))).alias("e")).select("e.*")
    linked = F.bool_or(F.col("x").isNull()).alias("linked")
    sums = _sums("x", where=F.col("x").isNotNull())
    every = stored(seen.groupBy("node").agg(*sums, linked).select("node", _label("sum1", "sum2"), "linked"))
    alone = _alone(every.where("not linked").select("node", "label"))
    labels = every.where("linked").select("node", "label")
    if labels.isEmpty():
        return alone, False
    both = rows.where("from and to")
    links = stored(
        both.select(F.col("s").alias("node"), F.col("o").alias("other"), F.xxhash64(F.lit("out"), "p", F.col("s") == F.col("o")).alias("salt"))
        .unionByName(both.select(F.col("o").alias("node"), F.col("s").alias("other"), F.xxhash64(F.lit("in"), "p", F.col("s") == F.col("o")).alias("salt")))
    )
    labels = _refined(labels, links)
    component = _connected(labels, links)
    while True:
        tied = labels.join(component, "node").groupBy("component", "label").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n > 1")
        marked = stored(tied.groupBy("component").agg(F.min(F.struct("label", "node")).alias("m")).select("m.node", F.lit("marked").alias("mark")))
        if marked.isEmpty():
            break
        labels = _refined(stored(labels.join(marked, "node", "left").select("node", F.when(F.col("mark").isNull(), F.col("label")).otherwise(_digest(F.hex("label"), F.col("mark"))).alias("label"))), links)
    labels = labels.join(component, "node")
    whole = stored(labels.groupBy("component").agg(*_sums("label"), F.count("*").alias("n")).select("component", _label("sum1", "sum2", "n").alias("whole")))
    placed = stored(_placed(whole))
    named = labels.join(placed, "component").select("node", _named(F.hex("whole"), F.hex("label"), F.col("copy").cast("string")))
    return stored(alone.unionByName(named)), True


def _alone(labels: DataFrame) -> DataFrame:
    """(node, name) of nodes without links: only those of one label have to be numbered."""
    shared = stored(labels.groupBy("label").agg(F.count("*").alias("n")).where("n > 1").select("label"))
    if shared.isEmpty():
        return labels.select("node", _named(F.lit("alone"), F.hex("label"), F.lit("0")))
    tied = labels.join(shared, "label", "left_semi")
    copies = stored(_placed(stored(tied.select(F.col("node").alias("component"), F.col("label").alias("whole"))))).select(F.col("component").alias("node"), "copy")
    return labels.join(copies, "node", "left").select("node", _named(F.lit("alone"), F.hex("label"), F.coalesce("copy", F.lit(0)).cast("string")))


def _placed(whole: DataFrame) -> DataFrame:
    """(component, whole, copy): equal components numbered, by ranges and not by a window each."""
    numbered = stored(number_rows(whole, "whole", "component"))
    first = numbered.groupBy("whole").agg(F.min("row").alias("first"))
    return numbered.join(first, "whole").select("component", "whole", (F.col("row") - F.col("first")).alias("copy"))


def canonical(triples: DataFrame, repeats: bool = True, at: tuple[str, str] | None = None) -> DataFrame:
    """The same triples, blank nodes renamed by ``blank_names``. Triples with one blank end, all
    there are without links, meet their names in one join. ``at`` names a column with the one
    blank end of each of distinct triples and one with a hash of it: dealt by that hash, triples
    are named where they lie."""
    if at is not None:
        return _canonical_at(triples, *at)
    names, linked = _names(triples, repeats)
    start, end = _ends(triples)
    own = names.select(F.col("node").alias("__at"), F.col("name").alias("__name"))
    rows = triples.withColumn("__from", F.coalesce(start, F.lit(False))).withColumn("__to", end)
    out = rows.withColumn("__end", F.when(~F.col("__from") & F.col("__to"), F.col("o")).otherwise(F.col("s"))).join(own, (F.col("__from") | F.col("__to")) & (F.col("__end") == F.col("__at")), "left")
    out = out.withColumn("s", F.when(F.col("__from"), F.coalesce("__name", "s")).otherwise(F.col("s"))).withColumn("o", F.when(~F.col("__from") & F.col("__to"), F.coalesce("__name", "o")).otherwise(F.col("o")))
    if linked:
        other = names.select(F.col("node").alias("__o"), F.col("name").alias("__on"))
        out = out.join(other, F.col("__from") & F.col("__to") & (F.col("o") == F.col("__o")), "left").withColumn("o", F.coalesce("__on", "o"))
    return out.select(*triples.columns)


def _canonical_at(triples: DataFrame, at: str, place: str) -> DataFrame:
    """Triples with one blank end each. Only nodes that share a label leave their place."""
    none = F.lit(None).cast("string")
    col = lambda c: F.col(c) if c in triples.columns else none
    start, _ = _ends(triples)
    rows = triples.withColumn("__out", start).withColumn("__x", _seen(F.col("__out"), F.coalesce(col("o_kind"), F.lit("iri")), col("o_dt"), col("o_lang")))
    labels = rows.groupBy(place, F.col(at).alias("node")).agg(*_sums("__x")).select(place, "node", _label("sum1", "sum2"))
    half = F.xxhash64("label").alias("__half")  # of what a label takes; labels are told apart below
    shared = stored(labels.groupBy(half).agg(F.count("*").alias("n")).where("n > 1").select("__half"))
    rows = rows.select("*", *_sums("__x", over=Window.partitionBy(place, at)))
    name = _named(F.lit("alone"), F.upper(_digits(F.col("sum1"), F.col("sum2"))), F.lit("0"))
    if not shared.isEmpty():
        tied = stored(labels.withColumn("__half", half).join(shared, "__half", "left_semi").drop("__half"))
        # joined by the hash alone, as rows are dealt by it and not by the node
        names = stored(_alone(tied.select("node", "label")).join(tied.drop("label"), "node").groupBy(place).agg(F.collect_list(F.struct("node", "name")).alias("__names")))
        rows = rows.join(names, place, "left")
        name = F.coalesce(F.try_element_at(F.filter("__names", lambda x: x["node"] == F.col(at)), F.lit(1))["name"], name)
    end = lambda c, blank: F.when(blank, name).otherwise(F.col(c)).alias(c)
    ends = {"s": end("s", F.col("__out")), "o": end("o", ~F.col("__out"))}
    return rows.select(*[ends.get(c, F.col(c)) for c in triples.columns if c not in (at, place)])


BUCKETS = 256  # of the triples of a relation, whose sums are compared before they are


def shared_triples(one: DataFrame, two: DataFrame) -> DataFrame:
    """(p, n, shared): the triples of each relation of one graph, and how many of them the other
    has as well. Triples are compared one by one in those buckets alone whose two sums of hashes
    differ; equal graphs move sums."""
    both = one.select("s", "p", "o", "o_kind", F.lit(1).alias("here")).unionByName(two.select("s", "p", "o", "o_kind", F.lit(2).alias("here")))
    halves = [h for seed in (1, 2) for h in _halves(seed, F.col("s"), F.col("p"), F.col("o"), F.col("o_kind"))]
    both = both.withColumn("bucket", F.pmod(halves[0], F.lit(BUCKETS)))
    counts = [F.count_if(F.col("here") == k).alias(n) for k, n in ((1, "a"), (2, "b"))]
    sums = [F.sum(F.when(F.col("here") == 1, h).otherwise(-h)).alias(f"d{k}") for k, h in enumerate(halves)]
    even = reduce(lambda x, y: x & y, [F.col(f"d{k}") == 0 for k in range(len(halves))])
    told = stored(both.groupBy("p", "bucket").agg(*counts, *sums).withColumn("same", (F.col("a") == F.col("b")) & even))
    found = told.select("p", F.col("a").alias("n"), F.when(F.col("same"), F.col("a")).otherwise(0).alias("shared"))
    differ = told.where("not same").select("p", "bucket")
    if not differ.isEmpty():
        each = both.join(differ, ["p", "bucket"], "left_semi").groupBy("s", "p", "o", "o_kind").agg(*counts)
        found = found.unionByName(each.groupBy("p").agg(F.lit(0).cast("long").alias("n"), F.sum(F.least("a", "b")).alias("shared")))
    return found.groupBy("p").agg(F.sum("n").alias("n"), F.sum("shared").alias("shared")).where("n > 0")


def graph_difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """(s, p, o, o_kind, change): triples removed and added, blank nodes by their names; empty
    for two copies of one graph."""
    a, b = (stored(canonical(t.select("s", "p", "o", "o_kind")).distinct()) for t in (before, after))
    return a.exceptAll(b).withColumn("change", F.lit("removed")).unionByName(b.exceptAll(a).withColumn("change", F.lit("added")))
