"""Reachability by labels: chains and what each reaches, instead of all pairs.

Strongly connected parts that colouring finds become one node each. The graph is then
covered by chains: every node takes at most one of its edges, every node is taken at most
once, and pointer jumping numbers the chains in as many rounds as the logarithm of the
longest. What leads from chain to chain is an entry (chain, last, to, first): nodes up to
place ``last`` of the one reach the other from place ``first`` on. Entries that another one
implies are dropped, and entries are composed until none is new. A node reaches what comes
later in its chain and what the entries at or after its place name, so ``+`` and ``*`` are
answered by comparing places.

Nothing here needs the graph to be without cycles: a cycle that colouring leaves (a long
ring) is a chain with an entry to itself. A path, and a ring, have one chain and at most one
entry, whatever their length; a hierarchy has a chain for each leaf. The worst case is
an entry for each two chains.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .paths import stored

COLOURING = 4  # steps that a colour travels before parts are merged
MATCHINGS = 3  # times that nodes look for an edge of their own
_ENTRY = ["chain", "last", "to", "first"]


def _coloured(edges: DataFrame, steps: int, source: str, end: str, name: str) -> DataFrame:
    """(node, ``name``): the greatest node that leads to each within ``steps``."""
    nodes = edges.select(F.col("s").alias("node")).union(edges.select("o")).distinct()
    colour = nodes.withColumn(name, F.col("node"))
    for _ in range(steps):
        sent = edges.join(colour, F.col(source) == F.col("node")).select(F.col(end).alias("node"), name)
        colour = stored(colour.unionByName(sent).groupBy("node").agg(F.max(name).alias(name)))
    return colour


def condense(edges: DataFrame, steps: int = COLOURING) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges between nodes, members, cyclic): ``members`` (name, node) names the node that
    stands for each name that was merged; ``cyclic`` (node) those that reach themselves by
    an edge of their own or through what they stand for. A node with the same greatest
    colour both ways lies on a cycle with it; longer cycles stay as they are."""
    own = edges.where("s = o").select(F.col("s").alias("node"))
    edges, members, cyclic = stored(edges.where("s <> o").select("s", "o").distinct()), None, own
    while not edges.isEmpty():
        both = _coloured(edges, steps, "s", "o", "before").join(_coloured(edges, steps, "o", "s", "after"), "node")
        merged = stored(both.where((F.col("before") == F.col("after")) & (F.col("node") != F.col("before"))).select(F.col("node").alias("name"), F.col("before").alias("node")))
        # a node that others merge into stays one; the greatest of a part merges into none
        merged = stored(merged.join(merged.select(F.col("name").alias("node")), "node", "left_anti").select("name", "node"))
        if merged.isEmpty():
            break
        cyclic = _renamed(cyclic, merged, "node").unionByName(merged.select("node"))
        edges = stored(_renamed(_renamed(edges, merged, "s"), merged, "o").where("s <> o").distinct())
        members = merged if members is None else stored(_renamed(members, merged, "node").unionByName(merged))
    if members is None:
        members = own.select(F.col("node").alias("name"), "node").limit(0)
    return edges, members, stored(cyclic.distinct())


def _renamed(df: DataFrame, merged: DataFrame, column: str) -> DataFrame:
    to = merged.select(F.col("name").alias("__old"), F.col("node").alias("__new"))
    return df.join(to, F.col(column) == F.col("__old"), "left").withColumn(column, F.coalesce("__new", column)).drop("__old", "__new")


def _links(edges: DataFrame, rounds: int = MATCHINGS) -> DataFrame:
    """(s, o): edges of which each node begins and ends one at most."""
    chosen, left = None, edges
    for _ in range(rounds):
        wish = left.groupBy("s").agg(F.min("o").alias("o"))
        found = stored(wish.groupBy("o").agg(F.min("s").alias("s")).select("s", "o"))
        if found.isEmpty():
            break
        chosen = found if chosen is None else chosen.unionByName(found)
        left = stored(left.join(found.select("s"), "s", "left_anti").join(found.select("o"), "o", "left_anti"))
    return edges if chosen is None else stored(chosen)


def _numbered(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, chain, pos): the first node of each node's chain, and its place there.
    Rings are cut before their least node.

    Each node looks back over twice as many places each round: ``pos`` of them, up to ``at``, of
    which ``least`` is the least node, ``near`` and ``far`` places back. A node that lies at two
    places is on a ring, and all of that are known to be within two times round it."""
    at = nodes.select("node").join(links.select(F.col("o").alias("node"), F.col("s").alias("at")), "node", "left")
    open_ = F.col("at").isNotNull()
    one = F.when(open_, 1).otherwise(0).cast("long")
    first = F.coalesce("at", "node")
    state = stored(at.select("node", first.alias("at"), one.alias("pos"), first.alias("least"), one.alias("near"), one.alias("far"), open_.alias("open")))
    while not state.where("open").isEmpty():
        far = state.select(F.col("node").alias("at"), *[F.col(c).alias(f"__{c}") for c in ("at", "pos", "least", "near", "far", "open")])
        # one join for all rows: a union would add up partitions round after round
        go = lambda new, old: F.when(F.col("open"), new).otherwise(F.col(old)).alias(old)
        near = F.when(F.col("least") <= F.col("__least"), F.col("near")).otherwise(F.col("pos") + F.col("__near"))
        last = F.when(F.col("__least") <= F.col("least"), F.col("pos") + F.col("__far")).otherwise(F.col("far"))
        state = stored(state.join(far, "at").select("node", go(F.col("__at"), "at"), go(F.col("pos") + F.col("__pos"), "pos"), go(F.least("least", "__least"), "least"), go(near, "near"), go(last, "far"), go(F.col("__open") & (near == last), "open")))
    ring = F.col("near") < F.col("far")
    on_ring = F.when(F.col("node") == F.col("least"), 0).otherwise(F.col("near"))
    return state.select("node", F.when(ring, F.col("least")).otherwise(F.col("at")).alias("chain"), F.when(ring, on_ring).otherwise(F.col("pos")).cast("long").alias("pos"))


def _branches(edges: DataFrame) -> bool:
    """Whether a node begins or ends several edges; of paths and rings none does."""
    both = [edges.groupBy(c).agg(F.count("*").alias("n")).where("n > 1").limit(1).select("n") for c in "so"]
    return not both[0].union(both[1]).isEmpty()


def _front(entries: DataFrame) -> DataFrame:
    """Entries that no other one implies: of two chains, those with an earlier ``first``
    than all with a later ``last``."""
    ahead = Window.partitionBy("chain", "to").orderBy(F.desc("last"), "first").rowsBetween(Window.unboundedPreceding, -1)
    return entries.withColumn("__best", F.min("first").over(ahead)).where("__best is null or first < __best").drop("__best")


def _composed(left: DataFrame, right: DataFrame) -> DataFrame:
    then = right.select(F.col("chain").alias("to"), F.col("last").alias("__last"), F.col("to").alias("__to"), F.col("first").alias("__first"))
    both = left.join(then, "to").where("__last >= first").select("chain", "last", F.col("__to").alias("to"), F.col("__first").alias("first"))
    return both.groupBy("chain", "last", "to").agg(F.min("first").alias("first")).select(*_ENTRY).where(_says_more())


def _says_more() -> Column:
    """A later place of the same chain is reached without an entry."""
    return (F.col("chain") != F.col("to")) | (F.col("first") <= F.col("last"))


@dataclass(frozen=True)
class Reach:
    """``nodes`` (name, chain, pos, cyclic), ``entries`` (chain, last, to, first)."""

    nodes: DataFrame
    entries: DataFrame

    @staticmethod
    def of(edges: DataFrame) -> Reach:
        """Labels of (s, o); rows may repeat. Rows with a null are no edges."""
        edges = stored(edges.select("s", "o").where("s is not null and o is not null").distinct())
        names = edges.select(F.col("s").alias("name")).union(edges.select("o")).distinct()
        if not _branches(edges):
            # paths and rings are chains as they are: nothing is merged, no edge is chosen
            between = edges.where("s <> o")
            place = stored(_numbered(names.select(F.col("name").alias("node")), between))
            own = edges.where("s = o").select(F.col("s").alias("node"), F.lit(True).alias("cyclic"))
            nodes = place.join(own, "node", "left").select(F.col("node").alias("name"), "chain", "pos", F.coalesce("cyclic", F.lit(False)).alias("cyclic"))
        else:
            between, members, cyclic = condense(edges)
            every = names.join(members, "name", "left").select("name", F.coalesce("node", "name").alias("node"))
            every = stored(every.join(cyclic.withColumn("cyclic", F.lit(True)), "node", "left").select("name", "node", F.coalesce("cyclic", F.lit(False)).alias("cyclic")))
            place = _numbered(every.select("node").distinct(), _links(between))
            nodes = stored(every.join(place, "node").select("name", "chain", "pos", "cyclic"))
        s, o = (place.select(*[F.col(c).alias(f"__{side}_{c}") for c in ("node", "chain", "pos")]) for side in "so")
        both = between.join(s, F.col("s") == F.col("__s_node")).join(o, F.col("o") == F.col("__o_node"))
        direct = both.select(F.col("__s_chain").alias("chain"), F.col("__s_pos").alias("last"), F.col("__o_chain").alias("to"), F.col("__o_pos").alias("first"))
        fresh = entries = stored(_front(direct.where(_says_more()).distinct()))
        while not fresh.isEmpty():
            found = _composed(fresh, entries).unionByName(_composed(entries, fresh)).distinct()
            grown = stored(_front(entries.unionByName(found).distinct()))
            fresh, entries = stored(grown.join(entries, _ENTRY, "left_anti").select(*_ENTRY)), grown
        return Reach(nodes, entries)

    def ahead(self, seeds: DataFrame) -> DataFrame:
        """(s, o): what each of (name) reaches by one edge or more."""
        return self._ahead(seeds.select("name").distinct().join(self.nodes, "name"))

    def _ahead(self, own: DataFrame) -> DataFrame:
        later = own.select(F.col("name").alias("s"), F.col("chain").alias("to"), (F.col("pos") + F.when(F.col("cyclic"), 0).otherwise(1)).alias("first"))
        far = own.join(self.entries, "chain").where("last >= pos").select(F.col("name").alias("s"), "to", "first")
        # dealt by the chain that they are joined with next
        spans = later.unionByName(far).repartition("to").groupBy("s", "to").agg(F.min("first").alias("first"))
        return spans.join(self.nodes, F.col("to") == F.col("chain")).where("pos >= first").select("s", F.col("name").alias("o"))

    def behind(self, seeds: DataFrame) -> DataFrame:
        """(s, o): what reaches each of (name)."""
        own = seeds.select("name").distinct().join(self.nodes, "name")
        sooner = own.select(F.col("name").alias("o"), F.col("chain").alias("__chain"), (F.col("pos") - F.when(F.col("cyclic"), 0).otherwise(1)).alias("last"))
        far = own.join(self.entries.withColumnRenamed("chain", "__chain"), F.col("chain") == F.col("to")).where("first <= pos").select(F.col("name").alias("o"), "__chain", "last")
        spans = sooner.unionByName(far).groupBy("o", "__chain").agg(F.max("last").alias("last"))
        return spans.join(self.nodes, F.col("__chain") == F.col("chain")).where("pos <= last").select(F.col("name").alias("s"), "o")

    def pairs(self) -> DataFrame:
        """(s, o) of all that reach each other: as many rows as there are."""
        return self._ahead(self.nodes)

    def holding(self, asked: DataFrame) -> DataFrame:
        """Those of (s, o) that hold; no pair but the asked ones is made."""
        at = lambda side: self.nodes.select(F.col("name").alias(side), F.col("chain").alias(f"__{side}"), F.col("pos").alias(f"__{side}_pos"), F.col("cyclic").alias(f"__{side}_cyclic"))
        both = asked.select("s", "o").distinct().join(at("s"), "s").join(at("o"), "o")
        along = (F.col("__s") == F.col("__o")) & ((F.col("__s_pos") < F.col("__o_pos")) | ((F.col("__s_pos") == F.col("__o_pos")) & F.col("__s_cyclic")))
        across = both.join(self.entries, (F.col("__s") == F.col("chain")) & (F.col("__o") == F.col("to"))).where("last >= __s_pos and first <= __o_pos")
        return both.where(along).select("s", "o").unionByName(across.select("s", "o")).distinct()
