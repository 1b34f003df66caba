"""Ingest: ontology triples and control-block documents to catalogue tables."""

from __future__ import annotations

from abc import ABC, abstractmethod
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import terms
from ..sources.graph import TYPE
from .documents import DECLARES, FACT, UNKNOWN, told
from .documents import OWN_TYPES as _OWN_TYPES
from .documents import PORT_TYPES as _PORT_TYPES
from .documents import REFS as _REFS
from .naming import first_match, make_unique
from .paths import closure, reachable, settle, stored

#: fixed values: standard vocabulary
SH = "http://www.w3.org/ns/shacl#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"


class OntologyAdapter(ABC):
    """Extension point: what a source calls a class, a relation, a kind.

    Hooks give Column conditions over one row per subject, whose ``types`` is the
    array of its types and ``ancestry`` the array of its ancestors' local names."""

    namespace: str = ""

    @abstractmethod
    def is_class(self, types: Column) -> Column: ...

    @abstractmethod
    def is_relation(self, types: Column) -> Column: ...

    def is_abstract(self, types: Column) -> Column:
        return F.lit(False)

    def in_scope(self, iri: Column) -> Column:
        return iri.startswith(self.namespace)

    def bucket(self, ancestry: Column) -> Column:
        return bucket(ancestry)


class RuleAdapter(OntologyAdapter):
    """An adapter as settings. A class has all types of ``needs``, one of ``any_of`` and
    none of ``never``; its own id is none of ``meta``. It is abstract if it has a type
    of ``abstract_if``, or has none of ``abstract_unless``."""

    def __init__(self, namespace: str, needs=(), any_of=(RDFS + "Class", OWL + "Class"), never=(), meta=(), relation_types=(OWL + "ObjectProperty",), abstract_if=(), abstract_unless=()) -> None:
        self.namespace, self.needs, self.any_of, self.never, self.meta = namespace, needs, any_of, never, meta
        self.relation_types, self.abstract_if, self.abstract_unless = relation_types, abstract_if, abstract_unless

    @staticmethod
    def _has(types: Column, wanted) -> Column:
        return F.arrays_overlap(types, F.array(*[F.lit(t) for t in wanted])) if wanted else F.lit(False)

    def is_class(self, types: Column) -> Column:
        out = self._has(types, self.any_of) & ~self._has(types, self.never)
        for t in self.needs:
            out = out & F.array_contains(types, t)
        return out

    def in_scope(self, iri: Column) -> Column:
        return iri.startswith(self.namespace) & ~iri.isin(*self.meta) if self.meta else iri.startswith(self.namespace)

    def is_relation(self, types: Column) -> Column:
        return self._has(types, self.relation_types)

    def is_abstract(self, types: Column) -> Column:
        return self._has(types, self.abstract_if) if not self.abstract_unless else ~self._has(types, self.abstract_unless)


def shape_classes(namespace: str, abstract: str, meta=()) -> RuleAdapter:
    """Node shapes that are classes or carry the ontology's own type of abstract ones."""
    return RuleAdapter(namespace, (SH + "NodeShape",), (RDFS + "Class", OWL + "Class", abstract), meta=meta, abstract_if=(abstract,))


def plain_classes(namespace: str) -> RuleAdapter:
    """Classes of any kind, or node shapes; without a shape of its own one is abstract."""
    return RuleAdapter(namespace, (), (OWL + "Class", RDFS + "Class", SH + "NodeShape"), abstract_unless=(SH + "NodeShape",))


def bucket(ancestry: Column) -> Column:
    """enumerationkinds before properties before entities, by ancestor names."""
    return first_match((F.array_contains(ancestry, "EnumerationKind"), "enumerationkinds"), (F.array_contains(ancestry, "Property"), "properties"), (F.lit(True), "entities"))


def subjects(triples: DataFrame) -> DataFrame:
    """(s, types, label, comment): one aggregation, no join per predicate."""
    value = lambda p: F.min(F.when(F.col("p") == p, F.col("o")))
    return triples.where(F.col("p").isin(TYPE, RDFS + "label", RDFS + "comment")).groupBy("s").agg(
        F.collect_set(F.when(F.col("p") == TYPE, F.col("o"))).alias("types"), value(RDFS + "label").alias("label"), value(RDFS + "comment").alias("comment")
    )


def ancestry(triples: DataFrame) -> DataFrame:
    """(s, ancestry): local names of all ancestors, out-of-scope ones included."""
    up = triples.where(F.col("p") == RDFS + "subClassOf").select("s", "o")
    return closure(up).groupBy("s").agg(F.collect_set(terms.local_name(F.col("o"))).alias("ancestry"))


def classes(triples: DataFrame, adapter: OntologyAdapter, base: DataFrame | None = None) -> DataFrame:
    """iri, local_name, py_name, label, comment, is_abstract, bucket, asserted of each
    class. ``base`` are triples of an ontology that is extended: its hierarchy counts for
    buckets, and the nearest ancestor in it is the type that instances carry."""
    s = subjects(triples).where(adapter.in_scope(F.col("s")) & adapter.is_class(F.col("types")))
    every = triples if base is None else triples.unionByName(base, allowMissingColumns=True).distinct()
    s = s.join(ancestry(every), "s", "left")
    if base is None:
        asserted = s.select(F.col("s").alias("iri"), F.col("s").alias("asserted"))
    else:
        asserted = nearest_in(every, s.select(F.col("s").alias("name")), base.where(F.col("p") == TYPE).select(F.col("s").alias("name")).distinct()).select(F.col("name").alias("iri"), "asserted")
    out = s.select(F.col("s").alias("iri"), terms.local_name(F.col("s")).alias("local_name"), terms.class_name_for(F.col("s")).alias("base"), "label", "comment", adapter.is_abstract(F.col("types")).alias("is_abstract"), adapter.bucket(F.coalesce("ancestry", F.array().cast("array<string>"))).alias("bucket"))
    out = out.join(asserted, "iri", "left").withColumn("asserted", F.coalesce("asserted", "iri"))
    return make_unique(out, "base", ["iri"], ["bucket"], "py_name").drop("base")


def nearest_in(triples: DataFrame, names: DataFrame, among: DataFrame) -> DataFrame:
    """(name, asserted): the nearest ancestor of each (name) that is one of ``among``
    (name); of equally near ones the smallest. Ancestors are followed until none is new,
    so chains of any length are, and cycles end."""
    up = triples.where(F.col("p") == RDFS + "subClassOf").select("s", "o").distinct()
    level, found = settle(names.select("name", F.col("name").alias("at"))), None
    seen = level
    while True:
        level = settle(level.join(up, F.col("at") == F.col("s")).select("name", F.col("o").alias("at")).distinct().join(seen, ["name", "at"], "left_anti"))
        if level.isEmpty():
            break
        seen = settle(seen.unionByName(level))
        hit = level.join(among.select(F.col("name").alias("at")), "at", "left_semi").groupBy("name").agg(F.min("at").alias("asserted"))
        found = hit if found is None else found.unionByName(hit)
        level = level.join(hit, "name", "left_anti")
    empty = names.select("name", F.lit(None).cast("string").alias("asserted")).where("asserted is not null")
    return settle(empty if found is None else found)


def relations(triples: DataFrame, adapter: OntologyAdapter) -> DataFrame:
    s = subjects(triples).where(adapter.in_scope(F.col("s")) & adapter.is_relation(F.col("types")))
    inverse = triples.where(F.col("p") == OWL + "inverseOf").groupBy("s").agg(F.min("o").alias("inverse_of"))
    return s.join(inverse, "s", "left").select(F.col("s").alias("iri"), terms.local_name(F.col("s")).alias("local_name"), terms.field_name_for_path(F.col("s")).alias("field_name"), "label", "comment", "inverse_of")


#: fixed values: parts of a property shape that decide its kind
_SHAPE_PARTS = ("path", "class", "datatype", "minCount", "maxCount", "qualifiedValueShape", "qualifiedMinCount", "sparql", "or", "message", "in", "hasValue")


def property_shapes(triples: DataFrame) -> DataFrame:
    """One row per property shape of a class, its parts pivoted to columns."""
    owner = triples.where(F.col("p") == SH + "property").select(F.col("s").alias("owner"), F.col("o").alias("shape"))
    parts = [F.min(F.when(F.col("p") == SH + part, F.col("o"))).alias(part) for part in _SHAPE_PARTS]
    kinds = F.min(F.when(F.col("p") == SH + "path", F.col("o_kind"))).alias("path_kind") if "o_kind" in triples.columns else F.lit("iri").alias("path_kind")
    wide = triples.groupBy("s").agg(*parts, kinds, F.count("*").alias("size")).withColumnRenamed("s", "shape")
    inner = triples.where(F.col("p") == SH + "class").groupBy("s").agg(F.min("o").alias("qualified_class")).withColumnRenamed("s", "qualifiedValueShape")
    return owner.join(wide, "shape").join(inner, "qualifiedValueShape", "left")


def shape_kind(path: Column, path_blank: Column, sparql: Column, or_: Column, max_count: Column, class_: Column, datatype: Column, qualified: Column, qualified_class: Column) -> Column:
    """The kind of a property shape; what is asked first decides."""
    return first_match(
        (path.isNull() | path_blank, "inverse-path"),
        (sparql, "sparql"),
        (or_, "or"),
        (max_count == 0, "forbidden"),
        (class_ | datatype, "plain"),
        (qualified & qualified_class, "qualified"),
        (qualified, "nested-node"),
        (F.lit(True), "other"),
    )


def classify_shapes(triples: DataFrame) -> DataFrame:
    p = property_shapes(triples)
    has = lambda c: F.col(f"`{c}`").isNotNull()
    kind = shape_kind(F.col("path"), F.col("path_kind") == "bnode", has("sparql"), has("or"), F.col("maxCount").try_cast("int"), has("class"), has("datatype"), has("qualifiedValueShape"), has("qualified_class"))
    return p.withColumn("kind", F.coalesce(kind, F.lit("other"))).withColumn("target", F.coalesce("class", "qualified_class"))


def dedicated(shapes: DataFrame) -> DataFrame:
    """``dedicated``: a field of its own (qualified, or at least one value); others
    are valid relations only."""
    least = F.coalesce(F.col("qualifiedMinCount").try_cast("int"), F.col("minCount").try_cast("int"), F.lit(0))
    return shapes.withColumn("dedicated", (F.col("kind") == "qualified") | (least >= 1))


def supplementary(triples: DataFrame, known: tuple[str, ...] = ("class", "node")) -> DataFrame:
    """Distinct (owner, path, note): what a qualified value shape says besides its class."""
    inner = triples.where(F.col("p") == SH + "qualifiedValueShape").select(F.col("s").alias("shape"), F.col("o").alias("value_shape"))
    more = triples.where(F.col("p").startswith(SH) & ~F.col("p").isin(*[SH + k for k in known])).select(F.col("s").alias("value_shape"), terms.local_name(F.col("p")).alias("part"))
    notes = inner.join(more, "value_shape").groupBy("shape").agg(F.array_join(F.array_sort(F.collect_set("part")), ", ").alias("note"))
    return property_shapes(triples).select("owner", "path", "shape").join(notes, "shape").select("owner", "path", "note").distinct()


def attach_constraints(constraints: DataFrame, fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(attached, standalone): constraints (owner, path, ...) that share owner and path
    with a field, with its ``field``; and those that do not."""
    key = fields.select("owner", "path", "field").distinct()
    return constraints.join(key, ["owner", "path"]), constraints.join(key, ["owner", "path"], "left_anti")


def unresolved(shapes: DataFrame, class_iris: DataFrame, relation_iris: DataFrame) -> DataFrame:
    """(owner, path, target, reason) of fields that lead nowhere; none is dropped. Where
    shapes have a ``kind``, only those of fields count: a path or target of another
    kind (inverse, forbidden, ...) need not be a relation or class of its own."""
    if "kind" in shapes.columns:
        shapes = shapes.where(F.col("kind").isin("plain", "qualified"))
    known_r = relation_iris.select(F.col("iri").alias("path")).distinct().withColumn("known_path", F.lit(True))
    known_c = class_iris.select(F.col("iri").alias("target")).distinct().withColumn("known_target", F.lit(True))
    joined = shapes.join(known_r, "path", "left").join(known_c, "target", "left")
    reason = first_match((F.col("path").isNotNull() & F.col("known_path").isNull(), "relation-out-of-scope"), (F.col("target").isNotNull() & F.col("known_target").isNull(), "unresolved-target"))
    return joined.withColumn("reason", reason).where("reason is not null").select("owner", "path", "target", "reason")


def resolve_targets(fields: DataFrame, *sources: tuple[str, DataFrame]) -> DataFrame:
    """``fields`` (target, ...) with ``found_in``: the first of the named (iri) tables that
    has the target, in the given order; null if none has."""
    out, hits = fields, []
    for k, (name, table) in enumerate(sources):
        out = out.join(table.select(F.col("iri").alias("target"), F.lit(name).alias(f"__in{k}")).distinct(), "target", "left")
        hits.append(f"__in{k}")
    return out.withColumn("found_in", F.coalesce(*hits)).drop(*hits)


def bnode_subgraph(triples: DataFrame, roots: DataFrame) -> DataFrame:
    """All triples below the roots (name) that are reached through blank nodes."""
    inner = triples.where(F.col("o_kind") == "bnode").select("s", "o")
    return triples.join(reachable(inner, roots).select(F.col("name").alias("s")), "s", "left_semi")


# --- control blocks (JSON-LD with one @graph array) ---

#: fixed values: keys, types and the root of the block vocabulary
_ID_PREFIX = "ex:"
BLOCK_ROOT = "Buildings.Controls.OBC.ASHRAE.G36."


#: fixed values: keys of a node that the columns of ports and sub-blocks are made of
_PARTS = ("S231:label", "S231:description", "S231:value", "S231:isOfDataType", "qudt:hasQuantityKind", "qudt:hasUnit")
SALTS = 64  # parts that the rows of one key are spread over, where few keys have most rows


def _fields(node: Column, keys) -> Column:
    """A node's keys as texts, by one parse; objects and arrays stay JSON text."""
    return F.from_json(node, ", ".join(f"`{k}` string" for k in keys))


def _text(node: Column, key: str, fields: Column | None = None) -> Column:
    """A key's value as text; of {"@value": v} it is v. ``fields``: the node's, parsed already."""
    inner = F.get_json_object(node, f"$['{key}']['@value']")
    if fields is None:
        return F.coalesce(inner, F.get_json_object(node, f"$['{key}']"))
    value = fields[key]
    return F.when(value.startswith("{"), F.coalesce(inner, value)).otherwise(value)


def _reference(node: Column, key: str, fields: Column) -> Column:
    """The id that a key refers to, {"@id": id}."""
    return F.when(F.substring(fields[key], 1, 1).isin("{", "["), F.get_json_object(node, f"$['{key}']['@id']"))


def _mentions(text: Column, *words: str) -> Column:
    """Whether a JSON text may hold one of the words: cheaper than to parse it. Escaped
    letters may spell any word."""
    out = F.contains(text, F.lit("\\u"))
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def _without(text: Column, prefix: str) -> Column:
    return F.when(text.startswith(prefix), F.substring(text, len(prefix) + 1, 1 << 20)).otherwise(text) if prefix else text


def dotted_path(iri: Column, root: str = BLOCK_ROOT) -> Column:
    """A block's id without the namespace mark and the root that all blocks lie under."""
    return _without(_without(iri, _ID_PREFIX), root)


def _local(node: Column, key: str, prefix: str, fields: Column) -> Column:
    """Local name of a reference {"@id": ...}: after the prefix, or the last # or /."""
    iri = _reference(node, key, fields)
    return F.when(iri.startswith(prefix), _without(iri, prefix)).otherwise(F.substring_index(F.substring_index(iri, "#", -1), "/", -1))


def _label(node: Column, iri: Column, root: str, fields: Column) -> Column:
    """The label, or the last part of the id."""
    return F.coalesce(F.nullif(_text(node, "S231:label", fields), F.lit("")), terms.dotted_parts(dotted_path(iri, root))[1])


def as_array(value: Column) -> Column:
    """A reference key holds one object or an array of them: always the array."""
    return F.from_json(F.when(value.startswith("["), value).otherwise(F.concat(F.lit("["), value, F.lit("]"))), "array<string>")


#: fixed values: all keys that a node is asked for, read when its document is parsed
_NODE = ("@id", "@type", "S231:documentation", *_PARTS, *_REFS.values())


def graph_nodes(documents: DataFrame, mentioning: str | None = None) -> DataFrame:
    """(file, id, types, node, fields) of each node of (file, value) documents; ``fields`` are
    its keys that are asked for, as texts. With ``mentioning`` only of documents whose text may
    hold that word."""
    if mentioning is not None:
        documents = documents.where(_mentions(F.col("value"), mentioning))
    schema = ", ".join(f"`{k}`: string" for k in _NODE)
    nodes = documents.select("file", F.get_json_object("value", "$['@graph']").alias("graph"))
    # a document is parsed as a whole: as texts, and as keys. What is no object has no keys there
    nodes = nodes.select("file", F.from_json("graph", "array<string>").alias("texts"), F.from_json("graph", f"array<struct<{schema}>>").alias("keys"))
    keys = F.when(F.size("keys") == F.size("texts"), F.col("keys"))
    # outer, then filtered: of an inner explode Spark infers a filter that parses each text once more
    nodes = nodes.select("file", F.posexplode_outer(F.arrays_zip(F.col("texts").alias("node"), F.coalesce(keys, F.transform("texts", lambda x: _fields(x, _NODE))).alias("fields"))).alias("at", "n")).where("at is not null")
    nodes = nodes.select("file", F.col("n")["node"].alias("node"), F.coalesce(F.col("n")["fields"], _fields(F.col("n")["node"], _NODE)).alias("fields"))
    type_ = F.col("fields")["@type"]
    types = F.when(type_.startswith("["), F.from_json(type_, "array<string>")).when(type_.isNotNull(), F.array(type_))
    return nodes.select("file", F.col("fields")["@id"].alias("id"), types.alias("types"), "node", "fields")


def _with_fields(nodes: DataFrame) -> DataFrame:
    return nodes if "fields" in nodes.columns else nodes.withColumn("fields", _fields(F.col("node"), _NODE))


def block_references(nodes: DataFrame) -> DataFrame:
    """(file, block, kind, id, unresolved): each reference with the nodes of its file that have
    its id; misses stay. Nodes and references are made in one pass and meet in a window."""
    return _references(nodes, F.col("node"), "string")


def _references(nodes: DataFrame, target: Column, target_type: str, kinds=tuple(_REFS)) -> DataFrame:
    """References of the kinds with what ``target`` makes of each node."""
    null = F.lit(None).cast("string")

    def row(ref_id, block=null, kind=null, position=F.lit(None).cast("int"), ref=null, target=F.lit(None).cast(target_type), types=F.lit(None).cast("array<string>")):
        return F.struct(ref_id.alias("ref_id"), block.alias("block"), kind.alias("kind"), position.alias("position"), ref.alias("ref"), target.alias("target"), types.alias("target_types"))

    def refs(kind, key):
        each = F.transform(as_array(F.col("fields")[key]), lambda x, i: row(F.coalesce(F.get_json_object(x, "$['@id']"), x), F.col("id"), F.lit(kind), i, x))
        return F.when(F.col("fields")[key].isNotNull(), each)

    every = F.array(row(F.col("id"), target=target, types=F.col("types")))
    none = F.filter(every, lambda x: F.lit(False))
    held = reduce(lambda a, b: F.coalesce(a, b), [F.col("fields")[_REFS[k]] for k in kinds])
    # most nodes refer to nothing: they are a row as they are
    every = F.when(held.isNull(), every).otherwise(F.concat(every, *[F.coalesce(refs(k, _REFS[k]), none) for k in kinds]))
    every = _with_fields(nodes).select("file", F.explode(every).alias("r")).select("file", "r.*")
    at = Window.partitionBy("file", "ref_id")
    targets = F.collect_list(F.when(F.col("target").isNotNull(), F.struct("target", "target_types"))).over(at)
    found = every.withColumn("targets", F.when(F.col("ref_id").isNotNull() & F.col("file").isNotNull(), targets)).where("kind is not null")
    found = found.select("file", "ref_id", "block", "kind", "position", "ref", F.explode_outer("targets").alias("found"))
    return found.select("file", "ref_id", "block", "kind", "position", "ref", "found.*").withColumn("unresolved", F.col("target").isNull())


#: fixed values: what is read of a node
_READ = ("label", "description", "value", "declared", "quantitykind", "unit")


def _described(nodes: DataFrame, root: str, kinds=tuple(_REFS), wanted: tuple[str, ...] = _READ) -> DataFrame:
    """References with the columns of ``ports`` and ``sub_blocks``; ``block_type`` is that of
    sub-blocks alone. What is read of a node is made before references meet it; what is not
    wanted is null."""
    t, fields = F.col("node"), F.col("fields")
    of_type = _reference(t, "S231:isOfDataType", fields)
    read = {
        "label": F.nullif(_text(t, "S231:label", fields), F.lit("")), "description": _text(t, "S231:description", fields), "value": _text(t, "S231:value", fields),
        "declared": of_type, "quantitykind": _local(t, "qudt:hasQuantityKind", "q:", fields), "unit": _local(t, "qudt:hasUnit", "unit:", fields),
    }
    read = {n: c if n in wanted else F.lit(None).cast("string") for n, c in read.items()}
    refs = _references(nodes, F.struct(*[c.alias(n) for n, c in read.items()]), f"struct<{','.join(f'{n}:string' for n in read)}>", kinds)
    if "sub_block" in kinds and len(kinds) > 1:
        port = F.bool_or(F.col("kind") != "sub_block").over(Window.partitionBy("file", "ref_id", "block")) & F.col("block").isNotNull()
    else:
        port = F.lit(kinds != ("sub_block",)) & F.col("block").isNotNull()
    return _told(refs.withColumn("is_port", port), root)


def _told(refs: DataFrame, root: str) -> DataFrame:
    """The columns of ``ports`` and ``sub_blocks``, of references that have met their nodes."""
    column = lambda n: F.col("target")[n] if n in refs.schema["target"].dataType.names else F.lit(None).cast("string")
    t, name = {n: column(n) for n in _READ}, terms.dotted_parts(dotted_path(F.col("ref_id"), root))[1]
    own = F.try_element_at("target_types", F.lit(1))
    declared = t["declared"]
    by_type = F.create_map(*[F.lit(x) for pair in _PORT_TYPES.items() for x in pair])
    parameter = F.when(declared.startswith(_OWN_TYPES), _without(declared, _OWN_TYPES)).otherwise(dotted_path(declared, root))
    value_type = F.when(F.col("kind") == "parameter", parameter).otherwise(F.element_at(by_type, own))
    inside = (F.col("kind") == "sub_block") & ~F.col("unresolved") & ~F.col("is_port") & ~own.startswith(_OWN_TYPES)
    return refs.select(
        "file", dotted_path(F.col("block"), root).alias("block"), "kind", "position", "ref_id", "unresolved", F.when(inside, dotted_path(own, root)).alias("block_type"),
        F.coalesce(t["label"], name).alias("name"), F.coalesce(value_type, F.lit(UNKNOWN)).alias("value_type"), t["description"].alias("description"),
        t["quantitykind"].alias("quantitykind"), t["unit"].alias("unit"), terms.typed_value(t["value"]).alias("default"),
    )


PORTS = ("input", "output", "parameter")
_PORT_COLUMNS = ("file", "block", "kind", "position", "name", "value_type", "description", "quantitykind", "unit", "default")


def ports(nodes: DataFrame, root: str = BLOCK_ROOT, kinds: tuple[str, ...] = PORTS) -> DataFrame:
    """block, kind, name, value_type, description, quantitykind, unit, default of every
    reference that has a node. Inputs and outputs have the type that their node's @type
    names, parameters their data type's: a plain one, or the path of an enumeration.
    ``Unknown`` where there is none."""
    return _described(nodes, root, kinds).where("not unresolved").select(*_PORT_COLUMNS)


def sub_blocks(nodes: DataFrame, root: str = BLOCK_ROOT) -> DataFrame:
    """block, name, block_type, description, resolved. What is a port already, a leaf
    value of the vocabulary, or has no type is no sub-block; types that are no block of the
    corpus are kept, unresolved."""
    typed = _described(nodes, root, wanted=("label", "description")).where("block_type is not null").select("file", "block", "position", "name", "block_type", "description")
    return _with_known(typed, _known_types(nodes, root), "block_type", "resolved")


def _known_types(nodes: DataFrame, root: str) -> DataFrame:
    """(block_type) that nodes have and that are blocks of the corpus: one pass, so that of all
    blocks only those are left that a node names as its type."""
    own = F.try_element_at("types", F.lit(1))
    named = F.struct(F.when(~own.startswith(_OWN_TYPES), dotted_path(own, root)).alias("block_type"), F.lit(False).alias("declared"))
    declared = F.struct(F.when(F.array_contains("types", "S231:Block"), dotted_path(F.col("id"), root)).alias("block_type"), F.lit(True).alias("declared"))
    return _both(nodes.select(F.explode(F.array(named, declared)).alias("t")).select("t.*"))


def _both(types: DataFrame) -> DataFrame:
    """(block_type) that are named as well as declared."""
    each = types.where("block_type is not null")
    return each.groupBy("block_type").agg(F.bool_or("declared").alias("is"), F.bool_or(~F.col("declared")).alias("asked")).where("is and asked").select("block_type")


def _with_known(df: DataFrame, known: DataFrame, key: str, column: str) -> DataFrame:
    """``df`` with ``column``: whether ``known`` has the row's key. Rows of a key are spread by
    a salt: types are few, and each of millions of rows."""
    salted = _salted(df)
    return salted.join(_each_salt(known.select(key).distinct()).withColumn("__known", F.lit(True)), [key, "__salt"], "left").withColumn(column, F.col("__known").isNotNull()).drop("__known", "__salt")


def _salted(df: DataFrame) -> DataFrame:
    return df.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(SALTS)).cast("int"))


def _each_salt(known: DataFrame) -> DataFrame:
    return known.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def blocks(nodes: DataFrame, block_type: str = "S231:Block", root: str = BLOCK_ROOT) -> DataFrame:
    own = _with_fields(nodes).where(F.array_contains("types", block_type))
    path = dotted_path(F.col("id"), root)
    text = lambda key: _text(F.col("node"), key, F.col("fields"))
    description = F.coalesce(F.nullif(text("S231:documentation"), F.lit("")), text("S231:description"))
    return own.select("file", path.alias("dotted_path"), terms.class_name_for(terms.dotted_parts(path)[1]).alias("class_name"), description.alias("description"))


def enum_literals(nodes: DataFrame, enum_type: str = "S231:EnumerationType", root: str = BLOCK_ROOT) -> DataFrame:
    """(enum_type, literal, description): nodes of a file whose type is the id of an
    enumeration there; one without literals has a row without one."""
    enums = nodes.where(F.array_contains("types", enum_type)).select(F.col("id").alias("enum_id"), "file")
    members = nodes.select("file", F.col("id").alias("literal_id"), "node", F.explode("types").alias("enum_id"))
    literal = F.coalesce(F.nullif(_text(F.col("node"), "S231:label"), F.lit("")), terms.dotted_parts(F.col("literal_id"))[1])
    return enums.join(members, ["file", "enum_id"], "left").select(dotted_path(F.col("enum_id"), root).alias("enum_type"), literal.alias("literal"), _text(F.col("node"), "S231:description").alias("description"))


def enum_of_default(ports_: DataFrame, enums: DataFrame, root: str = BLOCK_ROOT) -> DataFrame:
    """Parameters of unknown type get the enumeration that their dotted default names, and
    its literal as their default; others stay as they are."""
    prefix, literal = terms.dotted_parts(F.col("default.text"))
    asks = (F.col("kind") == "parameter") & (F.col("value_type") == UNKNOWN) & (F.col("default.kind") == "string")
    known = _each_salt(enums.select(F.col("enum_type").alias("__asked")).distinct()).withColumn("__hit", F.lit(True))
    joined = _salted(ports_).withColumn("__asked", F.when(asks, dotted_path(prefix, root))).join(known, ["__asked", "__salt"], "left")
    hit = F.col("__hit").isNotNull()
    default = F.when(hit, F.struct(F.col("default.kind").alias("kind"), F.col("default.number").alias("number"), literal.alias("text"))).otherwise(F.col("default"))
    return joined.withColumn("default", default).withColumn("value_type", F.when(hit, F.col("__asked")).otherwise(F.col("value_type"))).select(*ports_.columns)


def block_warnings(nodes: DataFrame, root: str = BLOCK_ROOT, enums: DataFrame | None = None) -> DataFrame:
    """(file, message): references to nodes that are not there, files without a block or an
    enumeration, sub-blocks whose type is no block of the corpus, parameters whose type
    stays unknown. ``enums``: the corpus' ``enum_literals``, where they are known already."""
    refs = _described(nodes, root, wanted=_WARNED)
    enums = enum_literals(nodes, root=root) if enums is None else enums
    return _said(refs, _known_types(nodes, root), enums, root).unionByName(_bare(nodes))


_BARE = "no block or enumeration"


def _bare(nodes: DataFrame) -> DataFrame:
    declares = F.arrays_overlap(F.coalesce("types", F.array().cast("array<string>")), F.array(*map(F.lit, DECLARES)))
    return nodes.groupBy("file").agg(F.bool_or(declares).alias("any")).where("not any").select("file", F.lit(_BARE).alias("message"))


#: what is read of a node to say what is wrong with a reference to it
_WARNED = ("label", "value", "declared")


def _said(refs: DataFrame, known: DataFrame, enums: DataFrame, root: str) -> DataFrame:
    """(file, message) of the references with which something is wrong."""
    refs = refs.select("file", "block", "kind", "position", "ref_id", "unresolved", "block_type", "name", "value_type", "default")
    refs = _with_known(refs, known, "block_type", "resolved")
    refs = enum_of_default(refs, enums, root)
    port = F.col("kind") != "sub_block"
    message = (
        F.when(port & F.col("unresolved"), F.concat(F.lit("unresolved "), "kind", F.lit(" reference: "), "ref_id"))
        .when(F.col("block_type").isNotNull() & ~F.col("resolved"), F.concat(F.lit("external block type "), "block_type", F.lit(" of "), "block", F.lit("."), "name"))
        .when(port & ~F.col("unresolved") & (F.col("value_type") == UNKNOWN), F.concat(F.lit("unknown type of "), "kind", F.lit(" "), "block", F.lit("."), "name"))
    )
    found = port & F.col("unresolved") | F.col("block_type").isNotNull() & ~F.col("resolved") | port & (F.col("value_type") == UNKNOWN)
    return refs.where(found).select("file", message.alias("message"))


def document_warnings(documents: DataFrame, root: str = BLOCK_ROOT) -> DataFrame:
    """``block_warnings`` of (file, value) documents, a file each. They are read once: references
    that may be wrong, with the nodes of their document that they lead to, are found where it is
    parsed, without an exchange; what the corpus declares is joined to them. Documents of another
    shape than ``documents.facts`` takes are set aside and go ``block_warnings``' way."""
    bodies = documents.select("file", F.col("value").cast("binary").alias("body"))
    facts = stored(bodies.mapInArrow(told, f"file {documents.schema['file'].dataType.simpleString()}, " + ", ".join(f"{n} {t}" for n, t in FACT.items())))
    of = lambda what: facts.where(F.col("what") == what)
    named = lambda refs: refs.select("block_type", F.lit(False).alias("declared"))
    declaring = lambda nodes, id, types, kind: nodes.where(F.array_contains(types, kind)).select(dotted_path(F.col(id), root).alias("block_type"), F.lit(True).alias("declared"))
    target = F.when(F.col("met"), F.struct(*_WARNED))
    refs = _told(of("ref").withColumn("target", target).withColumn("unresolved", F.col("met").isNull()), root)
    asked, bare = named(refs), of("bare").select("file", F.lit(_BARE).alias("message"))
    types, enums = (declaring(of("type"), "text", "target_types", k) for k in DECLARES)
    rest = of("rest").select("file", F.col("body").cast("string").alias("value"))
    if not rest.isEmpty():
        nodes = graph_nodes(rest)
        more = _described(nodes, root, wanted=_WARNED)
        refs, asked, bare = refs.unionByName(more), asked.unionByName(named(more)), bare.unionByName(_bare(nodes))
        types, enums = (known.unionByName(declaring(nodes, "id", "types", k)) for known, k in zip((types, enums), DECLARES))
    # stored, so that their sizes are known: few types are not worth an exchange of the references
    known, enums = stored(_both(asked.unionByName(types))), stored(enums.select(F.col("block_type").alias("enum_type")).distinct())
    return _said(refs, known, enums, root).unionByName(bare)


def field_helper(kind: Column, value_type: Column, is_enum: Column | None = None) -> Column:
    """The declaration that a port asks for: its value type, then what it is.
    ``is_enum``: whether the type is an enumeration of the corpus."""
    plain = value_type.isin("Real", "Boolean", "Integer")
    enum = F.lit(False) if is_enum is None else (kind == "parameter") & is_enum
    typed = F.when(plain, F.lower(value_type)).when(enum, "enum").otherwise("unknown")
    return F.when(kind == "sub_block", "subblock_field").otherwise(F.concat_ws("_", typed, kind, F.lit("field")))


def block_fields(nodes: DataFrame, root: str = BLOCK_ROOT, enums: DataFrame | None = None, kinds: tuple[str, ...] = PORTS) -> DataFrame:
    """``ports`` of the kinds with recovered enumerations, and the ``helper`` that declares each.
    ``enums``: the corpus' ``enum_literals``, where they are known already."""
    enums = (enum_literals(nodes, root=root) if enums is None else enums).select("enum_type").distinct()
    found = enum_of_default(ports(nodes, root, kinds), enums, root)
    found = _with_known(found, enums.select(F.col("enum_type").alias("value_type")), "value_type", "is_enum")
    return found.withColumn("helper", field_helper(F.col("kind"), F.col("value_type"), F.col("is_enum"))).drop("is_enum")
