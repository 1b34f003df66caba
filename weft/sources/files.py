"""Readers and writers: N-Triples, Turtle, JSON-LD documents, checksums."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.paths import stored
from .graph import SCHEMA, TYPE

_TERM = r'(<[^>]*>|_:[^\s<"]+|"(?:[^"\\]|\\.)*"(?:\^\^<[^>]*>|@[A-Za-z0-9-]+)?)'


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """Triples of line-based files: splittable, by expressions alone. Blank nodes
    are told apart by file. A line that cannot be read ends the query."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).where(~F.col("value").rlike(r"^\s*(#|$)"))
    part = lambda k: F.regexp_extract("value", rf"^\s*{_TERM}\s*{_TERM}\s*{_TERM}\s*\.\s*(?:#.*)?$", k)

    def plain(term):
        iri = F.regexp_extract(term, "^<(.*)>$", 1)
        text = F.regexp_extract(term, r'^"((?s:.*))"(?:\^\^<[^>]*>|@[A-Za-z0-9-]+)?$', 1)
        text = F.replace(F.replace(F.replace(text, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")), F.lit("\\\\"), F.lit("\\"))
        return F.when(term.startswith("<"), iri).when(term.startswith("_:"), F.concat("file", F.lit("#"), term)).otherwise(text)

    s, p, o = part(1), part(2), part(3)
    kind = F.when(o.startswith("<"), "iri").when(o.startswith("_:"), "bnode").otherwise("literal")
    data_type = F.nullif(F.regexp_extract(o, r'"\^\^<([^>]*)>$', 1), F.lit(""))
    lang = F.nullif(F.regexp_extract(o, r'"@([A-Za-z0-9-]+)$', 1), F.lit(""))
    bad = F.raise_error(F.concat(F.lit("not a triple in "), "file", F.lit(": "), "value")).cast("boolean")
    return lines.where(F.when(p == "", bad).otherwise(True)).select(plain(s).alias("s"), plain(p).alias("p"), plain(o).alias("o"), kind.alias("o_kind"), data_type.alias("o_dt"), lang.alias("o_lang")).distinct()


_TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)|(?P<iri><[^>]*>)|(?P<long>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\")|(?P<text>"(?:[^"\\\n]|\\.)*")"""
    r"""|(?P<lang>@[A-Za-z][A-Za-z0-9-]*)|(?P<type>\^\^)|(?P<mark>[;,\[\]()]|\.(?![0-9]))|(?P<number>[+-]?(?:\d+\.\d+|\.\d+|\d+)(?:[eE][+-]?\d+)?(?![\w:]))"""
    r"""|(?P<name>(?:_:|[\w.-]*:)(?:[\w%~-]|\.(?=[\w%-])|\\.)*|[A-Za-z]+)""",
    re.S,
)
_XSD = "http://www.w3.org/2001/XMLSchema#"
_RDF = TYPE.removesuffix("type")


def parse_turtle(text: str, scope: str = "") -> list[tuple]:
    """Triples of one Turtle document, as rows of the triples schema. A document
    cannot be split, so a file is a task's unit of work."""
    tokens = [(m.lastgroup, m.group()) for m in _TOKEN.finditer(text) if m.lastgroup != "skip"]
    prefixes, base, rows, at, blanks = {}, "", [], 0, 0

    def take(expected: str | None = None) -> tuple[str, str]:
        nonlocal at
        kind, word = tokens[at]
        if expected and word != expected:
            raise ValueError(f"{scope}: expected {expected}, found {word}")
        at += 1
        return kind, word

    def blank() -> tuple:
        nonlocal blanks
        blanks += 1
        return f"{scope}#_:{blanks}", "bnode", None, None

    def unescape(word: str) -> str:
        return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]) if len(m[1]) == 1 else chr(int(m[1][1:], 16)), word)

    def term() -> tuple:
        kind, word = take()
        if kind == "iri":
            return (word[1:-1] if ":" in word else base + word[1:-1]), "iri", None, None
        if word == "[":
            own = blank()
            if tokens[at][1] != "]":
                predicates(own[0])
            take("]")
            return own
        if word == "(":
            items = []
            while tokens[at][1] != ")":
                items.append(term())
            take(")")
            node = (_RDF + "nil", "iri", None, None)
            for item in reversed(items):
                cell = blank()
                rows.append((cell[0], _RDF + "first", *item))
                rows.append((cell[0], _RDF + "rest", *node))
                node = cell
            return node
        if kind in ("text", "long"):
            value, data_type, lang = unescape(word[3:-3] if kind == "long" else word[1:-1]), None, None
            if at < len(tokens) and tokens[at][0] == "type":
                take()
                data_type = term()[0]
            elif at < len(tokens) and tokens[at][0] == "lang":
                lang = take()[1][1:]
            return value, "literal", data_type or (None if lang else _XSD + "string"), lang
        if kind == "number":
            return word, "literal", _XSD + ("double" if "e" in word.lower() else "decimal" if "." in word else "integer"), None
        if word in ("true", "false"):
            return word, "literal", _XSD + "boolean", None
        if word == "a":
            return TYPE, "iri", None, None
        if word.startswith("_:"):
            return f"{scope}#{word}", "bnode", None, None
        prefix, _, local = word.partition(":")
        return prefixes[prefix] + local.replace("\\", ""), "iri", None, None

    def predicates(subject: str) -> None:
        while True:
            predicate = term()[0]
            while True:
                rows.append((subject, predicate, *term()))
                if tokens[at][1] != ",":
                    break
                take()
            while tokens[at][1] == ";":
                take()
            if tokens[at][1] in (".", "]"):
                return

    while at < len(tokens):
        word = tokens[at][1]
        if word.lower() in ("@prefix", "prefix"):
            take()
            name = take()[1]
            prefixes[name.rstrip(":")] = take()[1][1:-1]
        elif word.lower() in ("@base", "base"):
            take()
            base = take()[1][1:-1]
        else:
            anonymous = word == "["
            subject = term()[0]
            if not (anonymous and tokens[at][1] == "."):
                predicates(subject)
        if at < len(tokens) and tokens[at][1] == ".":
            take()
    return rows


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """Triples of Turtle files; the list of files is what is dealt out."""
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for text, file in zip(frame["value"], frame["file"]):
                yield pd.DataFrame(parse_turtle(text, file), columns=["s", "p", "o", "o_kind", "o_dt", "o_lang"])

    return files.mapInPandas(parse, SCHEMA).distinct()


def read_documents(spark: SparkSession, folder: str, pattern: str = "*.jsonld") -> DataFrame:
    """(file, value) of JSON documents in a folder and below."""
    return spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern).select(F.col("_metadata.file_path").alias("file"), "value")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(file, sha256) of whole files, to tell stale outputs."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.sha2("content", 256).alias("sha256"))


def corpus_checksum(spark: SparkSession, path: str) -> DataFrame:
    """One row: the checksum over all files' checksums in order of their paths (not over
    their bytes, so no file is moved)."""
    return checksums(spark, path).agg(F.sha2(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("file", "sha256"))), lambda x: x["sha256"])), 256).alias("sha256"))


def stale(now: DataFrame, recorded: DataFrame) -> DataFrame:
    """(file, state): what of (file, sha256) has changed, is new or is gone since it was
    recorded; files that are as recorded are left out."""
    a, b = now.select("file", F.col("sha256").alias("now")), recorded.select("file", F.col("sha256").alias("then"))
    state = F.when(F.col("then").isNull(), "new").when(F.col("now").isNull(), "gone").when(F.col("now") != F.col("then"), "changed")
    return a.join(b, "file", "full").withColumn("state", state).where("state is not null").select("file", "state")


def manifest(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """(file, modified, length, sha256) of the files there. What has the time and length of
    its row in ``known``, an earlier manifest, keeps its checksum: only other files are read."""
    here = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    listed = here.select(F.col("path").alias("file"), F.col("modificationTime").alias("modified"), "length")
    if known is None:
        return here.select(F.col("path").alias("file"), F.col("modificationTime").alias("modified"), "length", F.sha2("content", 256).alias("sha256"))
    same = listed.join(known.select("file", "modified", "length", "sha256"), ["file", "modified", "length"])
    other = [r.file for r in listed.join(same, "file", "left_anti").select("file").collect()]  # names of changed files: a listing, as Spark itself holds
    if not other:
        return same
    read = spark.read.format("binaryFile").load(other).select(F.col("path").alias("file"), F.col("modificationTime").alias("modified"), "length", F.sha2("content", 256).alias("sha256"))
    return same.unionByName(read)


def read_changed(spark: SparkSession, state: DataFrame) -> DataFrame:
    """(file, value) of the files that ``stale`` names as new or changed; no other is opened."""
    names = [r.file for r in state.where("state <> 'gone'").select("file").collect()]
    if not names:
        return spark.createDataFrame([], "file string, value string")
    return spark.read.text(names, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")


def refreshed(rows: DataFrame, state: DataFrame, fresh: DataFrame) -> DataFrame:
    """``rows`` (file, ...) brought up to date: rows of files that changed or are gone make
    way for ``fresh``, the rows of those that changed or are new."""
    return rows.join(state.select("file"), "file", "left_anti").select(*rows.columns).unionByName(fresh)


def refresh_documents(documents: DataFrame, recorded: DataFrame, rows: DataFrame, parse) -> tuple[DataFrame, DataFrame]:
    """(rows, checksums) of (file, value) documents: only those whose checksum is not as in
    ``recorded`` (file, sha256) go through ``parse``; ``rows`` are what it gave before."""
    now = documents.select("file", F.sha2("value", 256).alias("sha256"))
    state = stored(stale(now, recorded))  # asked twice, and told from whole texts
    todo = documents.join(state.where("state <> 'gone'").select("file"), "file", "left_semi")
    return refreshed(rows, state, parse(todo)), now


def _written(kind, value, data_type, lang):
    """A term as text. Blank nodes are labelled by a hash, so labels of different
    files stay apart."""
    escaped = F.replace(F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    text = F.concat(F.lit('"'), escaped, F.lit('"'))
    literal = F.when(lang.isNotNull(), F.concat(text, F.lit("@"), lang)).when(data_type.isNotNull(), F.concat(text, F.lit("^^<"), data_type, F.lit(">"))).otherwise(text)
    blank = F.concat(F.lit("_:b"), F.substring(F.md5(value.cast("binary")), 1, 20))
    return F.when(kind == "literal", literal).when(kind == "bnode", blank).otherwise(F.concat(F.lit("<"), value, F.lit(">")))


def _node_kind(value):
    """The kind of a subject: readers label blank nodes ``file#_:name`` or ``_:name``."""
    return F.when(value.rlike("(^|#)_:"), "bnode").otherwise("iri")


def ntriples_line(triples: DataFrame):
    iri, none = F.lit("iri"), F.lit(None).cast("string")
    col = lambda c: F.col(c) if c in triples.columns else none
    return F.concat_ws(" ", _written(_node_kind(F.col("s")), F.col("s"), none, none), _written(iri, F.col("p"), none, none), _written(F.coalesce(col("o_kind"), iri), F.col("o"), col("o_dt"), col("o_lang")), F.lit("."))


def as_ntriples(triples: DataFrame) -> DataFrame:
    """(value): a line for each triple."""
    return triples.select(ntriples_line(triples).alias("value"))


def write_ntriples(triples: DataFrame, path: str, mode: str = "errorifexists") -> None:
    as_ntriples(triples).write.mode(mode).text(path)


def as_turtle(triples: DataFrame) -> DataFrame:
    """(value): a block for each subject, its predicates in order."""
    lines = triples.select(F.split(ntriples_line(triples), " ", 2).alias("t")).select(F.col("t")[0].alias("s"), F.regexp_replace(F.col("t")[1], r" \.$", "").alias("rest"))
    return lines.groupBy("s").agg(F.array_sort(F.collect_set("rest")).alias("rest")).select(F.concat("s", F.lit(" "), F.array_join("rest", " ;\n    "), F.lit(" .")).alias("value"))


def write_tables(tables: dict[str, DataFrame], folder: str, mode: str = "overwrite") -> None:
    """Catalogue tables, one Parquet folder each."""
    for name, table in tables.items():
        table.write.mode(mode).parquet(f"{folder.rstrip('/')}/{name}")


def read_tables(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    """Catalogue tables that ``write_tables`` wrote."""
    return {name: spark.read.parquet(f"{folder.rstrip('/')}/{name}") for name in names}
