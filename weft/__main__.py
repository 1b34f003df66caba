"""python -m weft SOURCE --kind shapes|plain|blocks --namespace IRI --out FOLDER

Reads an ontology (Turtle, N-Triples) or a folder of block documents and writes its
catalogue tables as Parquet."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators import ingest
from .sources import files


def tables(spark: SparkSession, source: str, kind: str, namespace: str = "", abstract: str = "", base: str | None = None) -> dict:
    if kind == "blocks":
        nodes = ingest.graph_nodes(files.read_documents(spark, source))
        found = {"blocks": ingest.blocks, "ports": ingest.block_fields, "sub_blocks": ingest.sub_blocks, "enum_literals": ingest.enum_literals, "warnings": ingest.block_warnings}
        return {name: make(nodes) for name, make in found.items()} | {"sources": files.checksums(spark, source)}
    read = lambda path: (files.read_ntriples if path.endswith(".nt") else files.read_turtle)(spark, path)
    triples = read(source).cache()
    adapter = ingest.plain_classes(namespace) if kind == "plain" else ingest.shape_classes(namespace, abstract or namespace + "AbstractClass")
    classes, relations, shapes = ingest.classes(triples, adapter, read(base) if base else None), ingest.relations(triples, adapter), ingest.classify_shapes(triples)
    return {
        "classes": classes,
        "relations": relations,
        "shapes": ingest.dedicated(shapes),
        "notes": ingest.supplementary(triples),
        "unresolved": ingest.unresolved(shapes, classes, relations),
        "sources": files.checksums(spark, source),
    }


def main(arguments: list[str] | None = None) -> None:
    ask = argparse.ArgumentParser(prog="weft", description=__doc__)
    ask.add_argument("source")
    ask.add_argument("--kind", choices=("shapes", "plain", "blocks"), default="shapes")
    ask.add_argument("--namespace", default="")
    ask.add_argument("--abstract", default="")
    ask.add_argument("--base")
    ask.add_argument("--out", required=True)
    given = ask.parse_args(arguments)
    spark = SparkSession.builder.appName("weft").getOrCreate()
    found = tables(spark, given.source, given.kind, given.namespace, given.abstract, given.base)
    files.write_tables(found, given.out)
    for name in found:
        print(name, spark.read.parquet(f"{given.out.rstrip('/')}/{name}").count())


if __name__ == "__main__":
    main()
