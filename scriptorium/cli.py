"""Command line: extract documents from page text or PDF folders, export them, list yields, validate stored JSON-LD.

    python -m scriptorium.cli extract PAGES.parquet OUT --format bibtex
    python -m scriptorium.cli batch PDF_FOLDER OUT --store CHUNKS
    python -m scriptorium.cli validate JSONLD_FILES
    python -m scriptorium.cli yields PAGES.parquet
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.operators import export as ex
from scriptorium.operators import validate
from scriptorium.plans import extract
from scriptorium.session import session
from scriptorium.sources import readers, sinks

COLUMNS = {"bibtex": ex.bibtex, "ris": ex.ris, "csl": ex.csl_json, "dublin_core": ex.dublin_core}
FORMATS = ("parquet", "json", "jsonld", "turtle", "graph", "html", "cypher", *COLUMNS)


def texts(docs: DataFrame, kind: str) -> DataFrame:
    """text: documents as `kind`, a row a document (Cypher: a row a statement)."""
    spark = docs.sparkSession
    nodes = spark.createDataFrame([], "doc_id string, seq long, node_id string, type string, label string")
    edges = spark.createDataFrame([], "doc_id string, seq long, src string, dst string, type string, evidence string")
    if kind in COLUMNS:
        return docs.select(F.concat(COLUMNS[kind](), F.lit("\n")).alias("text"))
    if kind == "turtle":
        return ex.turtle(ex.turtle_lines(docs)).select(F.col("turtle").alias("text"))
    if kind == "cypher":
        return ex.cypher_statements(docs, nodes, edges).select(F.concat("statement", F.lit(";")).alias("text"))
    if kind == "graph":
        return ex.json_graph(docs, nodes, edges).select(F.col("json").alias("text"))
    made = ex.packaged(docs)
    return made.select(F.col("json").alias("text") if kind == "jsonld" else ex.html_head(F.col("tags"), F.col("json"), F.coalesce("name", F.lit(""))).alias("text"))


def main(argv: list[str] | None = None, pdf_reader: Callable[[bytes], list[str]] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="scriptorium", description=__doc__.splitlines()[0])
    sub = parser.add_subparsers(dest="command", required=True)
    for name, source in (("extract", "pages"), ("batch", "folder")):
        p = sub.add_parser(name)
        p.add_argument(source)
        p.add_argument("out")
        p.add_argument("--format", choices=FORMATS, default="parquet" if name == "extract" else "jsonld")
        p.add_argument("--store", help="folder for the chunks, which are then made once and read again")
    for name, source in (("yields", "pages"), ("inventory", "files"), ("validate", "files")):
        sub.add_parser(name).add_argument(source)
    a = parser.parse_args(argv)
    spark = session()
    if a.command in ("inventory", "validate"):
        files = readers.jsonld_files(spark, a.files)
        (readers.inventory(files) if a.command == "inventory" else validate.json_checks(files)).show(1000, False)
        return
    if a.command == "batch":
        accepted, rejected = readers.pdf_files(spark, a.folder)
        rejected.show(1000, False)
        pages = readers.pdf_pages(accepted, pdf_reader).where("error IS NULL").drop("error")
    else:
        pages = readers.page_table(spark, a.pages)
    chunks = extract.chunks_of_pages(pages)
    if getattr(a, "store", None):
        chunks.write.mode("overwrite").parquet(a.store)
        chunks = spark.read.parquet(a.store)
    docs = extract.documents(chunks)
    if a.command == "yields":
        extract.yields(docs).orderBy("doc_id").show(1000, False)
    elif a.format == "parquet":
        docs.write.mode("overwrite").parquet(a.out)
    elif a.format == "json":
        docs.write.mode("overwrite").json(a.out)
    else:
        sinks.write_texts(texts(docs, a.format), "text", a.out)


if __name__ == "__main__":
    main()
