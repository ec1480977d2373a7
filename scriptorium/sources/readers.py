"""Sources: page text, PDF folders, stored tables, JSON-LD files, webhook events, parser results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium import schemas
from scriptorium.functions.text import safe_file_name, strip
from scriptorium.sources.merge_store import MergeStore
from scriptorium.sources.sinks import replacing


def page_table(spark: SparkSession, path: str) -> DataFrame:
    """Page text as Parquet: doc_id, page_idx, page_label, text."""
    return spark.read.schema(schemas.PAGE).parquet(path)


def pdf_files(spark: SparkSession, folder: str, max_mb: int = 50) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) PDF files of a folder: accepted with content, rejected with a reason. Sizes are looked at before contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    checked = files.withColumn("file_name", F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))).withColumn("reason", upload_reason(F.col("file_name"), F.col("length"), F.substring("content", 1, 4), max_mb))
    ok = checked.where(F.col("reason").isNull())
    return ok.select("file_name", "path", "length", "modificationTime", "content"), checked.where(F.col("reason").isNotNull()).select("file_name", "path", "length", "reason")


def upload_reason(name: Column, size: Column, head: Column, max_mb: int = 50) -> Column:
    """Why a file isn't taken; null if it is: a plain name, the suffix .pdf, the size, the first four bytes."""
    return (
        F.when(~safe_file_name(name), "unsafe name")
        .when(~F.lower(name).endswith(".pdf"), "no PDF suffix")
        .when(size > max_mb * 1024 * 1024, "too large")
        .when(head != F.lit("%PDF").cast("binary"), "no PDF content")
    )


def pdf_pages(files: DataFrame, extract: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """doc_id, page_idx, page_label, text, error of PDF contents by `extract`; the installed reader if there is one. A file that can't be read is one row without a page, with the error."""

    def default(content: bytes) -> list[str]:
        import io

        from pypdf import PdfReader

        return [p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages]

    reader = extract or default

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, content in zip(f["file_name"], f["content"], strict=True):
                try:
                    pages = reader(bytes(content))
                except ImportError:
                    raise
                except Exception as e:  # whatever a broken file makes a reader raise
                    yield pd.DataFrame({"doc_id": [name], "page_idx": [None], "page_label": [None], "text": [None], "error": [f"{type(e).__name__}: {e}"]})
                    continue
                yield pd.DataFrame({"doc_id": name, "page_idx": range(1, len(pages) + 1), "page_label": [str(i + 1) for i in range(len(pages))], "text": pages, "error": None})

    return files.select("file_name", "content").mapInPandas(run, schemas.PAGE + ", error string")


def cached_chunks(spark: SparkSession, files: DataFrame, parser: str, parse: Callable[[DataFrame], DataFrame], path: str) -> DataFrame:
    """Chunks of `files` (doc_id, ...) by a parser, out of the MergeStore at path as far as it has them; the others are parsed and added.

    Rows without a parser_used serve every parser. What is added takes the place of the same parser's rows of a document, so
    that a run that is repeated, or two at once, don't double them. Files that give no chunks are parsed again each time.
    """
    key = ["parser_used", "doc_id"]
    store = MergeStore(spark, path, key)
    mine = F.col("parser_used").isNull() | (F.col("parser_used") == parser)
    read = lambda: store.read().where(mine).join(files.select("doc_id").distinct(), "doc_id", "left_semi")
    missing = files if store.version() is None else files.join(read().select("doc_id").distinct(), "doc_id", "left_anti")
    store.merge(parse(missing).withColumn("parser_used", F.lit(parser)), replacing(key))
    return read()


def element_chunks(elements: DataFrame) -> DataFrame:
    """Elements of an external parser (doc_id, seq, type, text, page_number) as chunks: `Table` is a table, others are paragraphs."""
    table = F.col("type") == "Table"
    number = F.when(table, F.sum(table.cast("int")).over(Window.partitionBy("doc_id").orderBy("seq")))
    return elements.where(strip(F.col("text")) != "").select(
        "doc_id", F.col("seq").cast("int").alias("chunk_seq"), "text", F.when(table, "table").otherwise("paragraph").alias("chunk_type"), F.coalesce("page_number", F.lit(1)).cast("int").alias("page_idx"), F.array(F.coalesce("page_number", F.lit(1)).cast("int")).alias("page_span"), number.cast("int").alias("table_id")
    )


def first_parser(*results: DataFrame) -> DataFrame:
    """Chunks of the first parser that has any for a document; the later ones fill in for the documents that it lacks."""
    out = results[0]
    for df in results[1:]:
        out = out.unionByName(df.join(out.select("doc_id").distinct(), "doc_id", "left_anti"), allowMissingColumns=True)
    return out


def stored_chunks(spark: SparkSession, path: str, doc_id: str | None = None) -> DataFrame:
    """Chunks of the store that sinks.replace_chunks writes, of one document out of its bucket alone; chunk_seq orders a document's."""
    store = MergeStore(spark, path, "doc_id")
    return store.read() if doc_id is None else store.lookup(spark.createDataFrame([(doc_id,)], "doc_id string")).orderBy("chunk_seq")


def has_chunks(chunks: DataFrame, doc_id: str) -> bool:
    return not chunks.where(F.col("doc_id") == doc_id).limit(1).isEmpty()


def jsonld_files(spark: SparkSession, path: str) -> DataFrame:
    """file_name, root (variant): JSON-LD documents, without the wrapper `schema_json_ld` if they have one."""
    raw = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file_name"), F.try_parse_json("value").alias("v"))
    inner = F.try_variant_get("v", "$.schema_json_ld", "variant")
    return raw.select("file_name", F.coalesce(inner, F.col("v")).alias("root"))


def inventory(files: DataFrame) -> DataFrame:
    """file_name and counts of authors, sections, tables, citations and metrics, by either name they go by."""
    get = lambda *paths: F.coalesce(*[F.try_variant_get("root", p, "array<variant>") for p in paths])
    parts = F.coalesce(get("$.hasPart"), F.array().cast("array<variant>"))
    of = lambda kind: F.size(F.filter(parts, lambda p: F.try_variant_get(p, "$['@type']", "string") == kind))
    n = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    return files.select(
        "file_name",
        n(get("$.author")).alias("n_authors"),
        F.greatest(n(get("$.sections")), of("CreativeWork")).alias("n_sections"),
        F.greatest(n(get("$.tables")), of("Table")).alias("n_tables"),
        n(get("$.citation", "$.references_or_sources")).alias("n_citations"),
        n(get("$.additionalProperty", "$.properties_and_metrics")).alias("n_metrics"),
    )


def webhook_events(raw: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """event, journal, title, doi, authors, keywords of webhook JSON; names of fields vary. Broken JSON gives nulls."""
    v = F.try_parse_json(F.col(column).cast("string"))
    get = lambda *paths: F.coalesce(*[F.nullif(F.try_variant_get(v, p, "string"), F.lit("")) for p in paths])
    people = F.coalesce(F.try_variant_get(v, "$.article.authors", "array<variant>"), F.try_variant_get(v, "$.submission.authors", "array<variant>"), F.try_variant_get(v, "$.authors", "array<variant>"))
    part = lambda a, k: F.coalesce(F.try_variant_get(a, f"$.{k}", "string"), F.lit(""))
    whole = lambda a: strip(F.concat_ws(" ", F.coalesce(F.nullif(part(a, "given_name"), F.lit("")), F.nullif(part(a, "givenName"), F.lit("")), part(a, "first_name")), F.coalesce(F.nullif(part(a, "family_name"), F.lit("")), F.nullif(part(a, "familyName"), F.lit("")), part(a, "last_name"))))
    name = lambda a: F.coalesce(F.nullif(part(a, "name"), F.lit("")), whole(a))
    return raw.select(
        *keep,
        F.coalesce(get("$.event", "$.event_type"), F.lit("publication.published")).alias("event"),
        get("$.journal_name", "$.journal", "$.context.name").alias("journal"),
        get("$.article.title", "$.submission.title", "$.title").alias("title"),
        get("$.article.doi", "$.submission.doi", "$.doi").alias("doi"),
        F.filter(F.transform(people, name), lambda n: n != "").alias("authors"),
        F.coalesce(F.try_variant_get(v, "$.article.keywords", "array<string>"), F.try_variant_get(v, "$.keywords", "array<string>")).alias("keywords"),
    )


def webhook_deliveries(raw: DataFrame, column: str = "value") -> DataFrame:
    """event_id, at and the columns of webhook_events: what a delivery says of itself, so that one sent again can be told. Without an id the body's hash stands for it."""
    v = F.try_parse_json(F.col(column).cast("string"))
    get = lambda *paths: F.coalesce(*[F.nullif(F.try_variant_get(v, p, "string"), F.lit("")) for p in paths])
    own = F.coalesce(get("$.event_id", "$.delivery_id", "$.id"), F.sha2(F.col(column).cast("string"), 256))
    at = F.coalesce(get("$.timestamp", "$.created_at", "$.sent_at").try_cast("timestamp"), F.timestamp_seconds(F.lit(0)))
    return webhook_events(raw.withColumns({"__id": own, "__at": at}), column, ("__id", "__at")).withColumnsRenamed({"__id": "event_id", "__at": "at"})


def find_files(files: DataFrame, name: str) -> DataFrame:
    """Files whose name holds, or begins with the first 15 characters of, a name; upper and lower case alike."""
    low = F.lower("file_name")
    want = name.lower().removesuffix(".pdf")
    return files.where(low.contains(want) | low.startswith(want[:15]) | F.lit(want).contains(F.regexp_replace(low, r"\.pdf$", "")))
