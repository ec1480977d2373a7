"""From chunks to documents: independent branches over the chunks of a corpus, joined once by document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import bibliography, metadata
from scriptorium.functions.authors import authors as find_authors
from scriptorium.functions.text import clean_abstract, clean_title, strip
from scriptorium.operators import chunks as ch
from scriptorium.operators import metrics as me
from scriptorium.operators import outline as ou
from scriptorium.operators import tables as ta
from scriptorium.plans.progress import Stages, watched
from scriptorium.session import dealt, stored


def blocks_of_pages(pages: DataFrame) -> DataFrame:
    """Pages (doc_id, page_idx, text) to blocks without running lines. Captioned regions of pages that are one or two blocks become blocks."""
    return ch.inline_tables(ch.page_blocks(ch.strip_running(ch.lines_of(pages))))


def chunks_of_blocks(blocks: DataFrame) -> DataFrame:
    return ch.stitch(ch.merge_caption_blocks(blocks))


def chunks_of_pages(pages: DataFrame) -> DataFrame:
    return chunks_of_blocks(blocks_of_pages(pages))


def join_text(chunks: DataFrame, name: str) -> DataFrame:
    part = F.array_sort(F.collect_list(F.struct("chunk_seq", "text")))
    return chunks.groupBy("doc_id").agg(F.array_join(F.transform(part, lambda x: x["text"]), "\n\n").alias(name))


def title_of(first_page):
    """Lines of the first page up to an abstract, an e-mail or an affiliation, six at most; noise lines are left out."""
    ls = F.filter(F.transform(F.split(first_page, "\n"), lambda x: strip(x)), lambda x: (F.length(x) > 3) & ~x.rlike(r"(?i)^(?:vol\.|volume|issn|doi|https?:|www\.|received|accepted|copyright|©|\d+$|journal of|international journal)"))
    stop = F.array_position(F.transform(ls, lambda x: x.rlike(r"(?i)^abstra[ck]t?|@|\b(?:university|universitas|institute|institut|department|faculty)\b|^\p{Lu}\p{L}+(?:\s+\p{Lu}\.?)?\s+\p{Lu}\p{L}+\s*[,¹²³*\d]")), True)
    upto = F.when(stop > 0, F.slice(ls, F.lit(1), F.greatest(stop.cast("int") - 1, F.lit(0)))).otherwise(F.slice(ls, 1, 1))
    return F.array_join(F.slice(upto, 1, 6), " ")


def documents(chunks: DataFrame, scheme: str = "doc", stages: Stages | None = None) -> DataFrame:
    """One row a document: id, name, in_language, date_published, doi, genre, publisher, keywords, authors, description, citations, metrics, formulas, codes, sections, tables.

    The branches below all read the chunks, which are written to the shared folder first and dealt to tasks by document. stages gets the numbers of chunks,
    quantities, headings, sections, tables (those that don't parse are dropped) and documents of the run that writes the result.
    """
    chunks = dealt(stored(watched(stages, chunks, "chunks", tables=F.col("chunk_type") == "table")), "doc_id")
    head = chunks.where("chunk_seq <= 10")
    cover = join_text(ch.cover_chunks(chunks), "cover")
    first = join_text(chunks.where("page_idx = 1"), "first_page")
    whole = join_text(head, "head")
    body = join_text(chunks, "body")
    refs = join_text(ch.bibliography_chunks(chunks), "bib").select("doc_id", bibliography.references(F.col("bib")).alias("citations"))
    text = body.join(whole, "doc_id", "left").join(cover, "doc_id", "left").join(first, "doc_id", "left")
    raw = title_of(F.coalesce("first_page", F.lit("")))
    abstract = F.regexp_extract("body", r"(?is)\b(?:abstract|abstrak)\b[\s:.\-—]*(.{30,4000}?)(?=\n\s*(?:keywords?|kata\s+kunci|index\s+terms?|1\.?\s+introduction|introduction|pendahuluan)\b|\n\n\n|\z)", 1)
    meta = text.withColumn("authors", find_authors(F.col("first_page")))
    meta = meta.withColumn("name", clean_title(raw, F.transform("authors", lambda a: a["name"]))).withColumn("date_published", metadata.publication_date(F.coalesce("head", F.lit(""))))
    pub = metadata.publisher(F.coalesce("head", F.lit("")), F.col("name"))
    meta = meta.select(
        "doc_id",
        metadata.document_id(F.col("date_published"), F.col("name"), F.col("doc_id").cast("string"), scheme).alias("id"),
        "name",
        metadata.language(F.col("body")).alias("in_language"),
        "date_published",
        metadata.doi(F.coalesce("cover", F.lit("")), F.col("head")).alias("doi"),
        metadata.genre(F.col("body")).alias("genre"),
        pub["name"].alias("publisher"),
        pub["inferred"].alias("publisher_inferred"),
        metadata.drop_author_keywords(metadata.keywords(F.col("body")), F.transform("authors", lambda a: a["name"])).alias("keywords"),
        "authors",
        clean_abstract(abstract).alias("description"),
    )
    found = chunks.select("doc_id", "chunk_seq", F.posexplode(me.extract_metrics(F.col("text"), F.col("page_idx"))).alias("i", "m"))
    found = watched(stages, found, "quantities", without_unit=F.col("m.unit").isNull())
    found = me.first_wins(found.withColumn("seq", F.struct("chunk_seq", "i")), [F.lower("m.name"), F.col("m.value"), F.lower(F.coalesce("m.unit", F.lit("")))], "seq", "doc_id")
    metric = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "m"))).alias("x")).select("doc_id", F.transform("x", lambda y: y["m"]).alias("metrics"))
    extra = body.select("doc_id", me.formulas(F.col("body")).alias("formulas"), me.technical_codes(F.col("body")).alias("codes"))
    lines = ch.lines_of(chunks.where("chunk_type = 'paragraph'").withColumn("p", F.col("page_idx")), page="p")
    outline = ou.monotonic_outline(ou.heading_candidates(lines))
    secs = outline.select("doc_id", "seq", F.col("heading").alias("section_name"), F.lit("").alias("summary"), F.col("page").cast("int").alias("page_start"), F.lit(None).cast("int").alias("page_end"))
    secs = watched(stages, secs, "headings")
    secs = watched(stages, ou.page_ends(ou.filter_sections(secs)), "sections")
    sec = secs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("place", "section_name", "summary", "page_start", "page_end"))).alias("sections"))
    parsed = chunks.where("chunk_type = 'table'").select("doc_id", F.col("chunk_seq").alias("seq"), ta.parse_markdown(F.col("text"), F.col("page_idx"), F.lit("en")).alias("t"))
    parsed = watched(stages, parsed, "tables", without_bars=F.col("t").isNull()).where("t IS NOT NULL")
    flat = ta.flat_tables(chunks).where(ta.is_valid_table(F.col("headers"), F.col("rows"))).withColumnRenamed("chunk_seq", "seq")
    columns = ("doc_id", "seq", "caption", "page_number", "headers", "rows")
    tab = ta.consolidate(parsed.select("doc_id", "seq", "t.caption", "t.page_number", "t.headers", "t.rows").unionByName(flat.select(*columns)))
    tab = tab.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("first_seq", "caption", "page_number", "headers", "rows", "table_type"))).alias("tables"))
    out = meta
    for branch in (refs, metric, extra, sec, tab):
        out = out.join(branch, "doc_id", "left")
    out = watched(stages, out, "documents", untitled=F.coalesce("name", F.lit("")) == "", undated=F.col("date_published").isNull(), without_authors=F.size("authors") == 0)
    return out.withColumn("type", F.array_compact(F.array(F.lit("Article"), F.col("genre"))))


def yields(docs: DataFrame) -> DataFrame:
    n = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    return docs.select("doc_id", n("authors").alias("n_authors"), n("sections").alias("n_sections"), n("tables").alias("n_tables"), n("citations").alias("n_citations"), n("metrics").alias("n_metrics"))


def numbered(df: DataFrame, order: str, name: str = "seq") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy("doc_id").orderBy(order)))
