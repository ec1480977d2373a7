"""Two parsers for one corpus: all pages go through the first, and only the pages whose tables it lost through the second."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.operators import chunks as ch
from scriptorium.operators import tables as ta
from scriptorium.plans.extract import blocks_of_pages, chunks_of_blocks
from scriptorium.session import stored

NUMBER = r"(?i)\b(?:Tabel|Table)\s+(\d+)"


def parsed_tables(chunks: DataFrame) -> DataFrame:
    """doc_id, chunk_seq, page_idx, table_no of table chunks that give a table, with bars or without."""
    rows = chunks.where("chunk_type = 'table'")
    bars = rows.where(ta.parse_markdown(F.col("text"), F.col("page_idx"), F.lit("en")).isNotNull()).select("doc_id", "chunk_seq")
    flat = ta.flat_tables(rows).where(ta.is_valid_table(F.col("headers"), F.col("rows"))).select("doc_id", "chunk_seq")
    return rows.join(bars.unionByName(flat).distinct(), ["doc_id", "chunk_seq"]).select("doc_id", "chunk_seq", "page_idx", F.regexp_extract("text", NUMBER, 1).try_cast("int").alias("table_no"))


def hybrid_chunks(pages: DataFrame, second: Callable[[DataFrame], DataFrame], first: str = "first", other: str = "second") -> DataFrame:
    """Chunks of pages (doc_id, page_idx, text) with a column parser.

    second: takes the problem pages (doc_id, page_idx, text) alone and gives doc_id, seq (place in its output, from 0), text
    (markdown) and page_idx (null where it doesn't say). Its texts go to problem pages one to one; on a page that got one,
    the first parser's tables go and its paragraphs stay. Texts that are empty or find no page are left out. New chunks
    follow the others of their document.
    """
    blocks = stored(blocks_of_pages(pages))
    regions = blocks.where(F.col("text").rlike(ch.CAPTION + r"\s*[.:\-—]") & ~F.col("text").contains("|"))
    chunks = stored(ch.mark_captured(chunks_of_blocks(blocks), regions.select("doc_id", F.col("text").alias("region"))))
    problems = stored(ch.problem_pages(chunks, stored(parsed_tables(chunks))))
    again = second(pages.join(problems.select("doc_id", "page_idx").distinct(), ["doc_id", "page_idx"], "left_semi"))
    again = stored(again).select("doc_id", F.col("seq").cast("int").alias("seq"), F.trim(F.coalesce("text", F.lit(""))).alias("text"), F.col("page_idx").cast("int").alias("page_idx")).where("text <> ''")
    numbers = F.transform(F.regexp_extract_all("text", F.lit(NUMBER + r"(?:\.\d+)?\s*[.:\-—*\s]"), 1), lambda n: n.try_cast("int"))
    placed = ch.match_reparsed(again.select("doc_id", "seq", numbers.alias("table_nos"), "page_idx"), problems)
    last = chunks.groupBy("doc_id").agg(F.max("chunk_seq").alias("last"))
    new = again.drop("page_idx").join(placed, ["doc_id", "seq"]).join(last, "doc_id")
    new = new.select("doc_id", (F.col("last") + 1 + F.col("seq")).alias("chunk_seq"), "text", F.lit("table").alias("chunk_type"), "page_idx", F.array("page_idx").alias("page_span"), F.lit(False).alias("flat_capture"), F.lit(other).alias("parser"))
    return ch.replace_tables(chunks.withColumn("parser", F.lit(first)), new)
