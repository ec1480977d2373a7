"""Retrieval: nearest chunks by cosine, contexts for a question, titles by word overlap."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import jaccard, tokens
from scriptorium.operators.nearest import nearest


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def top_k(index: DataFrame, queries: DataFrame, k: int = 6, payload: Column | None = None, max_queries: int = 4096) -> DataFrame:
    """query_id, rank, id, score: the k nearest of each query by cosine, ties to the smaller id. index: id, embedding and more; queries: query_id, query.

    payload filters the index before anything is compared. Every query meets every row of its size, in blocks of max_queries queries
    and some thousand rows; a block keeps its own k before rows are shuffled. Vectors without a norm above 0 take no part.
    """
    rows = index if payload is None else index.where(payload)
    sized = lambda d, i, v, n: d.select(F.size(v).alias("size"), i, F.col(v).alias("v"), F.sqrt(dot(F.col(v), F.col(v))).alias(n)).where(F.col(n) > 0)
    asked = sized(queries, "query_id", "query", "qn").withColumnRenamed("v", "q")
    found = nearest(sized(rows, "id", "embedding", "n"), asked, "size", k, block_queries=max_queries)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def answer_context(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, context, sources: numbered chunks with their printed page, and the distinct sources in order. hits: query_id, rank, id; chunks: id, source, page_label, page_idx, text."""
    rows = hits.join(chunks, "id")
    page = F.coalesce("page_label", F.col("page_idx").cast("string"))
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("source"), F.lit(" (p. "), page, F.lit(")\n"), F.col("text"))
    parts = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"), F.concat(F.col("source"), F.lit(" (p. "), page, F.lit(")")).alias("s"))))
    got = rows.groupBy("query_id").agg(parts.alias("p"))
    return got.select("query_id", F.array_join(F.transform("p", lambda x: x["line"]), "\n\n").alias("context"), F.array_distinct(F.transform("p", lambda x: x["s"])).alias("sources"))


def embed(chunks: DataFrame, encoder, dims: int = 384, batch: int = 32) -> DataFrame:
    """chunks with embedding by `encoder`, a function from a list of texts to a list of vectors; it gets `batch` texts at a time."""
    from pyspark.sql.types import StructType

    schema = StructType([*chunks.schema.fields, *StructType.fromDDL("embedding array<float>").fields])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = f["text"].fillna("").tolist()
            vectors = [v for i in range(0, len(texts), batch) for v in encoder(texts[i : i + batch])]
            yield f.assign(embedding=vectors)

    return chunks.mapInPandas(run, schema)


def hashing_encoder(texts: list[str], dims: int = 384) -> list[list[float]]:
    """A deterministic stand-in where no model is at hand: hashed words, unit length."""
    import zlib

    out = []
    for t in texts:
        v = [0.0] * dims
        for w in t.lower().split():
            h = zlib.crc32(w.encode())
            v[h % dims] += 1.0 if h & (1 << 31) else -1.0
        n = sum(x * x for x in v) ** 0.5 or 1.0
        out.append([x / n for x in v])
    return out


def reconcile_titles(titles: DataFrame, known: DataFrame, least: float = 0.7) -> DataFrame:
    """id, known_id, similarity: the best known title by word overlap of each. titles: id, title; known: known_id, title, priority (least first).

    Titles meet through the rarest of their words, so many of them must share one: of overlap `least` or more at most
    (1 - least) of a title's words are missing in the other, so its ceil(n * (1 - least)) + 1 rarest words hold a shared one.
    """
    words = lambda d, i: d.select(F.col(i).alias("i"), F.array_distinct(tokens(F.col("title"))).alias("w"), *([F.col("priority")] if "priority" in d.columns else []))
    a, b = words(titles, "id"), words(known, "known_id")
    freq = b.select(F.explode("w").alias("t")).groupBy("t").agg(F.count("*").alias("n"))

    def prefixes(d: DataFrame) -> DataFrame:
        rows = d.select("i", F.size("w").alias("size"), F.explode("w").alias("t")).join(freq, "t", "left").na.fill({"n": 0})
        r = F.row_number().over(Window.partitionBy("i").orderBy("n", "t"))
        return rows.withColumn("r", r).where(F.col("r") <= F.floor(F.col("size") * (1 - least) + 1e-9) + 1).select("i", "t")

    pairs = prefixes(a).join(prefixes(b).withColumnRenamed("i", "j"), "t").select("i", "j").distinct()
    met = pairs.join(a.select("i", F.col("w").alias("wa")), "i").join(b.select(F.col("i").alias("j"), F.col("w").alias("wb"), "priority"), "j")
    met = met.withColumn("similarity", jaccard(F.col("wa"), F.col("wb"))).where(F.col("similarity") >= least)
    r = F.row_number().over(Window.partitionBy("i").orderBy("priority", F.desc("similarity"), "j"))
    return met.withColumn("r", r).where("r = 1").select(F.col("i").alias("id"), F.col("j").alias("known_id"), "similarity")
