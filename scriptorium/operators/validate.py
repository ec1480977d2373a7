"""Validation: schema readiness, graph integrity, quality dimensions, completeness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import strip

#: Document types that search engines show richly.
TYPES = ("DigitalDocument", "TechArticle", "ScholarlyArticle", "Report", "HowTo", "Legislation", "Dataset", "Article", "ConferencePaper")
AFFILIATION_LEAK = "department|faculty|fakultas|universit|institut|school of|program studi|prodi"


def size(c: Column) -> Column:
    return F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))


def check(status: Column, title: str, points: Column) -> Column:
    return F.struct(F.lit(title).alias("title"), status.alias("status"), points.alias("points"))


def schema_checks(context: Column, types: Column, name: Column, description: Column, entities: Column, keywords: Column, metrics: Column, sections: Column, tables: Column, citations: Column, provenance: Column | None = None) -> Column:
    """array of struct(title, status, points): five checks of 20 points. Lists are counted; types is an array."""
    at_home = context == "https://schema.org"
    known = F.exists(F.coalesce(types, F.array().cast("array<string>")), lambda t: t.isin(*TYPES))
    status = F.when(at_home & known, "PASS").when(at_home, "WARN").otherwise("FAIL")
    points = F.when(at_home & known, 20).when(at_home, 10).otherwise(0)
    n, d = strip(F.coalesce(name, F.lit(""))), strip(F.coalesce(description, F.lit("")))
    full = (n != "") & (F.length(d) >= 25) & ~n.endswith(".pdf")
    any_of = (size(entities) > 0) | (size(keywords) > 0) | (F.coalesce(provenance, F.lit(False)) if provenance is not None else F.lit(False))
    parts = (size(sections) > 0) | (size(tables) > 0) | (size(citations) > 0)
    two = lambda ok, title: check(F.when(ok, "PASS").otherwise("WARN"), title, F.when(ok, 20).otherwise(0))
    return F.array(
        check(status, "context and type", points),
        check(F.when(full, "PASS").when(n != "", "WARN").otherwise("FAIL"), "title and abstract", F.when(full, 20).when(n != "", 10).otherwise(0)),
        two(any_of, "entities and keywords"),
        two(size(metrics) > 0, "metrics"),
        two(parts, "structure"),
    )


def schema_score(checks: Column) -> Column:
    return F.aggregate(checks, F.lit(0), lambda s, c: s + c["points"])


def integrity(n_contradictions: Column, n_warnings: Column, all_passed: Column) -> Column:
    """struct(score, resolution) of the graph: contradictions cost 25, warnings 10 or 12, with floors of 30 and 50."""
    score = F.when(n_contradictions > 0, F.greatest(F.lit(30), 100 - n_contradictions * 25 - n_warnings * 10)).when(all_passed, 100).otherwise(F.greatest(F.lit(50), 100 - n_warnings * 12))
    resolution = F.when(n_contradictions > 0, "contradiction").when(all_passed, "accepted").otherwise("flagged")
    return F.struct(score.cast("int").alias("score"), resolution.alias("resolution"))


def readiness(schema: Column, graph: Column) -> Column:
    """struct(score, badge): half of either, rounded half to even; excellent from 85 if accepted, sound from 60."""
    score = F.bround(schema * 0.5 + graph["score"] * 0.5).cast("int")
    badge = F.when((score >= 85) & (graph["resolution"] == "accepted"), "excellent").when(score >= 60, "sound").otherwise("review")
    return F.struct(score.alias("score"), badge.alias("badge"))


def quality(name: Column, file_name: Column, description: Column, section_names: Column, units: Column, n_citations: Column, meta_tags: Column) -> Column:
    """struct of eight scores and their mean, rounded to one digit: title, abstract, keywords, structure, metrics, tables, citations, meta_tags."""
    n, d = F.coalesce(name, F.lit("")), F.coalesce(description, F.lit(""))
    title = (F.length(n) > 5) & ~n.endswith(".pdf") & (n != F.coalesce(file_name, F.lit("")))
    abstract = (F.length(d) > 30) & ~d.startswith("Dokumen ") & ~d.startswith("Copyright") & ~F.left(d, F.lit(80)).contains("Received:")
    structure = (size(section_names) > 0) & ~F.exists(section_names, lambda s: F.lower(s).rlike(AFFILIATION_LEAK))
    null_unit = F.exists(F.coalesce(units, F.array().cast("array<string>")), lambda u: u.isin("null", "None", "n/a", "undefined"))
    scores = {
        "title": F.when(title, 100).otherwise(0),
        "abstract": F.when(abstract, 100).otherwise(0),
        "keywords": F.lit(100),
        "structure": F.when(F.coalesce(structure, F.lit(False)), 100).otherwise(30),
        "metrics": F.when(F.coalesce(null_unit, F.lit(False)), 50).otherwise(100),
        "tables": F.lit(100),
        "citations": F.when(n_citations > 0, 100).otherwise(80),
        "meta_tags": F.when(F.coalesce(meta_tags.contains('<meta name="citation_title"'), F.lit(False)), 100).otherwise(0),
    }
    total = sum(scores.values(), F.lit(0))
    return F.struct(F.bround(total / 8.0, 1).alias("overall"), *[c.alias(k) for k, c in scores.items()])


def corpus_totals(reports: DataFrame) -> DataFrame:
    """One row: documents, mean score and seconds, all citations and sections. reports: score, seconds, n_citations, n_sections."""
    return reports.agg(
        F.count("*").alias("n_docs"),
        F.round(F.avg("score"), 1).alias("avg_score"),
        F.round(F.avg("seconds"), 2).alias("avg_seconds"),
        F.sum("n_citations").alias("n_citations"),
        F.sum("n_sections").alias("n_sections"),
    )


def store_counts(files: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """One row on a store: n_files, n_chunks, n_chunked (files with chunks), n_documents, indexed (whether there is any chunk)."""
    n = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
    by_doc = chunks.groupBy("doc_id").agg(F.count("*").alias("n"))
    rows = n(files, "n_files").unionByName(n(by_doc, "n_chunked")).unionByName(n(documents, "n_documents"))
    rows = rows.unionByName(by_doc.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("n_chunks").alias("what"), "n"))
    out = rows.agg(*[F.sum(F.when(F.col("what") == c, F.col("n"))).alias(c) for c in ("n_files", "n_chunks", "n_chunked", "n_documents")])
    return out.withColumn("indexed", F.col("n_chunks") > 0)


def json_checks(files: DataFrame) -> DataFrame:
    """file_name, score, checks of stored JSON-LD. files: file_name, root (variant), as jsonld_files() gives them."""
    get = lambda path, kind: F.try_variant_get("root", path, kind)
    many = lambda path: F.coalesce(get(path, "array<variant>"), F.when(get(path, "variant").isNotNull(), F.array(get(path, "variant"))))
    types = F.coalesce(get("$['@type']", "array<string>"), F.array(get("$['@type']", "string")))
    parts = F.coalesce(get("$.hasPart", "array<variant>"), F.array().cast("array<variant>"))
    kind = lambda k: F.filter(parts, lambda x: F.try_variant_get(x, "$['@type']", "string") == k)
    checks = schema_checks(F.coalesce(get("$['@context']", "string"), F.lit("")), types, get("$.name", "string"), get("$.description", "string"), many("$.about"), many("$.keywords"), many("$.additionalProperty"), kind("CreativeWork"), kind("Table"), many("$.citation"))
    return files.select("file_name", checks.alias("checks")).select("file_name", schema_score(F.col("checks")).alias("score"), "checks")


def missing_fields(date: Column, authors: Column, doi: Column) -> Column:
    """Names of what a complete record lacks."""
    return F.array_compact(F.array(F.when(strip(F.coalesce(date, F.lit(""))) == "", "date"), F.when(size(authors) == 0, "author"), F.when(strip(F.coalesce(doi, F.lit(""))) == "", "doi")))


def adversarial(docs: DataFrame, sections: DataFrame, metrics: DataFrame, nodes: DataFrame) -> DataFrame:
    """doc_id, n_antonyms, n_negations, n_numeric, n_unpaged, topology, score, resolution: the five checks of a document's claims.

    docs: doc_id, description, keywords (array), entities (array); sections: doc_id, seq, section_name, summary, page_start; metrics: doc_id, seq,
    name, value, unit, context, page; nodes: doc_id, node_id. Claims are the description, the summaries and the metrics, in this
    order; contradictions are looked for among them, denials among the summaries. Sections without a page are one warning
    together. topology: dense (three nodes and three keywords), thin, or isolated, which alone is a failed check.
    """
    from scriptorium.operators.graph import antonym_conflicts, negation_conflicts
    from scriptorium.operators.metrics import numeric_issues

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    said = docs.select("doc_id", F.lit(0).cast("long").alias("seq"), F.lit("description").alias("tag"), F.col("description").alias("text"))
    told = sections.select("doc_id", (F.col("seq") + 1).cast("long").alias("seq"), F.col("section_name").alias("tag"), F.col("summary").alias("text"))
    stated = metrics.select("doc_id", (F.col("seq") + (1 << 32)).cast("long").alias("seq"), F.col("name").alias("tag"), strip(F.concat(text("name"), F.lit(": "), text("value"), F.lit(" "), text("unit"), F.lit(" "), text("context"))).alias("text"))
    claims = said.unionByName(told).unionByName(stated).where(F.col("text") != "")
    found = docs.select("doc_id", size(F.col("keywords")).alias("n_keywords"), size(F.col("entities")).alias("n_entities"))
    parts = {
        "n_antonyms": antonym_conflicts(claims),
        "n_negations": negation_conflicts(told.where(F.col("text") != "")),
        "n_numeric": numeric_issues(metrics, every=True),
        "n_unpaged": sections.where(F.coalesce("page_start", F.lit(0)) < 1),
        "n_kg": nodes,
    }
    # one count over all parts, merged: five counts joined one by one would each be broadcast through the driver
    rows = reduce(DataFrame.unionByName, (df.select("doc_id", F.lit(name).alias("part")) for name, df in parts.items()))
    counts = rows.groupBy("doc_id").agg(*[F.count_if(F.col("part") == name).alias(name) for name in parts])
    found = found.join(counts.hint("merge"), "doc_id", "left").na.fill(0, list(parts)).withColumn("n_nodes", F.col("n_entities") + F.col("n_kg"))
    topology = F.when((F.col("n_nodes") >= 3) & (F.col("n_keywords") >= 3), "dense").when((F.col("n_nodes") > 0) | (F.col("n_keywords") > 0), "thin").otherwise("isolated")
    contradictions = F.col("n_antonyms") + F.col("n_negations")
    warnings = F.col("n_numeric") + F.when(F.col("n_unpaged") > 0, 1).otherwise(0)
    got = integrity(contradictions, warnings, (contradictions == 0) & (warnings == 0) & (topology != "isolated"))
    return found.select("doc_id", "n_antonyms", "n_negations", "n_numeric", "n_unpaged", topology.alias("topology"), got["score"].alias("score"), got["resolution"].alias("resolution"))
