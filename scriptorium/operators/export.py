"""Exports of a document, column to column. Documents have: id, type (array), name, description, in_language, date_published, publisher, publisher_inferred, doi,
keywords, authors (array of struct(name, affiliations array of string)), and more where a function asks for it."""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from scriptorium.functions.bibliography import clean_entry
from scriptorium.functions.text import escape_html, escape_literal, strip

col, lit = F.col, F.lit
none = lambda: F.lit(None).cast("string")


def lines(*parts: Column, sep: str = "\n") -> Column:
    """Parts (strings, or arrays of them) that are not null, joined."""
    return F.array_join(F.filter(F.flatten(F.array(*parts)), lambda x: x.isNotNull()), sep)


def one(text: Column, when: Column | None = None) -> Column:
    return F.array(text if when is None else F.when(when, text))


def has(c: Column) -> Column:
    return F.coalesce(c, lit("")) != ""


def names(authors: Column) -> Column:
    return F.filter(F.transform(authors, lambda a: a["name"]), has)


def year(date: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(date, lit("")), r"\b(19\d\d|20\d\d)\b", 1), lit(""))


def meta(name: str, value: Column) -> Column:
    return F.when(has(value), F.concat(lit(f'<meta name="{name}" content="'), escape_html(value), lit('">')))


def bibtex_key(authors: Column, date: Column, title: Column, default_year: str = "2026") -> Column:
    surname = F.regexp_replace(F.lower(F.element_at(F.split(strip(F.coalesce(F.get(authors, lit(0)), lit("author"))), r"\s+"), -1)), "[^a-zA-Z0-9]", "")
    word = F.regexp_extract(F.lower(F.coalesce(title, lit(""))), "([a-z0-9]+)", 1)
    return F.concat(F.when(surname == "", "author").otherwise(surname), F.coalesce(year(date), lit(default_year)), F.when(word == "", "paper").otherwise(word))


def bibtex(default_year: str = "2026") -> Column:
    who, title = names(col("authors")), F.coalesce(F.nullif(col("name"), lit("")), lit("Untitled Document"))
    field = lambda k, v, ok=None: one(F.concat(lit(f"  {k} = {{"), v, lit("},")), ok)
    return lines(
        one(F.concat(lit("@article{"), bibtex_key(who, col("date_published"), title, default_year), lit(","))),
        field("title", F.concat(lit("{"), title, lit("}"))),
        field("author", F.when(F.size(who) > 0, F.array_join(who, " and ")).otherwise("Unknown Author")),
        field("year", F.coalesce(year(col("date_published")), lit(default_year))),
        field("journal", col("publisher"), has(col("publisher"))),
        field("doi", col("doi"), has(col("doi"))),
        field("abstract", strip(F.replace(col("description"), lit("\n"), lit(" "))), has(col("description"))),
        field("keywords", F.array_join("keywords", ", "), F.size("keywords") > 0),
        one(lit("}")),
    )


def ris() -> Column:
    tag = lambda t, v, ok=None: one(F.concat(lit(f"{t}  - "), v), has(v) if ok is None else ok)
    y = year(col("date_published"))
    return lines(
        one(lit("TY  - JOUR")),
        tag("TI", col("name")),
        F.transform(names(col("authors")), lambda n: F.concat(lit("AU  - "), n)),
        tag("PY", y, y.isNotNull()),
        tag("DA", col("date_published"), y.isNull() & has(col("date_published"))),
        tag("JO", col("publisher")),
        tag("DO", col("doi")),
        tag("AB", strip(F.replace(col("description"), lit("\n"), lit(" "))), has(col("description"))),
        F.transform(F.filter("keywords", has), lambda k: F.concat(lit("KW  - "), k)),
        one(lit("ER  - \n")),
    )


def csl_json() -> Column:
    def person(n: Column) -> Column:
        parts = F.split(strip(n), r"\s+")
        many = F.size(parts) > 1
        family, given = F.when(many, F.element_at(parts, -1)), F.when(many, F.array_join(F.slice(parts, lit(1), F.greatest(F.size(parts) - 1, lit(1))), " "))
        return F.struct(family.alias("family"), given.alias("given"), F.when(~many, n).alias("literal"))

    y = year(col("date_published")).cast("int")
    issued = F.struct(F.when(y.isNotNull(), F.array(F.array(y))).alias("date-parts"))
    return F.to_json(
        F.struct(
            lit("article-journal").alias("type"),
            F.coalesce("name", lit("")).alias("title"),
            F.transform(names(col("authors")), person).alias("author"),
            issued.alias("issued"),
            F.coalesce("publisher", lit("")).alias("container-title"),
            F.coalesce("doi", lit("")).alias("DOI"),
            F.coalesce("description", lit("")).alias("abstract"),
            F.array_join("keywords", ", ").alias("keyword"),
        )
    )


def scholar_tags() -> Column:
    """Meta tags for scholarly search. Further columns: journal, volume, issue, page_start, page_end, issn, pdf_url, abstract_url, citations."""
    people = F.flatten(F.transform(F.filter("authors", lambda a: has(a["name"])), lambda a: F.concat(F.array(meta("citation_author", a["name"])), F.transform(F.filter(F.coalesce(a["affiliations"], F.array().cast("array<string>")), has), lambda x: meta("citation_author_institution", x)))))
    date = F.replace(col("date_published"), lit("-"), lit("/"))
    journal = F.coalesce(F.nullif(col("journal"), lit("")), F.when(col("publisher_inferred"), col("publisher")))
    tags = {"citation_journal_title": journal, "citation_volume": col("volume"), "citation_issue": col("issue"), "citation_firstpage": col("page_start"), "citation_lastpage": col("page_end"), "citation_doi": col("doi"), "citation_issn": col("issn"), "citation_pdf_url": col("pdf_url"), "citation_abstract_html_url": col("abstract_url")}
    rest = {"citation_publisher": F.when(~F.coalesce("publisher_inferred", lit(False)), col("publisher")), "citation_language": F.coalesce("in_language", lit("id")), "citation_keywords": F.array_join("keywords", "; "), "citation_abstract": col("description")}
    refs = F.transform(F.filter(F.coalesce("citations", F.array().cast("array<string>")), lambda r: F.length(strip(r)) > 10), lambda r: meta("citation_reference", clean_entry(r)))
    return lines(
        one(meta("citation_title", col("name"))),
        people,
        one(meta("citation_publication_date", date)),
        one(meta("citation_online_date", date)),
        one(lit("<!-- citation_publication_date: not identified -->"), ~has(col("date_published"))),
        *[one(meta(k, v)) for k, v in tags.items()],
        *[one(meta(k, v)) for k, v in rest.items()],
        one(lit('<meta name="citation_fulltext_world_readable" content="">')),
        refs,
    )


def json_ld() -> Column:
    """Schema.org JSON-LD; null fields and empty lists are left out. Further columns: sections, metrics, tables, citations, identifiers."""
    some = lambda c: F.when(F.size(c) > 0, c)
    person = lambda a: F.struct(lit("Person").alias("@type"), a["name"].alias("name"), some(F.transform(a["affiliations"], lambda x: F.struct(lit("EducationalOrganization").alias("@type"), x.alias("name")))).alias("affiliation"))
    return F.to_json(
        F.struct(
            lit("https://schema.org").alias("@context"),
            col("type").alias("@type"),
            col("id").alias("@id"),
            F.nullif("name", lit("")).alias("name"),
            F.nullif("name", lit("")).alias("headline"),
            F.nullif("description", lit("")).alias("description"),
            col("in_language").alias("inLanguage"),
            F.nullif("date_published", lit("")).alias("datePublished"),
            F.when(has(col("publisher")), F.struct(lit("Organization").alias("@type"), col("publisher").alias("name"))).alias("publisher"),
            some(col("keywords")).alias("keywords"),
            some(F.transform("authors", person)).alias("author"),
            F.when(has(col("doi")), F.array(F.struct(lit("PropertyValue").alias("@type"), lit("DOI").alias("propertyID"), col("doi").alias("value")))).alias("identifier"),
            F.when(has(col("doi")), F.concat(lit("https://doi.org/"), col("doi"))).alias("sameAs"),
            some(F.concat(F.transform("sections", lambda s: F.struct(lit("CreativeWork").alias("@type"), s["section_name"].alias("name"), s["summary"].alias("description"))), F.transform("tables", lambda t: F.struct(lit("Table").alias("@type"), t["caption"].alias("name"), none().alias("description"))))).alias("hasPart"),
            some(F.transform("metrics", lambda m: F.struct(lit("PropertyValue").alias("@type"), m["name"].alias("name"), m["value"].alias("value"), m["unit"].alias("unitText")))).alias("additionalProperty"),
            some(col("citations")).alias("citation"),
        ),
        {"ignoreNullFields": "true"},
    )


def json_graph(docs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id, json: one `@graph` a document, of the document, its people, its nodes and its edges as statements."""
    paper = F.to_json(F.struct(col("id").alias("@id"), col("type").alias("@type"), col("name"), col("description"), F.transform("authors", lambda a: F.struct(F.concat(lit("kg:person_"), identifier(F.lower(a["name"]))).alias("@id"))).alias("author")))
    person = F.transform("authors", lambda a: F.to_json(F.struct(F.concat(lit("kg:person_"), identifier(F.lower(a["name"]))).alias("@id"), lit("Person").alias("@type"), a["name"].alias("name"))))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("seq", c.alias("j")))), lambda x: x["j"])
    n = nodes.groupBy("doc_id").agg(ordered(F.to_json(F.struct(col("node_id").alias("@id"), col("type").alias("@type"), col("label").alias("name")))).alias("n"))
    e = edges.groupBy("doc_id").agg(ordered(F.to_json(F.struct(col("src").alias("@id"), F.create_map(F.concat(lit("kg:"), col("type")), F.create_map(lit("@id"), col("dst"))).alias("statement")))).alias("e"))
    none_yet = F.array().cast("array<string>")
    out = docs.join(n, "doc_id", "left").join(e, "doc_id", "left")
    parts = F.array_join(F.concat(F.array(paper), person, F.coalesce("n", none_yet), F.coalesce("e", none_yet)), ",")
    return out.select("doc_id", F.concat(lit('{"@context":"https://schema.org","@graph":['), parts, lit("]}")).alias("json"))


def html_head(tags: Column, json: Column, title: Column) -> Column:
    return F.concat(lit('<head>\n  <meta charset="UTF-8">\n  <title>'), escape_html(title), lit("</title>\n"), tags, lit('\n<script type="application/ld+json">\n'), json, lit("\n</script>\n</head>"))


def embed_package(tags: Column, json: Column) -> Column:
    """What a journal system's template takes in."""
    return F.concat(lit("<!-- scholarly tags -->\n"), tags, lit('\n<!-- linked data -->\n<script type="application/ld+json">\n'), json, lit("\n</script>"))


def packaged(docs: DataFrame) -> DataFrame:
    """docs with tags, json and package made anew; columns that the exports ask for and docs lack count as empty."""
    text = ("journal", "volume", "issue", "page_start", "page_end", "issn", "pdf_url", "abstract_url")
    lists = {"sections": "struct<section_name: string, summary: string>", "tables": "struct<caption: string>", "metrics": "struct<name: string, value: string, unit: string>", "citations": "string"}
    absent = {c: none() for c in text if c not in docs.columns} | {c: lit(None).cast(f"array<{t}>") for c, t in lists.items() if c not in docs.columns}
    made = docs.select("*", *[v.alias(c) for c, v in absent.items()]).withColumns({"tags": scholar_tags(), "json": json_ld()})
    return made.withColumn("package", embed_package(col("tags"), col("json"))).drop(*absent)


#: The keys of a Schema.org document that are kept.
SCHEMA_KEYS = (
    "@context", "@type", "@id", "name", "headline", "alternateName", "description", "inLanguage", "datePublished", "dateModified", "keywords", "author", "creator", "publisher", "sdPublisher",
    "about", "hasPart", "additionalProperty", "citation", "action", "potentialAction", "mainEntity", "encodingFormat", "url", "identifier", "sameAs",
)


@F.pandas_udf(StringType())
def schema_org(raw: pd.Series) -> pd.Series:
    """A JSON-LD document with the keys of Schema.org alone and nothing empty at any depth, without its wrapper; null for what is no JSON, the bare context for what is no object."""

    def full(v) -> bool:
        return v is not None and v != "" and v != [] and v != {}

    def trimmed(v):
        return [x for x in map(trimmed, v) if full(x)] if isinstance(v, list) else v

    def pairs(items):  # the parser calls it from the inside out, so what is within is clean already
        return {k: v for k, v in ((k, trimmed(v)) for k, v in items) if full(v)}

    def clean(text: str | None) -> str | None:
        try:
            doc = json.loads(text, object_pairs_hook=pairs)
        except (TypeError, ValueError):
            return None
        doc = doc if isinstance(doc, dict) else {}
        inner = doc.get("schema_json_ld", doc)
        doc = inner if isinstance(inner, dict) else doc
        kept = {k: v for k, v in doc.items() if k in SCHEMA_KEYS}
        kept.setdefault("@context", "https://schema.org")
        return json.dumps(kept, ensure_ascii=False, separators=(",", ":"))

    return raw.map(clean)


def dublin_core(today: Column | None = None) -> Column:
    value = lambda e, q, v: F.concat(lit(f'  <dcvalue element="{e}" qualifier="{q}">'), escape_html(v), lit("</dcvalue>"))
    date = F.coalesce(F.nullif(col("date_published"), lit("")), (today if today is not None else F.current_date()).cast("string"))
    return lines(
        one(lit('<?xml version="1.0" encoding="UTF-8"?>')),
        one(lit('<dublin_core schema="dc">')),
        one(value("title", "none", F.coalesce(F.nullif(col("name"), lit("")), lit("Untitled Document")))),
        one(value("description", "abstract", F.coalesce("description", lit("")))),
        one(value("date", "issued", date)),
        one(value("language", "iso", F.coalesce("in_language", lit("en")))),
        one(value("type", "none", lit("Technical Report / Article"))),
        F.transform(names(col("authors")), lambda n: value("contributor", "author", n)),
        F.transform(F.filter("keywords", has), lambda k: value("subject", "none", k)),
        one(value("identifier", "doi", col("doi")), has(col("doi"))),
        one(lit("</dublin_core>")),
    )


def identifier(text: Column, most: int | None = None) -> Column:
    out = F.regexp_replace(F.coalesce(text, lit("")), "[^a-zA-Z0-9_]", "_")
    return out if most is None else F.left(out, lit(most))


def quoted(text: Column) -> Column:
    return F.concat(lit('"'), escape_literal(text), lit('"'))


def turtle_lines(docs: DataFrame, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> DataFrame:
    """doc_id, block, idx, line: statements of each document, its authors, sections and metrics, and its graph. Joined by turtle()."""
    doc = F.concat(lit("<"), col("id"), lit(">"))
    kinds = F.array_join(F.transform("type", lambda t: F.concat(lit("schema:"), t)), ", ")
    head = lines(
        one(F.concat(lit("a "), kinds)),
        one(F.concat(lit("schema:name "), quoted(col("name"))), has(col("name"))),
        one(F.concat(lit("schema:description "), quoted(col("description"))), has(col("description"))),
        one(F.concat(lit("schema:inLanguage "), quoted(F.coalesce("in_language", lit("id"))))),
        one(F.concat(lit('schema:datePublished "'), col("date_published"), lit('"^^xsd:date')), has(col("date_published"))),
        F.transform("keywords", lambda k: F.concat(lit("schema:keywords "), quoted(k))),
        one(F.concat(lit("schema:sameAs <https://doi.org/"), col("doi"), lit(">")), has(col("doi"))),
        sep=" ;\n    ",
    )
    out = [docs.select("doc_id", lit(0).alias("block"), lit(0).alias("idx"), F.concat(doc, lit(" "), head, lit(" .")).alias("line"))]
    a = docs.select("doc_id", doc.alias("doc"), F.posexplode("authors").alias("i", "x")).where(has(col("x.name")))
    uri = F.concat(lit("<kg:person_"), identifier(F.lower("x.name"), 30), lit("_"), (col("i") + 1).cast("string"), lit(">"))
    out.append(a.select("doc_id", lit(1).alias("block"), col("i").alias("idx"), F.concat(uri, lit(" a schema:Person ;\n    schema:name "), quoted(col("x.name")), lit(" .\n"), col("doc"), lit(" schema:author "), uri, lit(" .")).alias("line")))
    if "sections" in docs.columns:
        s = docs.select("doc_id", doc.alias("doc"), F.posexplode("sections").alias("i", "x"))
        uri = F.concat(lit("<kg:section_"), identifier(F.lower("x.section_name"), 30), lit("_"), (col("i") + 1).cast("string"), lit(">"))
        text = F.concat(uri, lit(" a schema:CreativeWork ;\n    schema:name "), quoted(col("x.section_name")), F.when(has(col("x.summary")), F.concat(lit(" ;\n    schema:description "), quoted(col("x.summary")))).otherwise(""), lit(" .\n"), col("doc"), lit(" schema:hasPart "), uri, lit(" ."))
        out.append(s.select("doc_id", lit(2).alias("block"), col("i").alias("idx"), text.alias("line")))
    if "metrics" in docs.columns:
        m = docs.select("doc_id", doc.alias("doc"), F.posexplode("metrics").alias("i", "x"))
        uri = F.concat(lit("<kg:metric_"), (col("i") + 1).cast("string"), lit("_"), identifier(F.lower("x.name"), 25), lit(">"))
        text = F.concat(uri, lit(" a schema:PropertyValue ;\n    schema:name "), quoted(col("x.name")), lit(" ;\n    schema:value "), quoted(col("x.value").cast("string")), F.when(has(col("x.unit")), F.concat(lit(" ;\n    schema:unitText "), quoted(col("x.unit")))).otherwise(""), lit(" .\n"), col("doc"), lit(" schema:additionalProperty "), uri, lit(" ."))
        out.append(m.select("doc_id", lit(3).alias("block"), col("i").alias("idx"), text.alias("line")))
    if nodes is not None:
        text = F.concat(lit("<"), col("node_id"), lit("> a <"), col("type"), lit(">"), F.when(has(col("label")), F.concat(lit(" ;\n    rdfs:label "), quoted(col("label")))).otherwise(""), lit(" ."))
        out.append(nodes.select("doc_id", lit(4).alias("block"), col("seq").cast("int").alias("idx"), text.alias("line")))
    if edges is not None:
        s, t = F.concat(lit("<"), col("src"), lit(">")), F.concat(lit("<"), col("dst"), lit(">"))
        stated = F.concat(lit("\n<kg:edge_"), identifier(col("src"), 15), lit("_"), col("type"), lit("_"), identifier(col("dst"), 15), lit("> a rdf:Statement ;\n    rdf:subject "), s, lit(" ;\n    rdf:predicate kg:"), col("type"), lit(" ;\n    rdf:object "), t, lit(" ;\n    kg:evidence "), quoted(col("evidence")), lit(" ."))
        out.append(edges.select("doc_id", lit(5).alias("block"), col("seq").cast("int").alias("idx"), F.concat(s, lit(" kg:"), col("type"), lit(" "), t, lit(" ."), F.when(has(col("evidence")), stated).otherwise("")).alias("line")))
    return reduce(DataFrame.unionByName, out)


PREAMBLE = "@prefix schema: <https://schema.org/> .\n@prefix kg: <urn:kg:> .\n@prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> .\n@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .\n@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .\n"


def turtle(statements: DataFrame) -> DataFrame:
    """doc_id, turtle."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "idx", "line"))), lambda x: x["line"]), "\n")
    return statements.groupBy("doc_id").agg(F.concat(lit(PREAMBLE + "\n"), body, lit("\n")).alias("turtle"))


def sparql_insert(turtle_text: Column, graph: str | None = None) -> Column:
    """INSERT DATA out of Turtle: prefixes as PREFIX lines, the rest as data."""
    prefixes = F.regexp_replace(F.array_join(F.regexp_extract_all(turtle_text, lit(r"(?m)^(@prefix[^\n]*)"), 1), "\n"), r"@prefix ([^\n]*?) \.", "PREFIX $1")
    body = strip(F.regexp_replace(turtle_text, r"(?m)^@prefix[^\n]*\n?", ""))
    inner = F.concat(lit(f"GRAPH <{graph}> {{\n"), body, lit("\n}")) if graph else body
    return F.concat(prefixes, lit("\nINSERT DATA {\n"), inner, lit("\n}"))


def cypher_text(text: Column) -> Column:
    out = F.coalesce(text, lit(""))
    for a, b in (("\\", "\\\\"), ("'", "\\'"), ('"', '\\"'), ("\r", " "), ("\n", " ")):
        out = F.replace(out, lit(a), lit(b))
    return strip(out)


def cypher_statements(docs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id, block, idx, statement: MERGE statements for papers, people, graph nodes and edges."""
    doc = identifier(col("id"))
    paper = F.concat(lit("MERGE (p:Paper {id: '"), doc, lit("'}) SET p.title = '"), cypher_text(col("name")), lit("', p.doi = '"), cypher_text(col("doi")), lit("'"))
    out = [docs.select("doc_id", lit(0).alias("block"), lit(0).alias("idx"), paper.alias("statement"))]
    a = docs.select("doc_id", doc.alias("d"), F.posexplode("authors").alias("i", "x")).where(has(col("x.name")))
    pid = identifier(F.lower("x.name"))
    out.append(a.select("doc_id", lit(1).alias("block"), col("i").alias("idx"), F.concat(lit("MERGE (a:Person {id: '"), pid, lit("', name: '"), cypher_text(col("x.name")), lit("'}) MERGE (p:Paper {id: '"), col("d"), lit("'}) MERGE (p)-[:AUTHORED_BY]->(a)")).alias("statement")))
    kind = F.regexp_replace(F.replace(col("type"), lit("kg:"), lit("")), "[^a-zA-Z0-9]", "")
    n = nodes.join(docs.select("doc_id", doc.alias("d")), "doc_id")
    out.append(n.select("doc_id", lit(2).alias("block"), col("seq").cast("int").alias("idx"), F.concat(lit("MERGE (n:"), F.when(kind == "", "Concept").otherwise(kind), lit(" {id: '"), identifier(col("node_id")), lit("', name: '"), cypher_text(F.coalesce("label", "node_id")), lit("'}) MERGE (p:Paper {id: '"), col("d"), lit("'}) MERGE (p)-[:CONTAINS_CONCEPT]->(n)")).alias("statement")))
    out.append(edges.select("doc_id", lit(3).alias("block"), col("seq").cast("int").alias("idx"), F.concat(lit("MATCH (s {id: '"), identifier(col("src")), lit("'}), (t {id: '"), identifier(col("dst")), lit("'}) MERGE (s)-[:"), F.upper(identifier(col("type"))), lit("]->(t)")).alias("statement")))
    return reduce(DataFrame.unionByName, out)


def sync(statements: DataFrame, send, batch: int = 500) -> None:
    """Hand the statements to `send` (a function of a list) in order, partition by partition; the documents of a partition stay together."""

    def run(rows) -> None:
        held: list[str] = []
        for r in rows:
            held.append(r["statement"])
            if len(held) >= batch:
                send(held)
                held = []
        if held:
            send(held)

    statements.repartition("doc_id").sortWithinPartitions("doc_id", "block", "idx").foreachPartition(run)
