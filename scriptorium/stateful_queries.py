"""Queries of several steps: streams that merge into stores, an index that is stored and searched, plans that call a second parser or put operators together.

Their files are made from the driver's tables in the shared folder, so that they grow with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.queries import query, spread, t
from scriptorium.session import shared_folder


def _remove(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def totals(old: DataFrame, new: DataFrame) -> DataFrame:
    """A merge that adds up, so that a batch merged twice would show."""
    return old.unionByName(new).groupBy("user_id").agg(F.sum("n").alias("n"), F.sum("cents").alias("cents"), F.max("last").alias("last"))


@query("SELECT user_id, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents, max(event_id) AS last FROM events GROUP BY user_id")
def stream_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-02: events come as files in three batches and are added up by user in a merge store; the last batch is run again after its commit was lost."""
    from scriptorium.sources.merge_store import MergeStore
    from scriptorium.streaming.incremental import merge_stream

    root = shared_folder(spark)
    events = t(spark, sf_dir, "events").select("user_id", F.lit(1).cast("long").alias("n"), F.round(F.col("value") * 100).cast("long").alias("cents"), F.col("event_id").alias("last"))
    source, store, checkpoint = f"{root}/events", f"{root}/store", f"{root}/checkpoint"
    for k in range(3):
        events.where(F.col("last") % 3 == k).write.mode("append").parquet(source)
        stream = spark.readStream.schema(events.schema).parquet(source)
        merge_stream(stream, store, checkpoint, "user_id", merge=totals, buckets=16).awaitTermination()
    _remove(spark, f"{checkpoint}/commits/2")
    merge_stream(spark.readStream.schema(events.schema).parquet(source), store, checkpoint, "user_id", merge=totals, buckets=16).awaitTermination()
    return MergeStore(spark, store, "user_id").read().select("user_id", "n", "cents", "last")


@query("""
WITH j AS (SELECT 'Journal of ' || c_mktsegment AS journal, md5(c_mktsegment) AS issn FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY ALL)
SELECT 'e' || c_custkey AS event_id, journal, 'Study ' || c_custkey AS title, issn FROM (SELECT *, 'Journal of ' || c_mktsegment AS journal FROM customer) LEFT JOIN j USING (journal)""")
def webhook_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-03: webhook files as a stream, a third of the events sent again ten minutes later; each counts once and gets its journal's record."""
    from scriptorium.sources.readers import webhook_deliveries
    from scriptorium.streaming.incremental import known_events

    root, c = shared_folder(spark), t(spark, sf_dir, "customer")
    journal = F.concat(F.lit("Journal of "), F.col("c_mktsegment"))
    journals = c.where("c_mktsegment <> 'BUILDING'").groupBy(journal.alias("journal")).agg(F.md5(F.first("c_mktsegment")).alias("issn"))

    def bodies(rows: DataFrame, minutes: int) -> DataFrame:
        at = F.timestamp_seconds(F.lit(1_700_000_000 + 60 * minutes) + F.col("c_custkey") % 1800)
        key = F.col("c_custkey").cast("string")
        return rows.select(F.to_json(F.struct(F.concat(F.lit("e"), key).alias("event_id"), at.alias("timestamp"), journal.alias("journal"), F.struct(F.concat(F.lit("Study "), key).alias("title")).alias("article"))).alias("value"))

    for k, rows in enumerate((bodies(c, 0), bodies(c.where("c_custkey % 3 = 0"), 10))):
        rows.write.mode("append").text(f"{root}/hooks")
        raw = spark.readStream.format("text").load(f"{root}/hooks")
        stream = known_events(webhook_deliveries(raw), journals, "1 hour").writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{root}/cp").trigger(availableNow=True)
        stream.start(f"{root}/out").awaitTermination()
    return spark.read.parquet(f"{root}/out").select("event_id", "journal", "title", "issn")


def _scanned_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_idx, text: suppliers' pages. In turn a table kept its bars, became prose, is only referred to, or lost its columns."""
    k = F.col("s_suppkey").cast("long")
    pages = t(spark, sf_dir, "supplier").select((k % 97).cast("string").alias("doc_id"), (F.expr("s_suppkey div 97") + 1).cast("int").alias("page_idx"), k.alias("k"))
    key = F.col("k").cast("string")
    good = F.concat(F.lit("Table "), key, F.lit(". Stock\n| Item | Count |\n|---|---|\n| a"), key, F.lit(" | 1 |\n| b"), key, F.lit(" | 2 |"))
    prose = F.concat(F.lit("Table "), key, F.lit(". Stock of what was counted in all of the houses that year and then left out."))
    named = F.concat(F.lit("Compare Table "), key, F.lit(" with what others say of it."))
    flat = F.concat(F.lit("Table "), key, F.lit(". Stock\nwithout any columns for "), key, F.lit("\nthat one could see in "), key)
    kind = F.col("k") % 4
    table = F.when(kind == 0, good).when(kind == 1, prose).when(kind == 2, named).otherwise(flat)
    return pages.select("doc_id", "page_idx", F.concat(F.lit("Remarks of supplier "), key, F.lit(" on the season end here.\n\n"), table).alias("text"))


def _second_parser(pages: DataFrame) -> DataFrame:
    """Stands in for a paid parser: the table of each page it is given, in reverse order, every fifth one without a number and every seventh page empty."""
    key = F.regexp_extract("text", r"Table (\d+)\.", 1)
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("page_idx"))) - 1
    named: Column = F.when(key.cast("long") % 5 == 0, F.lit("Stock")).otherwise(F.concat(F.lit("Table "), key, F.lit(": Stock")))
    body = F.concat(named, F.lit("\n\n| Item | Count |\n|---|---|\n| z"), key, F.lit(" | 9 |\n| y"), key, F.lit(" | 8 |"))
    page = F.when(key.cast("long") % 10 == 0, F.col("page_idx"))
    return pages.select("doc_id", order.alias("seq"), F.when(key.cast("long") % 7 != 0, body).otherwise("").alias("text"), page.alias("page_idx"))


@query("""
WITH RECURSIVE p AS (SELECT s_suppkey::BIGINT AS k, (s_suppkey % 97)::VARCHAR AS doc_id, (s_suppkey // 97 + 1)::INT AS page, s_suppkey % 4 AS kind, sum(CASE s_suppkey % 4 WHEN 2 THEN 1 ELSE 2 END) OVER (PARTITION BY s_suppkey % 97 ORDER BY s_suppkey) AS r, sum(CASE s_suppkey % 4 WHEN 2 THEN 1 ELSE 2 END) OVER (PARTITION BY s_suppkey % 97) AS n FROM supplier),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page DESC) - 1 AS seq FROM p WHERE kind IN (1, 3)),
o AS (SELECT doc_id, list(page ORDER BY page) AS places FROM b GROUP BY doc_id),
g AS (SELECT doc_id, -1::BIGINT AS seq, []::INT[] AS used, NULL::INT AS page FROM o UNION ALL
  SELECT doc_id, seq, CASE WHEN got IS NULL THEN used ELSE list_append(used, got) END, got FROM (
    SELECT b.doc_id, b.seq, g.used, CASE WHEN k % 7 = 0 THEN NULL WHEN (k % 5 <> 0 OR k % 10 = 0) AND NOT list_contains(g.used, b.page) THEN b.page
      WHEN NOT list_contains(g.used, places[b.seq + 1]) THEN places[b.seq + 1] WHEN len(places) = 1 THEN places[1] END AS got
    FROM g JOIN b ON b.doc_id = g.doc_id AND b.seq = g.seq + 1 JOIN o ON o.doc_id = g.doc_id)),
c AS (
  SELECT doc_id, CASE kind WHEN 2 THEN r ELSE r - 1 END AS chunk_seq, page AS page_idx, 'paragraph' AS chunk_type, 'first' AS parser, 'Remarks of supplier ' || k || ' on the season end here.' || CASE kind WHEN 2 THEN chr(10) || 'Compare Table ' || k || ' with what others say of it.' ELSE '' END AS text FROM p
  UNION ALL SELECT doc_id, r, page, CASE WHEN kind IN (0, 3) THEN 'table' ELSE 'paragraph' END, 'first', CASE kind WHEN 0 THEN 'DATA TABEL / METRIK SPESIFIK:' || chr(10) || 'Table ' || k || '. Stock' || chr(10) || '| Item | Count |' || chr(10) || '|---|---|' || chr(10) || '| a' || k || ' | 1 |' || chr(10) || '| b' || k || ' | 2 |'
    WHEN 1 THEN 'Table ' || k || '. Stock of what was counted in all of the houses that year and then left out.'
    ELSE 'DATA TABEL / METRIK SPESIFIK:' || chr(10) || 'Table ' || k || '. Stock' || chr(10) || 'without any columns for ' || k || chr(10) || 'that one could see in ' || k END
  FROM p WHERE kind IN (0, 1) OR kind = 3 AND NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = p.doc_id AND g.page = p.page)
  UNION ALL SELECT b.doc_id, n + 1 + b.seq, g.page, 'table', 'second', CASE WHEN k % 5 = 0 THEN 'Stock' ELSE 'Table ' || k || ': Stock' END || chr(10) || chr(10) || '| Item | Count |' || chr(10) || '|---|---|' || chr(10) || '| z' || k || ' | 9 |' || chr(10) || '| y' || k || ' | 8 |'
  FROM g JOIN b USING (doc_id, seq) WHERE g.page IS NOT NULL)
SELECT doc_id, chunk_seq::BIGINT AS chunk_seq, page_idx, chunk_type, parser, md5(text) AS text_md5 FROM c""")
def hybrid_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-05, JOIN-07, CHK-11, CHK-12: pages whose tables were lost go to a second parser, whose tables are given back to pages one to one."""
    from scriptorium.plans.hybrid import hybrid_chunks

    out = hybrid_chunks(_scanned_pages(spark, sf_dir), _second_parser)
    return out.select("doc_id", F.col("chunk_seq").cast("long").alias("chunk_seq"), "page_idx", "chunk_type", "parser", F.md5("text").alias("text_md5"))


@query("""
WITH d AS (SELECT q.vec_id AS query_id, e.vec_id AS id, e.label, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0),
r AS (SELECT 'all' AS payload, *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM d
  UNION ALL SELECT 'label 1', *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) FROM d WHERE label = 1)
SELECT payload, query_id, rank::INT AS rank, id, round(score, 6) AS score FROM r WHERE rank <= 6""")
def stored_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-15, JOIN-15, SORT-04: an index of inverted lists, written once and searched twice, the second time with a filter on its source."""
    from scriptorium.operators import vector_index

    path = shared_folder(spark)
    e = t(spark, sf_dir, "embeddings")
    vector_index.build(e.select(F.col("vec_id").alias("id"), F.col("label").alias("source"), "embedding"), path, lists=32)
    index = vector_index.load(spark, path)
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    every = vector_index.search(spark, index, asked).withColumn("payload", F.lit("all"))
    some = vector_index.search(spark, index, asked, payload=F.col("source") == 1).withColumn("payload", F.lit("label 1"))
    return every.unionByName(some).withColumn("score", F.round("score", 6))


@query("""
WITH c AS (SELECT c_custkey AS k, c_custkey % 5 = 0 AS opp, c_custkey % 5 = 1 AS neg, (c_custkey % 150 > 100)::INT + (c_custkey % 7 = 0)::INT AS num, (c_custkey % 6 = 0)::INT AS bare, c_custkey % 3 + c_custkey % 4 AS nodes, c_custkey % 4 AS words FROM customer)
SELECT k AS doc_id, opp::BIGINT AS n_antonyms, neg::BIGINT AS n_negations, num::BIGINT AS n_numeric, bare::BIGINT AS n_unpaged, CASE WHEN nodes >= 3 AND words >= 3 THEN 'dense' WHEN nodes > 0 OR words > 0 THEN 'thin' ELSE 'isolated' END AS topology,
  CASE WHEN opp OR neg THEN greatest(30, 75 - (num + bare) * 10) WHEN num + bare = 0 AND nodes + words > 0 THEN 100 ELSE greatest(50, 100 - (num + bare) * 12) END::INT AS score,
  CASE WHEN opp OR neg THEN 'contradiction' WHEN num + bare = 0 AND nodes + words > 0 THEN 'accepted' ELSE 'flagged' END AS resolution FROM c""")
def adversarial_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL-02, VAL-03, JOIN-05, JOIN-06, MATH-06: documents of which one in five contradicts itself, one denies itself, one weighs things, one speaks of other things, and one says nothing."""
    from scriptorium.operators import validate

    c = spread(t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")).withColumn("k", F.col("c_custkey"))
    many = lambda n, x: F.transform(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda i: i < n), lambda i: F.concat(F.lit(x), i.cast("string")))
    docs = c.select(F.col("k").alias("doc_id"), F.concat(F.lit("On "), F.col("c_mktsegment")).alias("description"), many(F.col("k") % 4, "word").alias("keywords"), many(F.col("k") % 3, "thing").alias("entities"))
    second = F.element_at(
        F.array(*[F.lit(x) for x in ("Sensors decrease river water flow rates", "Sensors do not increase river water flow rates", "While sensors decrease river water flow rates", "Sensors decrease noise of river water flow rates", "Little else is said")]),
        (F.col("k") % 5 + 1).cast("int"),
    )
    sections = c.select(F.col("k").alias("doc_id"), F.explode(F.array(F.struct(F.lit(0).alias("seq"), F.lit("One").alias("section_name"), F.lit("Sensors increase river water flow rates").alias("summary"), F.lit(1).alias("page_start")), F.struct(F.lit(1).alias("seq"), F.lit("Two").alias("section_name"), second.alias("summary"), F.when(F.col("k") % 6 == 0, 0).otherwise(2).alias("page_start")))).alias("s"))
    metrics = c.select(F.col("k").alias("doc_id"), F.lit(0).cast("long").alias("seq"), F.when(F.col("k") % 2 == 0, "Yield").alias("name"), (F.col("k") % 150).cast("string").alias("value"), F.lit("%").alias("unit"), F.lit("").alias("context"), F.when(F.col("k") % 7 != 0, 3).alias("page"))
    nodes = c.select(F.col("k").alias("doc_id"), F.explode(many(F.col("k") % 4, "node")).alias("node_id"))
    return validate.adversarial(docs, sections.select("doc_id", "s.*"), metrics, nodes)


@query("""
WITH s AS (SELECT s_suppkey AS k, n_name, 'University of ' || n_name AS u, 'Institute of Rivers, Town ' || s_suppkey AS v FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT k AS doc_id, CASE k % 4 WHEN 0 THEN 'Ann Lee [' || u || '; ' || v || '] -|Jo Ek [' || v || '] -'
  WHEN 1 THEN 'Ann Lee [' || u || '] https://orcid.org/0000-0001-0000-' || lpad((k % 10000)::VARCHAR, 4, '0') || '|Jo van der Ek [' || v || '] -'
  WHEN 2 THEN 'Ann Lee [' || u || '] -|Jo Ek [' || u || '] -|S. Kortmann [' || u || '] -' ELSE '' END AS authors FROM s""")
def first_page_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-18, STR-20: authors with affiliations and ORCIDs on title pages of three layouts, and a page that has none."""
    from scriptorium.functions.authors import authors

    s = t(spark, sf_dir, "supplier").join(t(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey").cast("string")
    u, v = F.concat(F.lit("University of "), F.col("n_name")), F.concat(F.lit("Institute of Rivers, Town "), k)
    title = F.lit("A Study of the Flow of Water\nin Large Rivers\n")
    rest = F.lit("\nAbstract\nWe study rivers. Otto Text, University of Nowhere, is not an author.")
    marked = F.concat(F.lit("Ann Lee1,2 and Jo Ek²*\n1 "), u, F.lit("\n2 "), v, F.lit("\n* Corresponding author: jo@ek.org"))
    below = F.concat(F.lit("Ann Lee (ORCID: 0000-0001-0000-"), F.lpad((F.col("s_suppkey") % 10000).cast("string"), 4, "0"), F.lit(")\n"), u, F.lit("\nann@lee.org\nJo van der Ek, Senior Member, IEEE\n"), v)
    shared = F.concat(F.lit("Dr. Ann Lee, Jo Ek & S. Kortmann\n"), u)
    kind = F.col("s_suppkey") % 4
    page = F.when(kind == 0, F.concat(title, marked, rest)).when(kind == 1, F.concat(title, below, rest)).when(kind == 2, F.concat(title, shared, rest)).otherwise(F.concat(title, F.lit("with a table of what was measured in the years before"), rest))
    one = lambda a: F.concat(a["name"], F.lit(" ["), F.array_join(a["affiliations"], "; "), F.lit("] "), F.coalesce(a["orcid"], F.lit("-")))
    return s.select(F.col("s_suppkey").alias("doc_id"), F.array_join(F.transform(authors(page), one), "|").alias("authors"))


@query("""
SELECT s_suppkey AS doc_id, CASE s_suppkey % 4 WHEN 0 THEN 'Table 1. Stock' WHEN 1 THEN 'Table 2. Stock held' ELSE 'Table 3. Stock' END AS caption,
  CASE s_suppkey % 4 WHEN 0 THEN 'Item|Unit price|Count' WHEN 1 THEN 'Item|Count|Weight' ELSE 'Item|Count' END AS headers,
  CASE s_suppkey % 4 WHEN 0 THEN 'North Mill|' || s_suppkey || '.5|' || s_suppkey || ';South|' || s_suppkey || '|7;Ours|' || s_suppkey || '|' WHEN 1 THEN 'Mill|' || s_suppkey || '|2;Barn|3|' || s_suppkey ELSE 'a ' || s_suppkey || '|2;b|' || s_suppkey END AS cells
FROM supplier WHERE s_suppkey % 4 <> 3""")
def flat_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-26: tables without bars in three layouts (single spaces, one line, gaps), and prose below a caption, which is none."""
    from scriptorium.operators import tables

    key = F.col("s_suppkey").cast("string")
    spaces = F.concat(F.lit("Table 1. Stock\nItem Unit price Count\nNorth Mill "), key, F.lit(".5 "), key, F.lit("\nSouth "), key, F.lit(" 7\nOurs "), key)
    line = F.concat(F.lit("Table 2. Stock held Item Count Weight Mill "), key, F.lit(" 2 Barn 3 "), key)
    gaps = F.concat(F.lit("Table 3. Stock\nItem\tCount\na "), key, F.lit("\t2\nb  "), key)
    kind = F.col("s_suppkey") % 4
    text = F.when(kind == 0, spaces).when(kind == 1, line).when(kind == 2, gaps).otherwise("Table 4. Stock\nwithout any columns\nthat one could see")
    rows = t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.lit(0).cast("long").alias("chunk_seq"), F.lit(1).alias("page_idx"), F.lit("table").alias("chunk_type"), text.alias("text"))
    got = tables.flat_tables(rows)
    return got.select("doc_id", "caption", F.array_join("headers", "|").alias("headers"), F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), ";").alias("cells"))


@query("""
SELECT CASE WHEN turn % 3 = 0 THEN (turn + 1)::VARCHAR END AS page_label, md5(CASE WHEN turn % 3 = 0 THEN '- ' || (turn + 1) || ' -' || chr(10) ELSE 'x ' END || coalesce(role, '') || ' ' || conv_id) AS text_md5, count(*) AS n FROM conversations GROUP BY ALL""")
def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-02, SRC-12: turns as pages of text files, parted by form feeds, read by a data source of pages with their printed labels."""
    from scriptorium.sources.page_source import page_source

    c = t(spark, sf_dir, "conversations")
    label = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("- "), (F.col("turn") + 1).cast("string"), F.lit(" -\n"))).otherwise("x ")
    folder = shared_folder(spark)
    c.select(F.concat(label, F.coalesce("role", F.lit("")), F.lit(" "), F.col("conv_id").cast("string")).alias("value")).write.option("lineSep", "\f").text(folder)
    spark.dataSource.register(page_source())
    pages = spark.read.format("pages").option("suffix", ".txt").load(folder)
    return pages.groupBy("page_label", F.md5("text").alias("text_md5")).agg(F.count("*").alias("n"))


def _papers_as_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_idx, text: a paper of three pages for each supplier."""
    s = spread(t(spark, sf_dir, "supplier")).join(t(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey").cast("string")
    one = F.concat(
        F.lit("A Careful Study of Water in Rivers number "), k, F.lit("\nAnn Lee1, Jo Ek2\n1 University of "), F.col("n_name"), F.lit("\n2 Institute of Rivers\nPublished: 5 March 2021\nhttps://doi.org/10.1000/r"), k,
        F.lit("\n\nAbstract\nWe study how water flows in the rivers of "), F.col("n_name"), F.lit(" and what it carries along the way.\n\nKeywords: water, rivers, "), F.lower("n_name"), F.lit("\n\n1. Introduction\nThe rivers have been looked at before."),
    )
    two = F.concat(F.lit("2. Methods\nWe measured on site. The efficiency = 9"), k, F.lit(".5% was reached.\n\nTable 1. Flow of rivers\n| River | Flow |\n|---|---|\n| a"), k, F.lit(" | 1 |\n| b"), k, F.lit(" | 2 |"))
    three = F.concat(F.lit("3. Results\nThe results agree with what was known.\n\nREFERENCES\n[1] Lee, A. (2019). On water "), k, F.lit(". Journal of Rivers, 1, 2.\n[2] Ek, J. (2020). On rivers "), k, F.lit(". Journal of Water, 3, 4.\n[3] Ro, B. (2018). On flows "), k, F.lit(". Journal of Flows, 5, 6."))
    pages = F.posexplode(F.array(one, two, three)).alias("p", "text")
    return s.select(k.alias("doc_id"), pages).select("doc_id", (F.col("p") + 1).cast("int").alias("page_idx"), "text")


@query("""
WITH s AS (SELECT s_suppkey AS k, n_name, replace(n_name, '_', ' ') AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT k::VARCHAR AS doc_id, 'doc:2021-03-05/a-careful-study-of-water-in-rivers-number-' || k AS id, 'A Careful Study of Water in Rivers number ' || k AS name, 'en' AS in_language, '2021-03-05' AS date_published, '10.1000/r' || k AS doi,
  'Journal of Rivers' AS publisher, 'water|rivers|' || lower(n) AS keywords, 'Ann Lee: University of ' || n_name || '|Jo Ek: Institute of Rivers' AS authors, 'We study how water flows in the rivers of ' || n || ' and what it carries along the way.' AS description,
  md5('[1] Lee, A. (2019). On water ' || k || '. Journal of Rivers, 1, 2.' || chr(10) || '[2] Ek, J. (2020). On rivers ' || k || '. Journal of Water, 3, 4.' || chr(10) || '[3] Ro, B. (2018). On flows ' || k || '. Journal of Flows, 5, 6.') AS citations_md5,
  'Efficiency=9' || k || '.5%@2' AS metrics, 1 AS n_formulas, 'Abstract@1-1|1. Introduction@1-1|2. Methods@2-2|3. Results@3-3' AS sections, 'Table 1. Flow of rivers@2: River|Flow; a' || k || '|1; b' || k || '|2' AS tables FROM s""")
def extracted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extraction plan over a corpus in one job: pages to chunks to documents, with title, authors, dates, identifiers, keywords, abstract, outline, quantities, tables and bibliography."""
    from scriptorium.plans import extract

    d = extract.documents(extract.chunks_of_pages(_papers_as_pages(spark, sf_dir)))
    one = lambda c, f, sep="|": F.array_join(F.transform(c, f), sep)
    row = lambda r: F.array_join(r, "|")
    return d.select(
        "doc_id", "id", "name", "in_language", "date_published", "doi", "publisher", F.array_join("keywords", "|").alias("keywords"),
        one("authors", lambda a: F.concat(a["name"], F.lit(": "), F.array_join(a["affiliations"], "; "))).alias("authors"),
        "description", F.md5(F.array_join("citations", "\n")).alias("citations_md5"),
        one("metrics", lambda m: F.concat(m["name"], F.lit("="), m["value"].cast("string"), m["unit"], F.lit("@"), m["page"].cast("string"))).alias("metrics"),
        F.size("formulas").alias("n_formulas"),
        one("sections", lambda x: F.concat(x["section_name"], F.lit("@"), x["page_start"].cast("string"), F.lit("-"), x["page_end"].cast("string"))).alias("sections"),
        one("tables", lambda x: F.concat(x["caption"], F.lit("@"), x["page_number"].cast("string"), F.lit(": "), row(x["headers"]), F.lit("; "), one(x["rows"], row, "; "))).alias("tables"),
    )


@query("""
SELECT o_custkey::VARCHAR AS doc_id, o_orderkey::BIGINT AS chunk_seq, CASE WHEN o_custkey % 3 = 0 AND o_orderkey % 2 = 1 THEN 'again ' ELSE 'first ' END || o_orderkey AS text
FROM orders WHERE o_custkey % 7 <> 0 AND (o_custkey % 3 <> 0 OR o_orderkey % 2 = 1 OR o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 1))""")
def chunk_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-14, SRC-08: chunks are stored by document, those of some documents replaced as a whole, and other documents deleted."""
    from scriptorium.sources import readers, sinks
    from scriptorium.sources.merge_store import MergeStore

    path = shared_folder(spark)
    o = t(spark, sf_dir, "orders")
    rows = lambda df, word: df.select(F.col("o_custkey").cast("string").alias("doc_id"), F.col("o_orderkey").cast("long").alias("chunk_seq"), F.concat(F.lit(word), F.col("o_orderkey").cast("string")).alias("text"))
    sinks.replace_chunks(rows(o, "first "), path, 16)
    sinks.replace_chunks(rows(o.where("o_custkey % 3 = 0 AND o_orderkey % 2 = 1"), "again "), path, 16)
    MergeStore(spark, path, "doc_id").delete(o.where("o_custkey % 7 = 0").select(F.col("o_custkey").cast("string").alias("doc_id")))
    return readers.stored_chunks(spark, path)


@query("""
SELECT c_custkey AS id, 'fits' AS field, CASE WHEN c_custkey % 5 = 4 THEN '-' ELSE c_name END || '|' || CASE c_custkey % 3 WHEN 0 THEN 'Ann Lee' WHEN 1 THEN 'Jo' ELSE 'Jo,Ek' END || '|' || CASE c_custkey % 4 WHEN 0 THEN 'a,b' WHEN 1 THEN 'a' ELSE '-' END || '|' || CASE WHEN c_custkey % 7 = 0 THEN '-' ELSE (c_custkey % 50)::VARCHAR || '.5' END AS value FROM customer
UNION ALL SELECT c_custkey, 'name', '{"en":"x"}' FROM customer WHERE c_custkey % 5 = 4
UNION ALL SELECT c_custkey, 'keywords', '[["a"]]' FROM customer WHERE c_custkey % 4 = 2
UNION ALL SELECT c_custkey, 'score', '"high"' FROM customer WHERE c_custkey % 7 = 0""")
def coerced_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON-02, UDF-02: objects whose fields go by several names and types, brought to one schema, and a row for each value that didn't fit."""
    from scriptorium.operators import coerce

    k, name = F.col("c_custkey"), F.concat(F.lit('"'), F.col("c_name"), F.lit('"'))
    parts = [
        F.when(k % 5 == 0, F.concat(F.lit('"title": '), name)).when(k % 5 == 4, '"name": {"en": "x"}').otherwise(F.concat(F.lit('"name": '), name)),
        F.when(k % 3 == 0, '"authors": "Ann Lee"').when(k % 3 == 1, '"author": [{"@type": "Person", "name": "Jo"}]').otherwise('"author": ["Jo", {"name": "Ek"}]'),
        F.when(k % 4 == 0, '"tags": ["a", "b"]').when(k % 4 == 1, '"keywords": "a"').when(k % 4 == 2, '"keywords": [["a"]]').otherwise('"keywords": null'),
        F.when(k % 7 == 0, '"score": "high"').when(k % 7 == 1, F.concat(F.lit('"score": "'), (k % 50).cast("string"), F.lit(',5 %"'))).otherwise(F.concat(F.lit('"score": '), (k % 50).cast("string"), F.lit(".5"))),
    ]
    rows = t(spark, sf_dir, "customer").select(k.alias("id"), F.parse_json(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))).alias("v"))
    fields = {"name": "string", "author": "people", "keywords": "array<string>", "score": "double"}
    fits, lost = coerce.coerced(rows, fields, ["id"])
    text = F.concat_ws("|", F.coalesce("name", F.lit("-")), F.array_join(F.transform("author", lambda a: a["name"]), ","), F.coalesce(F.array_join("keywords", ","), F.lit("-")), F.coalesce(F.col("score").cast("string"), F.lit("-")))
    return fits.select("id", F.lit("fits").alias("field"), text.alias("value")).unionByName(lost.select("id", "field", "value"))


@query("""
WITH o AS (SELECT p_size AS doc_id, p_partkey::BIGINT AS seq, 'y = ' || p_partkey || 'x' AS expression, 'old' AS description FROM part),
n AS (SELECT p_size AS doc_id, p_partkey::BIGINT AS seq, 'Y = ' || p_partkey || 'X ' AS expression, 'new' AS description FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_size, p_partkey + 500, 'z = ' || p_partkey, 'more' FROM part WHERE p_partkey % 5 = 0 UNION ALL SELECT p_size, p_partkey + 9000000, '', 'without' FROM part WHERE p_partkey % 11 = 0)
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, coalesce(o.seq, 1000000 + n.seq) AS seq, coalesce(n.expression, o.expression) AS expression, coalesce(n.description, o.description) AS description
FROM o FULL JOIN n ON o.doc_id = n.doc_id AND lower(o.expression) = lower(trim(n.expression)) AND trim(n.expression) <> ''""")
def merge_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MRG-09: formulas meet by their expression in any case, new ones win, and those without an expression stay as they are."""
    from scriptorium.operators import merge

    p, key = t(spark, sf_dir, "part"), F.col("p_partkey").cast("string")
    rows = lambda df, off, expression, word: df.select(F.col("p_size").alias("doc_id"), (F.col("p_partkey") + off).cast("long").alias("seq"), expression.alias("expression"), F.lit(word).alias("description"))
    old = rows(p, 0, F.concat(F.lit("y = "), key, F.lit("x")), "old")
    new = rows(p.where("p_partkey % 3 = 0"), 0, F.concat(F.lit("Y = "), key, F.lit("X ")), "new").unionByName(rows(p.where("p_partkey % 5 = 0"), 500, F.concat(F.lit("z = "), key), "more"))
    new = new.unionByName(rows(p.where("p_partkey % 11 = 0"), 9_000_000, F.lit(""), "without"))
    return merge.formulas(old, new).select("doc_id", "seq", "expression", "description")
