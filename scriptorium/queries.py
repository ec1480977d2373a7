"""Queries of the library's own operators over the driver's tables, and DuckDB SQL for the same rows.

The tables hold little that scholarly patterns match, so most queries build their strings from the relational tables, on both
sides alike; the SQL then states what the operator must find from the source columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import bibliography, metadata, text, units
from scriptorium.operators import chunks, export, graph, merge, metrics, outline, retrieve, tables, validate
from scriptorium.sources import authorities, readers, sinks

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql is not None:
            _oracles[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where a file has come as few partitions, of which some may be empty (a row group is one task); for operators whose cost is in the expressions."""
    cores, n = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    return df if n >= 4 * cores else df.repartition(max(n, 2 * cores))


_LANG_SQL = "\n".join(
    f"len(list_filter(w, lambda x: x IN ({', '.join(repr(v) for v in words.split())}))) AS n_{lang}," for lang, words in metadata.LANGUAGE_WORDS.items()
)


@query(f"""
WITH w AS (SELECT doc_id, lang, string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}_]+') AS w FROM documents),
c AS (SELECT {_LANG_SQL} doc_id, lang FROM w),
d AS (SELECT lang, CASE WHEN greatest(n_id, n_en, n_es, n_de, n_fr) < 5 THEN CASE WHEN n_id > n_en THEN 'id' ELSE 'en' END
  WHEN n_id = greatest(n_id, n_en, n_es, n_de, n_fr) THEN 'id' WHEN n_en = greatest(n_id, n_en, n_es, n_de, n_fr) THEN 'en'
  WHEN n_es = greatest(n_id, n_en, n_es, n_de, n_fr) THEN 'es' WHEN n_de = greatest(n_id, n_en, n_es, n_de, n_fr) THEN 'de' ELSE 'fr' END AS detected, doc_id FROM c)
SELECT lang, detected, count(*) AS n_docs, count(l.doc_id) AS n_labelled, sum(l.quality)::BIGINT AS n_good FROM d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id) GROUP BY ALL""")
def lang_detect_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-15, AGG-06: labelled and detected languages with the yield of labels."""
    docs = spread(t(spark, sf_dir, "documents").select("doc_id", "lang", "text")).select("doc_id", "lang", metadata.language(F.col("text")).alias("detected"))
    labels = t(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.lit(1).alias("one"))
    return docs.join(labels, "doc_id", "left").groupBy("lang", "detected").agg(F.count("*").alias("n_docs"), F.count("one").alias("n_labelled"), F.sum("quality").alias("n_good"))


_CLEAN = ["'```[a-zA-Z]*\\n?', ''", "'\\*\\*([^*]+)\\*\\*', '\\1'", "'__([^_]+)__', '\\1'", "'\\*([^*]+)\\*', '\\1'", "'_([^_]+)_', '\\1'", "'[*_`#~]+', ' '", "'<[^>]+>', ''", "'[ \\t]+', ' '"]


def _nest(start: str, steps: list[str]) -> str:
    for s in steps:
        start = f"regexp_replace({start}, {s}, 'g')"
    return start


@query(f"""
WITH c AS (SELECT doc_id, {_nest("coalesce(text, '')", _CLEAN + ["'^[ \\t\\r\\n\\-–—:;]+|[ \\t\\r\\n\\-–—:;]+$', ''"])} AS c FROM documents),
l AS (SELECT doc_id, c, {_nest("replace(replace(replace(replace(replace(c, 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl')", ["'(\\d+)\\s+\\.\\s*(\\d+)', '\\1.\\2'", "'(\\d+)\\s*\\.\\s+(\\d+)', '\\1.\\2'"])} AS f FROM c)
SELECT doc_id, length(c)::INT AS n_clean, md5(c) AS clean_md5, md5(f) AS fixed_md5 FROM l""")
def text_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-01, STR-02."""
    clean = text.strip_markdown(F.col("text"))
    return t(spark, sf_dir, "documents").select("doc_id", F.length(clean).alias("n_clean"), F.md5(clean).alias("clean_md5"), F.md5(text.fix_ligatures(clean)).alias("fixed_md5"))


@query("""
WITH j AS (SELECT conv_id, string_agg('[Page: ' || turn || ']' || chr(10) || coalesce(text, '') || chr(10) || chr(10), '' ORDER BY turn, coalesce(text, '')) AS j FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN length(j) <= 400 THEN j ELSE left(j, 400) || chr(10) || '[...konteks dipotong...]' END AS context FROM j""")
def context_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-02."""
    return chunks.context(t(spark, sf_dir, "conversations"), 400, "conv_id", "turn", "turn").withColumnRenamed("doc_id", "conv_id")


_LINES = "SELECT source, doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS a, row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) AS z FROM (SELECT source, doc_id, regexp_replace(trim(unnest(string_split_regex(text, '\\r\\n|\\n|\\r')), ' ' || chr(9) || chr(11) || chr(12)), '\\s+', ' ', 'g') AS s, generate_subscripts(string_split_regex(text, '\\r\\n|\\n|\\r'), 1) AS i FROM documents) WHERE s <> ''"


@query(f"""
WITH l AS ({_LINES})
SELECT source, 'header' AS place, md5(lower(s)) AS key_md5, count(DISTINCT doc_id) AS pages FROM l WHERE a <= 2 AND length(s) >= 6 GROUP BY ALL HAVING count(DISTINCT doc_id) >= 3
UNION ALL
SELECT source, 'footer', md5(lower(s)), count(DISTINCT doc_id) FROM l WHERE z <= 2 AND length(s) >= 6 GROUP BY ALL HAVING count(DISTINCT doc_id) >= 3""")
def running_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHK-01, CHK-02, AGG-01: a source's documents as pages."""
    lines = chunks.lines_of(t(spark, sf_dir, "documents"), "source", "doc_id").withColumn("key", F.lower(F.regexp_replace("line", r"(?U)\s+", " ")))
    both = [chunks.running_lines(lines, h).select(F.col("doc_id").alias("source"), F.lit("header" if h else "footer").alias("place"), F.md5("key").alias("key_md5"), "pages") for h in (True, False)]
    return both[0].unionByName(both[1])


@query("""
WITH r AS (SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations), m AS (SELECT *, max(r) OVER (PARTITION BY conv_id) AS n FROM r)
SELECT conv_id, (r - 1) // 3 AS cluster, min(turn) AS first_page, max(turn) AS last_page, count(*) AS n_chunks, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn, turn, text)) AS text_md5
FROM m WHERE n <= 2 OR r < n GROUP BY conv_id, (r - 1) // 3""")
def page_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-02: turns as pages."""
    out = chunks.page_clusters(t(spark, sf_dir, "conversations"), 3, "conv_id", "turn", "turn")
    return out.select(F.col("doc_id").alias("conv_id"), "cluster", "first_page", "last_page", "n_chunks", F.md5("text").alias("text_md5"))


@query("""
WITH d AS (SELECT q.vec_id AS query_id, e.vec_id AS id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM d)
SELECT query_id, rank::INT AS rank, id, score FROM r WHERE rank <= 6""")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-15, SORT-04, MATH-07: every twentieth vector against all."""
    e = t(spark, sf_dir, "embeddings")
    index = e.select(F.col("vec_id").alias("id"), "embedding")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return retrieve.top_k(index, asked, 6).withColumn("score", F.round("score", 6))


@query("""
WITH k AS (SELECT o_orderkey, md5(o_orderkey::VARCHAR) AS h FROM orders)
SELECT o_orderkey, 'failed with [REDACTED] and Bearer [REDACTED] at [PATH] for ' || o_orderkey AS message FROM k""")
def secret_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL-17."""
    h = F.md5(F.col("o_orderkey").cast("string"))
    raw = F.concat(F.lit("failed with sk-"), h, F.lit(" and Bearer "), h, F.lit(" at /home/"), h, F.lit("/x.pdf for "), F.col("o_orderkey").cast("string"))
    return t(spark, sf_dir, "orders").select("o_orderkey", text.redact(raw).alias("message"))


@query("""
WITH a AS (SELECT c_custkey AS id, c_mktsegment, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey),
k AS (SELECT min(c_custkey) AS known_id, c_mktsegment, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT id, known_id, (3 + len(string_split(n_name, ' ')))::DOUBLE / (4 + len(string_split(n_name, ' '))) AS similarity FROM a JOIN k USING (c_mktsegment, n_name)""")
def title_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-10, SET-05."""
    c = t(spark, sf_dir, "customer").join(t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    titles = c.select(F.col("c_custkey").alias("id"), F.concat_ws(" ", "c_mktsegment", F.lit("customers of"), "n_name").alias("title"))
    known = c.groupBy("c_mktsegment", "n_name").agg(F.min("c_custkey").alias("known_id"))
    known = known.select("known_id", F.concat_ws(" ", F.lit("Customers of"), F.upper("n_name"), F.lower("c_mktsegment"), F.lit("segment")).alias("title"), F.lit(0).alias("priority"))
    return retrieve.reconcile_titles(titles, known)


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY lower(text)")
def first_wins_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-04."""
    d = t(spark, sf_dir, "documents").select("doc_id", F.sha2(F.lower("text"), 256).alias("key"))
    return metrics.first_wins(d, ["key"], "doc_id").select("doc_id")


@query("""
SELECT c_custkey, c_mktsegment || '|' || n_name || '|' || r_name AS keywords FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def keyword_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-01."""
    c = t(spark, sf_dir, "customer").join(t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    got = metadata.keyword_union(F.array("c_mktsegment", "n_name"), F.array(F.upper("n_name"), F.lit("x"), F.lower("c_mktsegment"), "r_name", F.lower("r_name")))
    return c.select("c_custkey", F.array_join(got, "|").alias("keywords"))


def _nation_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c, s = t(spark, sf_dir, "customer"), t(spark, sf_dir, "supplier")
    nodes = c.select(F.col("c_nationkey").alias("doc_id"), F.concat(F.lit("c"), "c_custkey").alias("node_id")).unionByName(s.select(F.col("s_nationkey").alias("doc_id"), F.concat(F.lit("s"), "s_suppkey").alias("node_id")))
    rows = t(spark, sf_dir, "lineitem").join(t(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    edges = rows.where("c_nationkey = s_nationkey").select(F.col("c_nationkey").alias("doc_id"), F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("s"), "s_suppkey").alias("dst")).distinct()
    return nodes, edges


_NODES = "n AS (SELECT c_nationkey AS doc_id, 'c' || c_custkey AS node_id FROM customer UNION ALL SELECT s_nationkey, 's' || s_suppkey FROM supplier)"
_EDGES = "e AS (SELECT DISTINCT c_nationkey AS doc_id, 'c' || c_custkey AS src, 's' || s_suppkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey = s_nationkey)"
_ENDS = "l AS (SELECT doc_id, src AS node_id FROM e UNION SELECT doc_id, dst FROM e)"


@query(f"""
WITH {_NODES}, {_EDGES}, {_ENDS},
c AS (SELECT n.doc_id, count(*) AS n_nodes, count(*) FILTER (WHERE l.node_id IS NULL) AS n_orphans FROM n LEFT JOIN l ON n.doc_id = l.doc_id AND n.node_id = l.node_id GROUP BY n.doc_id),
d AS (SELECT c.*, coalesce(m, 0) AS n_edges FROM c LEFT JOIN (SELECT doc_id, count(*) AS m FROM e GROUP BY doc_id) USING (doc_id))
SELECT doc_id, n_nodes, n_edges, n_orphans, CASE WHEN n_nodes > 1 THEN round_even(n_edges / (n_nodes::DOUBLE * (n_nodes - 1)), 4) ELSE 0 END AS density,
  round_even(n_edges / n_nodes::DOUBLE, 2) AS connectivity, greatest(0, round_even(1 - 0.5 * n_orphans / n_nodes::DOUBLE, 2)) AS score FROM d""")
def graph_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-08: a nation's customers and suppliers as a graph."""
    return graph.health(*_nation_graph(spark, sf_dir))


@query(f"WITH {_NODES}, {_EDGES}, {_ENDS} SELECT doc_id, node_id FROM n WHERE (doc_id, node_id) NOT IN (SELECT doc_id, node_id FROM l)")
def graph_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-08."""
    return graph.orphans(*_nation_graph(spark, sf_dir))


@query("""
WITH s AS (SELECT o_custkey AS doc_id, o_orderkey AS seq, o_orderpriority AS name, repeat('x', (o_orderkey % 11)::INT) AS description, o_orderdate < TIMESTAMP '1995-01-01' AS old FROM orders),
f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc_id, name, old ORDER BY seq) = 1)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.seq, 1000000 + b.seq) AS seq, coalesce(a.name, b.name) AS name,
  CASE WHEN a.doc_id IS NULL OR length(b.description) > length(a.description) THEN b.description ELSE a.description END AS description
FROM (SELECT * FROM f WHERE old) a FULL JOIN (SELECT * FROM f WHERE NOT old) b ON a.doc_id = b.doc_id AND a.name = b.name""")
def upsert_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-04, MRG-08: orders before 1995 are stored, later ones new."""
    o = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("name"), F.repeat(F.lit("x"), (F.col("o_orderkey") % 11).cast("int")).alias("description"), (F.col("o_orderdate") < F.lit("1995-01-01").cast("timestamp")).alias("old"))
    return merge.terms(o.where("old").drop("old"), o.where("not old").drop("old"))


@query("""
WITH l AS (SELECT l_orderkey AS doc_id, l_linenumber::BIGINT AS seq, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey) AS r FROM lineitem),
a AS (SELECT doc_id, seq FROM l WHERE r = 1 AND seq <= 3), b AS (SELECT doc_id, seq FROM l WHERE r = 1 AND seq >= 2)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.seq, 1000000 + b.seq) AS seq,
  '[' || coalesce(a.seq, b.seq) || '] Entry of part' || CASE WHEN b.seq IS NOT NULL THEN ' and supplier' ELSE '' END AS citation
FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.seq = b.seq""")
def merge_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MRG-05, SORT-03."""
    rows = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("seq")).distinct()
    cite = lambda end: F.concat(F.lit("["), F.col("seq").cast("string"), F.lit("] Entry of part" + end))
    return merge.citations(rows.where("seq <= 3").withColumn("citation", cite("")), rows.where("seq >= 2").withColumn("citation", cite(" and supplier")))


@query("SELECT event_type, count(*) AS n, count(json_extract(props, '$.k')) AS n_k, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS sum_k FROM events GROUP BY event_type")
def props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of JSON strings, by Spark's own functions."""
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return t(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count(k).alias("n_k"), F.sum(k).alias("sum_k"))


@query("""
WITH c AS (SELECT o_custkey AS doc_id, o_orderkey AS seq, o_totalprice > 150000 AS hi FROM orders)
SELECT a.doc_id, a.seq AS seq_a, b.seq AS seq_b, CASE WHEN a.hi THEN 'increase' ELSE 'decrease' END AS word, CASE WHEN a.hi THEN 'decrease' ELSE 'increase' END AS antonym, 6 AS n_shared
FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.seq < b.seq AND a.hi <> b.hi""")
def antonym_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-05, VAL-03."""
    claim = F.when(F.col("o_totalprice") > 150000, "increase").otherwise("decrease")
    o = spread(t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"))
    c = o.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("seq"), F.lit("order").alias("tag"), F.concat(F.lit("Annual revenue "), claim, F.lit(" reported across customer orders")).alias("text"))
    return graph.antonym_conflicts(c).select("doc_id", "seq_a", "seq_b", "word", "antonym", F.size("shared").alias("n_shared"))


@query("""
WITH c AS (SELECT o_custkey AS doc_id, o_orderkey AS seq, o_orderstatus = 'F' AS no FROM orders)
SELECT a.doc_id, a.seq AS seq_a, b.seq AS seq_b, 4::BIGINT AS n_shared FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.seq < b.seq AND a.no <> b.no""")
def negation_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-06."""
    claim = F.when(F.col("o_orderstatus") == "F", "not").otherwise("now")
    c = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("seq"), F.concat(F.lit("Customer shipment is "), claim, F.lit(" complete today")).alias("text"))
    return graph.negation_conflicts(c)


@query("""
SELECT l_orderkey, l_linenumber, 'Net Weight' AS name, round(l_quantity, 2) AS value, CASE l_linenumber % 3 WHEN 0 THEN 'kg' WHEN 1 THEN 'mg/dL' ELSE 'GWh' END AS unit,
  CASE l_linenumber % 3 WHEN 0 THEN 'Mass' WHEN 1 THEN 'CompoundDimension' ELSE 'Energy' END AS dimension FROM lineitem""")
def metric_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MATH-01, MATH-04, STR-07: `Net weight = value unit [3].` with a citation."""
    unit = F.when(F.col("l_linenumber") % 3 == 0, "kg").when(F.col("l_linenumber") % 3 == 1, "mg/dL").otherwise("GWh")
    line = F.concat(F.lit("The net weight = "), F.round("l_quantity", 2).cast("string"), F.lit(" "), unit, F.lit(" [3]."))
    rows = spread(t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"))
    rows = rows.select("l_orderkey", "l_linenumber", F.explode(metrics.extract_metrics(line, F.lit(1))).alias("m"))
    return rows.select("l_orderkey", "l_linenumber", "m.name", "m.value", "m.unit", "m.dimension")


@query("SELECT o_orderkey, strftime(CASE WHEN o_orderkey % 4 = 2 THEN date_trunc('month', o_orderdate) ELSE o_orderdate END, '%Y-%m-%d') AS published FROM orders")
def date_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DATE-01, DATE-02: four spellings, with weaker dates before the published one."""
    d = F.col("o_orderdate")
    kind = F.col("o_orderkey") % 4
    said = F.when(kind == 0, F.date_format(d, "d MMMM yyyy")).when(kind == 1, F.date_format(d, "MMMM d, yyyy")).when(kind == 2, F.date_format(d, "MMM yyyy")).otherwise(F.date_format(d, "yyyy-MM-dd"))
    body = F.concat(F.lit("Copyright: ©2031 by all\nReceived: 3 March 2030\nPublished: "), said, F.lit("\nText."))
    return t(spark, sf_dir, "orders").select("o_orderkey", metadata.publication_date(body).alias("published"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE '10.1000/order.' || o_orderkey END AS doi FROM orders")
def doi_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-11: stated on the first page, linked in the body, or in the references only."""
    k = F.col("o_orderkey")
    name = F.concat(F.lit("10.1000/order."), k.cast("string"))
    head = F.when(k % 3 == 1, F.concat(F.lit("A title\nDOI: "), name, F.lit(")."))).otherwise("A title")
    body = F.concat(F.when(k % 3 == 2, F.concat(F.lit("See https://doi.org/"), name, F.lit(" for data"))).otherwise("Body"), F.lit("\nReferences\n[1] A. DOI: 10.2000/other."), k.cast("string"))
    return t(spark, sf_dir, "orders").select("o_orderkey", metadata.doi(head, body).alias("doi"))


@query("""
SELECT n_nationkey, 'Table ' || (n_nationkey + 1) || '. Suppliers of ' || replace(n_name, '_', ' ') || '.' AS caption, 3 AS n_headers, count(*)::INT AS n_rows, min(replace(s_name, '#', ' ')) AS least, 'quantitative' AS table_type
FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL""")
def table_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-25, STR-21, FIL-10, FIL-11: a nation's suppliers as a table with bars."""
    s = t(spark, sf_dir, "supplier").join(t(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    row = F.concat(F.lit("| "), F.col("s_suppkey").cast("string"), F.lit(" | **"), F.col("s_name"), F.lit("** | "), F.col("s_acctbal").cast("string"), F.lit(" |"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", row.alias("r")))), lambda x: x["r"]), "\n")
    g = s.groupBy("n_nationkey", "n_name").agg(rows.alias("rows"))
    body = F.concat(F.lit("Tabel "), (F.col("n_nationkey") + 1).cast("string"), F.lit(". Suppliers of "), F.col("n_name"), F.lit(".\n| Key | Supplier | Balance |\n|---|:--|--:|\n"), F.col("rows"))
    p = g.select("n_nationkey", tables.parse_markdown(body, F.lit(1), F.lit("en")).alias("p")).where("p IS NOT NULL")
    return p.select("n_nationkey", "p.caption", F.size("p.headers").alias("n_headers"), F.size("p.rows").alias("n_rows"), F.array_min(F.transform("p.rows", lambda r: r[1])).alias("least"), "p.table_type")


@query("""
WITH f AS (SELECT l_orderkey AS doc_id, (l_partkey % 9)::INT AS page, l_linenumber AS seq FROM lineitem),
g AS (SELECT *, CASE WHEN page - lag(page) OVER (PARTITION BY doc_id ORDER BY page, seq) <= 1 THEN 0 ELSE 1 END AS new FROM f),
i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY page, seq) AS island FROM g)
SELECT doc_id, max(page) AS page_number, count(*)::INT AS n_rows, min(seq) AS first_seq FROM i GROUP BY doc_id, island""")
def table_consolidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-03, WIN-08: fragments of one table over pages; each repeats the headers as a row."""
    head = F.array(F.lit("Part"), F.lit("Price"), F.lit("Count"))
    rows = F.array(F.array(F.lit("PART"), F.lit("price "), F.lit("Count")), F.array(F.col("l_partkey").cast("string"), F.col("l_extendedprice").cast("string"), F.col("l_quantity").cast("string")))
    f = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("seq"), F.lit("Table 1. Parts").alias("caption"), (F.col("l_partkey") % 9).cast("int").alias("page_number"), head.alias("headers"), rows.alias("rows"))
    out = tables.consolidate(f)
    return out.select("doc_id", "page_number", (F.size(F.filter("rows", lambda r: F.lower(r[0]) != "part"))).alias("n_rows"), "first_seq")


@query("""
SELECT l_orderkey, count(*)::INT AS n_citations, min(l_linenumber) AS least FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem) GROUP BY l_orderkey""")
def citation_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-09: an order's lines as one string of numbered references."""
    part = F.concat(F.lit("["), F.col("l_linenumber").cast("string"), F.lit("] Writer , A . Part number "), F.col("l_partkey").cast("string"), F.lit(" of the list , 1999 ;"))
    o = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set(part)), " ").alias("s"))
    got = F.col("got")
    o = o.select("l_orderkey", bibliography.unpack(F.array(F.concat(F.lit("References "), F.col("s")))).alias("got"))
    return o.select("l_orderkey", F.size(got).alias("n_citations"), F.array_min(F.transform(got, bibliography.citation_number)).alias("least"))


@query("""
WITH RECURSIVE c AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, min(l_suppkey % 5 + 1)::INT AS page FROM lineitem GROUP BY ALL),
s AS (SELECT DISTINCT doc_id, 0 AS n, 1 AS page, false AS kept FROM c
  UNION ALL SELECT s.doc_id, s.n + 1, CASE WHEN c.page >= s.page THEN c.page ELSE s.page END, coalesce(c.page >= s.page, false) FROM s LEFT JOIN c ON c.doc_id = s.doc_id AND c.n = s.n + 1 WHERE s.n < 10)
SELECT doc_id, n AS major, page FROM s WHERE kept""")
def heading_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-23, WIN-01: numbered headings on pages, some out of order."""
    c = t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("seq")).agg(F.min(F.col("l_suppkey") % 5 + 1).cast("int").alias("page"))
    c = c.withColumn("heading", F.concat(F.col("seq").cast("string"), F.lit(". Heading of the part")))
    return outline.monotonic_outline(c).select("doc_id", "major", "page")


_UNITS = {"kg": "Mass", "mg/dL": "CompoundDimension", "km²": "Area", "GHz": "Frequency", "MWh": "Energy", "€/kWh": "CompoundDimension", "μmol": "AmountOfSubstance", "Mbps": "DataRate", "word": None, "kh": None, "GWh/year": "CompoundDimension", "mm Hg": "Pressure", "kW*h": "CompoundDimension", "%": "DimensionlessRatio"}


@query(f"""
WITH u(unit, dimension) AS (VALUES {', '.join(f"('{u}', {'NULL' if d is None else repr(d)})" for u, d in _UNITS.items())})
SELECT p_partkey, unit, dimension FROM part, u""")
def unit_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MATH-04."""
    p = t(spark, sf_dir, "part").select("p_partkey", F.explode(F.array(*[F.lit(u) for u in _UNITS])).alias("unit"))
    return p.withColumn("dimension", units.dimension(F.col("unit")))


@query("""
SELECT c_custkey, 'doc:' || CASE WHEN c_custkey % 2 = 0 THEN '2024-05-01' ELSE 'undated' END || '/' || regexp_replace(left(trim(regexp_replace(lower('Report: ' || c_name || ' & ' || c_mktsegment || ' (final)'), '[^a-z0-9]+', '-', 'g'), '-'), 50), '-+$', '') AS id,
  lower(regexp_replace(list_last(string_split(c_name, ' ')), '[^a-zA-Z0-9]', '', 'g')) || CASE WHEN c_custkey % 2 = 0 THEN '2024' ELSE '2026' END || 'report' AS cite_key FROM customer""")
def slug_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-13, SNK-05."""
    title = F.concat(F.lit("Report: "), F.col("c_name"), F.lit(" & "), F.col("c_mktsegment"), F.lit(" (final)"))
    date = F.when(F.col("c_custkey") % 2 == 0, "2024-05-01")
    return t(spark, sf_dir, "customer").select("c_custkey", metadata.document_id(date, title, F.lit("x.pdf")).alias("id"), export.bibtex_key(F.array("c_name"), date, title).alias("cite_key"))


def _papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A paper for each supplier."""
    s = t(spark, sf_dir, "supplier").join(t(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey").cast("string")
    return s.select(
        F.col("s_suppkey").alias("doc_id"), F.concat(F.lit("doc:"), k).alias("id"), F.array(F.lit("Article")).alias("type"), F.concat(F.lit("Supply & demand of "), F.col("s_name")).alias("name"), F.lit("Line one\nline \"two\"").alias("description"), F.lit("en").alias("in_language"),
        F.lit("2024-05-01").alias("date_published"), F.lit("Wiley").alias("publisher"), F.lit(False).alias("publisher_inferred"), F.concat(F.lit("10.1000/"), k).alias("doi"), F.array(F.col("n_name"), F.lit("supply")).alias("keywords"),
        F.array(F.struct(F.concat_ws(" ", F.lit("Ann"), F.col("n_name")).alias("name"), F.array(F.col("n_name")).alias("affiliations"))).alias("authors"),
    )


@query("""
SELECT s_suppkey AS doc_id, '@article{' || lower(regexp_replace(list_last(string_split(n_name, ' ')), '[^a-zA-Z0-9]', '', 'g')) || '2024supply,' || chr(10) || '  title = {{Supply & demand of ' || s_name || '}},' || chr(10) || '  author = {Ann ' || n_name || '},' || chr(10) || '  year = {2024},' || chr(10)
  || '  journal = {Wiley},' || chr(10) || '  doi = {10.1000/' || s_suppkey || '},' || chr(10) || '  abstract = {Line one line "two"},' || chr(10) || '  keywords = {' || n_name || ', supply},' || chr(10) || '}' AS bibtex,
  'TY  - JOUR' || chr(10) || 'TI  - Supply & demand of ' || s_name || chr(10) || 'AU  - Ann ' || n_name || chr(10) || 'PY  - 2024' || chr(10) || 'JO  - Wiley' || chr(10) || 'DO  - 10.1000/' || s_suppkey || chr(10) || 'AB  - Line one line "two"' || chr(10) || 'KW  - ' || n_name || chr(10) || 'KW  - supply' || chr(10) || 'ER  - ' || chr(10) AS ris,
  '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<dublin_core schema="dc">' || chr(10) || '  <dcvalue element="title" qualifier="none">Supply &amp; demand of ' || s_name || '</dcvalue>' || chr(10) || '  <dcvalue element="description" qualifier="abstract">Line one' || chr(10) || 'line &quot;two&quot;</dcvalue>' || chr(10)
  || '  <dcvalue element="date" qualifier="issued">2024-05-01</dcvalue>' || chr(10) || '  <dcvalue element="language" qualifier="iso">en</dcvalue>' || chr(10) || '  <dcvalue element="type" qualifier="none">Technical Report / Article</dcvalue>' || chr(10) || '  <dcvalue element="contributor" qualifier="author">Ann ' || n_name || '</dcvalue>' || chr(10)
  || '  <dcvalue element="subject" qualifier="none">' || n_name || '</dcvalue>' || chr(10) || '  <dcvalue element="subject" qualifier="none">supply</dcvalue>' || chr(10) || '  <dcvalue element="identifier" qualifier="doi">10.1000/' || s_suppkey || '</dcvalue>' || chr(10) || '</dublin_core>' AS dublin_core
FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def citation_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-05, SNK-06, SNK-13, STR-27."""
    return _papers(spark, sf_dir).select("doc_id", export.bibtex().alias("bibtex"), export.ris().alias("ris"), export.dublin_core().alias("dublin_core"))


@query("""
SELECT s_suppkey AS doc_id, '10.1000/' || s_suppkey AS doi, n_name AS family, 2024 AS year FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE NOT contains(n_name, ' ')
UNION ALL SELECT s_suppkey, '10.1000/' || s_suppkey, list_last(string_split(n_name, ' ')), 2024 FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE contains(n_name, ' ')""")
def csl_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-07."""
    v = F.parse_json(export.csl_json())
    get = lambda p, kind="string": F.try_variant_get(v, p, kind)
    return _papers(spark, sf_dir).select("doc_id", get("$.DOI").alias("doi"), get("$.author[0].family").alias("family"), get("$.issued['date-parts'][0][0]", "int").alias("year"))


@query("""
SELECT s_suppkey AS doc_id, 2::BIGINT AS n_blocks, '<doc:' || s_suppkey || '> a schema:Article ;' || chr(10) || '    schema:name "Supply & demand of ' || s_name || '" ;' || chr(10) || '    schema:description "Line one\\nline \\"two\\"" ;' || chr(10) || '    schema:inLanguage "en" ;' || chr(10) || '    schema:datePublished "2024-05-01"^^xsd:date ;' || chr(10)
  || '    schema:keywords "' || n_name || '" ;' || chr(10) || '    schema:keywords "supply" ;' || chr(10) || '    schema:sameAs <https://doi.org/10.1000/' || s_suppkey || '> .' AS head FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def turtle_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-02, STR-28."""
    lines = export.turtle_lines(_papers(spark, sf_dir))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_blocks"), F.min_by("line", "block").alias("head"))


@query("""
WITH p AS (SELECT s_suppkey AS doc_id, 'doc_' || s_suppkey AS d, s_name, n_name, lower(replace(n_name, ' ', '_')) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT doc_id, 0 AS block, 0 AS idx, 'MERGE (p:Paper {id: ''' || d || '''}) SET p.title = ''Supply & demand of ' || s_name || ''', p.doi = ''10.1000/' || doc_id || '''' AS statement FROM p
UNION ALL SELECT doc_id, 1, 0, 'MERGE (a:Person {id: ''ann_' || n || ''', name: ''Ann ' || n_name || '''}) MERGE (p:Paper {id: ''' || d || '''}) MERGE (p)-[:AUTHORED_BY]->(a)' FROM p
UNION ALL SELECT doc_id, 2, 1, 'MERGE (n:Concept {id: ''kg_supply'', name: ''supply''}) MERGE (p:Paper {id: ''' || d || '''}) MERGE (p)-[:CONTAINS_CONCEPT]->(n)' FROM p
UNION ALL SELECT doc_id, 2, 2, 'MERGE (n:Place {id: ''kg_place'', name: ''' || n_name || '''}) MERGE (p:Paper {id: ''' || d || '''}) MERGE (p)-[:CONTAINS_CONCEPT]->(n)' FROM p
UNION ALL SELECT doc_id, 3, 1, 'MATCH (s {id: ''kg_supply''}), (t {id: ''kg_place''}) MERGE (s)-[:LOCATEDIN]->(t)' FROM p""")
def cypher_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-08, SNK-09: every statement of papers, people, nodes and edges."""
    p = _papers(spark, sf_dir)
    node = lambda seq, at, kind, label: p.select("doc_id", F.lit(seq).alias("seq"), F.lit(at).alias("node_id"), F.lit(kind).alias("type"), label.alias("label"))
    nodes = node(1, "kg:supply", "kg:Concept", F.lit("supply")).unionByName(node(2, "kg:place", "kg:Place", F.get("keywords", F.lit(0))))
    edges = p.select("doc_id", F.lit(1).alias("seq"), F.lit("kg:supply").alias("src"), F.lit("kg:place").alias("dst"), F.lit("locatedIn").alias("type"))
    return export.cypher_statements(p, nodes, edges)


@query("""
SELECT s_suppkey AS doc_id, '<meta name="citation_title" content="Supply &amp; demand of ' || s_name || '">' AS title_tag, 1 + 1 + 1 + 2 + 1 + 1 + 1 + 1 + 1 + 1 AS n_tags FROM supplier""")
def scholar_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-03, PRJ-02."""
    none = F.lit(None).cast("string")
    p = _papers(spark, sf_dir).withColumns({c: none for c in ("journal", "volume", "issue", "page_start", "page_end", "issn", "pdf_url", "abstract_url")}).withColumn("citations", F.lit(None).cast("array<string>"))
    tags = F.split(export.scholar_tags(), r"\n(?=<)")
    return p.select("doc_id", F.get(tags, F.lit(0)).alias("title_tag"), F.size(tags).alias("n_tags"))


@query("""
WITH s AS (SELECT l_orderkey AS doc_id, l_linenumber AS seq, min(l_partkey % 6 + 1)::INT AS p FROM lineitem GROUP BY ALL)
SELECT doc_id, seq, p AS page_start, CASE WHEN lead(p) OVER w IS NULL THEN p ELSE greatest(p, lead(p) OVER w - 1) END AS page_end FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY p, seq)""")
def section_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-02, WIN-03."""
    s = t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("seq")).agg(F.min(F.col("l_partkey") % 6 + 1).cast("int").alias("page_start"))
    s = s.withColumn("section_name", F.concat(F.col("seq").cast("string"), F.lit(". Section"))).withColumn("page_end", F.lit(None).cast("int"))
    return outline.page_ends(s).select("doc_id", "seq", "page_start", "page_end")


@query("""
SELECT user_id, arg_max(event_type, ts_id) AS event_type, max(event_id) AS n FROM (SELECT user_id, event_type, event_id, event_id AS ts_id FROM events) GROUP BY user_id""")
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-06: what merging the events by user leaves, as one batch."""
    e = t(spark, sf_dir, "events").select("user_id", "event_type", F.col("event_id").alias("n"))
    return sinks.latest(e.where("n % 2 = 0"), e.where("n % 2 = 1"), "user_id", "n")


@query("""
SELECT c_custkey, 'publication.published' AS event, 'Journal of ' || c_mktsegment AS journal, 'Study ' || c_custkey AS title, 'Ann ' || c_name || '|Solo' AS authors FROM customer""")
def webhook_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-11."""
    body = F.to_json(F.struct(F.concat(F.lit("Journal of "), F.col("c_mktsegment")).alias("journal"), F.struct(F.concat(F.lit("Study "), F.col("c_custkey").cast("string")).alias("title"), F.array(F.struct(F.lit("Ann").alias("given_name"), F.col("c_name").alias("family_name"), F.lit(None).cast("string").alias("name")), F.struct(F.lit(None).cast("string").alias("given_name"), F.lit(None).cast("string").alias("family_name"), F.lit("Solo").alias("name"))).alias("authors")).alias("article")))
    raw = t(spark, sf_dir, "customer").select("c_custkey", body.alias("value"))
    got = readers.webhook_events(raw.select("value", "c_custkey"))
    return got.select(F.regexp_extract("title", r"(\d+)", 1).cast("long").alias("c_custkey"), "event", "journal", "title", F.array_join("authors", "|").alias("authors"))


@query("""
WITH q AS (SELECT p_partkey, p_size, CASE WHEN p_size % 2 = 0 THEN 100 ELSE 0 END AS a, CASE WHEN p_size % 3 = 0 THEN 100 ELSE 30 END AS s, CASE WHEN p_size % 5 = 0 THEN 50 ELSE 100 END AS m, CASE WHEN p_size % 7 = 0 THEN 80 ELSE 100 END AS c FROM part)
SELECT p_partkey, round_even((100 + a + 100 + s + m + 100 + c + 0) / 8.0, 1) AS overall FROM q""")
def quality_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL-04, AGG-09."""
    n = F.col("p_size")
    got = validate.quality(F.concat(F.lit("Part "), F.col("p_name")), F.lit("x.pdf"), F.when(n % 2 == 0, F.repeat(F.lit("word "), 8)).otherwise("short"), F.when(n % 3 == 0, F.array(F.lit("1. Introduction"))).otherwise(F.array(F.lit("Department of parts"))), F.when(n % 5 == 0, F.array(F.lit("null"))).otherwise(F.array(F.lit("kg"))), F.when(n % 7 == 0, 0).otherwise(3), F.lit(""))
    return t(spark, sf_dir, "part").select("p_partkey", got["overall"].alias("overall"))


@query("""
WITH q AS (SELECT o_orderkey, o_orderkey % 3 AS c, o_orderkey % 5 AS w, 60 + 20 * (o_orderkey % 3) AS s FROM orders),
g AS (SELECT *, CASE WHEN c > 0 THEN greatest(30, 100 - 25 * c - 10 * w) WHEN w = 0 THEN 100 ELSE greatest(50, 100 - 12 * w) END AS k, CASE WHEN c > 0 THEN 'contradiction' WHEN w = 0 THEN 'accepted' ELSE 'flagged' END AS resolution FROM q),
r AS (SELECT *, round_even(s * 0.5 + k * 0.5, 0)::INT AS score FROM g)
SELECT o_orderkey, score, resolution, CASE WHEN score >= 85 AND resolution = 'accepted' THEN 'excellent' WHEN score >= 60 THEN 'sound' ELSE 'review' END AS badge FROM r""")
def readiness_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-13."""
    k = F.col("o_orderkey")
    g = validate.integrity(k % 3, k % 5, (k % 3 == 0) & (k % 5 == 0))
    r = validate.readiness(60 + 20 * (k % 3), g)
    return t(spark, sf_dir, "orders").select("o_orderkey", r["score"].alias("score"), g["resolution"].alias("resolution"), r["badge"].alias("badge"))


@query("""
SELECT l_orderkey AS doc_id, l_linenumber AS seq, CASE WHEN round(l_quantity * 4, 0) > 100 AND l_linenumber % 2 = 0 THEN 'percentage over 100' ELSE 'no page' END AS issue FROM lineitem
WHERE (round(l_quantity * 4, 0) > 100 AND l_linenumber % 2 = 0) OR l_linenumber % 3 = 0""")
def numeric_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MATH-06."""
    n = F.col("l_linenumber")
    m = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), n.alias("seq"), F.concat(F.round(F.col("l_quantity") * 4, 0).cast("int").cast("string"), F.lit("%")).alias("value"), F.lit("%").alias("unit"), F.when(n % 2 == 0, "Share").otherwise("Growth").alias("name"), F.when(n % 3 == 0, 0).otherwise(1).alias("page"))
    return metrics.numeric_issues(m)


@query("""
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Institut Teknologi Bandung' WHEN 1 THEN 'ETH Zurich' WHEN 2 THEN 'Universitas Gadjah Mada' END AS name, CASE c_custkey % 4 WHEN 0 THEN '04sbc6a41' WHEN 1 THEN '05a28rw58' WHEN 2 THEN '03t83re46' END AS ror FROM customer WHERE c_custkey % 4 < 3""")
def institution_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-09: of two institutions in an affiliation the one of higher priority counts."""
    k = F.col("c_custkey") % 4
    place = F.when(k == 0, "Dept. of Physics, ITB (Bandung)").when(k == 1, "ETH Zurich, Switzerland").when(k == 2, "MIT and UGM, joint lab").otherwise("Nowhere Academy")
    rows = spread(t(spark, sf_dir, "customer").select("c_custkey")).select("c_custkey", place.alias("place"))
    return graph.resolve(rows, "place", authorities.institutions(spark), ["c_custkey"]).select("c_custkey", "name", "ror")


@query("""
SELECT c_custkey, c_mktsegment || ' trade|graph data|n' || c_nationkey AS keywords FROM customer""")
def keyword_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-19."""
    body = F.concat(F.lit("Abstract. We look at trade.\nKeywords: "), F.col("c_mktsegment"), F.lit(" trade; graph data; n"), F.col("c_nationkey").cast("string"), F.lit("; received 2020; x\nIntroduction\nMore text."))
    return spread(t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")).select("c_custkey", F.array_join(metadata.keywords(body), "|").alias("keywords"))


@query("""
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'Thesis' WHEN 1 THEN 'ConferencePaper' WHEN 2 THEN 'TechReport' WHEN 3 THEN 'Chapter' WHEN 4 THEN 'ScholarlyArticle' END AS genre,
  CASE o_orderkey % 3 WHEN 0 THEN 'Acme Science Press' WHEN 1 THEN 'Elsevier' ELSE 'Journal of Applied Orders' END AS publisher, o_orderkey % 3 = 2 AS inferred FROM orders""")
def genre_publisher(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-12, STR-14."""
    k = F.col("o_orderkey")
    word = F.when(k % 6 == 0, "A doctoral thesis").when(k % 6 == 1, "In proceedings of a meeting").when(k % 6 == 2, "A technical report").when(k % 6 == 3, "See chapter 3").otherwise("Plain text")
    body = F.concat(word, F.lit(" on orders.\nReferences\n[1] B. PhD thesis, conference."))
    said = F.when(k % 3 == 0, "Publisher: Acme Science Press").when(k % 3 == 1, "Printed for Elsevier in Amsterdam").otherwise("Journal of Applied Orders\nvol")
    names = F.when(k % 6 == 4, F.array(F.lit("2. Methods"), F.lit("3. Results"))).otherwise(F.array(F.lit("1. Introduction")))
    pub = metadata.publisher(said)
    return t(spark, sf_dir, "orders").select("o_orderkey", metadata.genre(body, names).alias("genre"), pub["name"].alias("publisher"), pub["inferred"].alias("inferred"))


@query("""
WITH m AS (SELECT l_orderkey AS doc_id, l_returnflag, l_linenumber AS seq, CASE WHEN l_linenumber % 2 = 0 THEN round(l_quantity, 0)::INT::VARCHAR ELSE round(l_quantity, 0)::INT || '.25' END AS v FROM lineitem),
f AS (SELECT * FROM m),
a AS (SELECT doc_id, l_returnflag, list(v ORDER BY seq, v) AS vs, min(seq) AS seq FROM f GROUP BY ALL)
SELECT doc_id, seq, CASE WHEN l_returnflag = 'A' THEN 'accuracy' ELSE 'accuracy of ' || l_returnflag END AS name, '%' AS unit, list_reduce(vs, lambda s, x: CASE WHEN length(x) > length(s) AND contains(x, '.') THEN x ELSE s END) AS value FROM a""")
def refine_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-05, MATH-05."""
    whole = F.round("l_quantity", 0).cast("int").cast("string")
    n = F.col("l_linenumber")
    m = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), n.alias("seq"), F.concat(F.lit("the **accuracy** of "), F.col("l_returnflag")).alias("name"), F.when(n % 2 == 0, whole).otherwise(F.concat(whole, F.lit(",25"))).alias("value"), F.lit("").alias("unit"), F.lit("Halaman 3").alias("context"), F.lit(3).alias("page"))
    return metrics.refine(m).select("doc_id", "seq", "name", "unit", "value")


@query("""
WITH b AS (SELECT conv_id, turn, CASE turn % 3 WHEN 1 THEN 'and then it goes on, part ' || turn ELSE 'A new sentence of turn ' || turn || CASE WHEN turn % 2 = 0 THEN '.' ELSE ' open' END END AS s FROM (SELECT DISTINCT conv_id, turn FROM conversations)),
j AS (SELECT *, coalesce(turn % 3 = 1 AND NOT regexp_matches(lag(s) OVER w, '[.!?:]$'), false) AS joins FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
i AS (SELECT *, sum((NOT joins)::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM j)
SELECT conv_id, k::BIGINT AS chunk_seq, string_agg(s, ' ' ORDER BY turn) AS text, min(turn)::INT AS page_idx, count(*)::INT AS n_pages FROM i GROUP BY conv_id, k""")
def stitch_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHK-10, WIN-08, SET-04: turns as pages of one block."""
    n = F.col("turn")
    s = F.when(n % 3 == 1, F.concat(F.lit("and then it goes on, part "), n.cast("string"))).otherwise(F.concat(F.lit("A new sentence of turn "), n.cast("string"), F.when(n % 2 == 0, ".").otherwise(" open")))
    b = t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), n.cast("int").alias("page_idx"), F.lit(0).alias("block_no"), s.alias("text")).distinct()
    return chunks.stitch(b).select(F.col("doc_id").alias("conv_id"), "chunk_seq", "text", "page_idx", F.size("page_span").alias("n_pages"))


@query("""
SELECT l_orderkey AS doc_id, count(*)::INT AS n_refs FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) GROUP BY l_orderkey HAVING count(*) >= 3""")
def reference_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-10: bracket or dotted numbers, three at least, with running heads between and a biography after."""
    n = F.col("l_linenumber").cast("string")
    mark = F.when(F.col("l_orderkey") % 2 == 0, F.concat(F.lit("["), n, F.lit("] "))).otherwise(F.concat(n, F.lit(". ")))
    line = F.concat(mark, F.lit("Author of Line, A careful study of parts\nand lines, 1998."))
    rows = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", line.alias("line")).distinct().groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "line"))).alias("x"))
    body = F.concat(F.array_join(F.transform("x", lambda r: r["line"]), "\n"), F.lit("\nISSN: 1234-5678\nABOUT THE AUTHORS\nA. Person holds a chair."))
    return rows.where(F.size("x") >= 3).select(F.col("l_orderkey").alias("doc_id"), F.size(bibliography.references(body)).alias("n_refs"))


@query("SELECT source, lang, count(*) AS n_docs, sum(n_chars)::BIGINT AS n_chars, grouping_id(source, lang)::BIGINT AS level FROM documents GROUP BY ROLLUP (source, lang)")
def corpus_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: a report over the corpus with subtotals."""
    return t(spark, sf_dir, "documents").rollup("source", "lang").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("n_chars"), F.grouping_id().cast("long").alias("level"))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: tumbling windows."""
    from scriptorium.streaming.incremental import windowed_counts

    return windowed_counts(t(spark, sf_dir, "events"))


@query("""
WITH o AS (SELECT s_nationkey AS doc_id, s_suppkey::BIGINT AS seq, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'Institute' ELSE '' END AS affiliation FROM supplier)
SELECT doc_id, seq, name, CASE WHEN affiliation = '' AND seq % 3 = 0 THEN 'University' ELSE affiliation END AS affiliation, CASE WHEN seq % 3 = 0 THEN 'id' || seq END AS identifier FROM o
UNION ALL SELECT s_nationkey, 1000000 + 100000 + s_suppkey, 'Экстра ' || s_suppkey, 'University', NULL FROM supplier WHERE s_suppkey % 5 = 0""")
def merge_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MRG-01: names in other spelling meet, blanks are filled, names of any script stay."""
    k = F.col("s_suppkey")
    s = t(spark, sf_dir, "supplier").withColumn("doc_id", F.col("s_nationkey"))
    none = F.lit(None).cast("string")
    old = s.select("doc_id", k.alias("seq"), F.col("s_name").alias("name"), F.when(k % 2 == 0, "Institute").otherwise("").alias("affiliation"), none.alias("identifier"))
    same = s.where(k % 3 == 0).select("doc_id", k.alias("seq"), F.upper(F.replace("s_name", F.lit("#"), F.lit(" - "))).alias("name"), F.lit("University").alias("affiliation"), F.concat(F.lit("id"), k.cast("string")).alias("identifier"))
    more = s.where(k % 5 == 0).select("doc_id", (k + 100000).alias("seq"), F.concat(F.lit("Экстра "), k.cast("string")).alias("name"), F.lit("University").alias("affiliation"), none.alias("identifier"))
    return merge.authors(old, same.unionByName(more))


_ITEMS = "i AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber::BIGINT AS seq FROM lineitem)"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("seq")).distinct()


@query(f"""
WITH {_ITEMS}, a AS (SELECT *, repeat('a', (seq * 3 % 7 + 1)::INT) AS s, seq AS p FROM i WHERE seq <= 4),
b AS (SELECT *, repeat('b', (seq * 5 % 8)::INT) AS s, CASE WHEN seq % 2 = 0 THEN seq + 10 END AS p FROM i WHERE seq >= 2)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.seq, 1000000 + b.seq) AS seq, CASE WHEN a.seq IS NULL THEN '## ' || b.seq || '. TOPIC' ELSE a.seq || '. Topic' END AS section_name,
  CASE WHEN a.seq IS NULL OR length(b.s) > length(a.s) THEN b.s ELSE a.s END AS summary, coalesce(b.p, a.p)::INT AS page_start FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.seq = b.seq""")
def merge_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MRG-02: the longer summary and the new pages win."""
    n, none = F.col("seq"), F.lit(None).cast("int")
    i = _items(spark, sf_dir)
    section = lambda df, name, summary, page: df.select("doc_id", "seq", name.alias("section_name"), summary.alias("summary"), page.cast("int").alias("page_start"), none.alias("page_end"))
    old = section(i.where("seq <= 4"), F.concat(n.cast("string"), F.lit(". Topic")), F.repeat(F.lit("a"), (n * 3 % 7 + 1).cast("int")), n)
    new = section(i.where("seq >= 2"), F.concat(F.lit("## "), n.cast("string"), F.lit(". TOPIC")), F.repeat(F.lit("b"), (n * 5 % 8).cast("int")), F.when(n % 2 == 0, n + 10))
    return merge.sections(old, new).drop("page_end")


@query("""
WITH s AS (SELECT o_custkey AS doc_id, o_orderkey AS seq, o_orderpriority AS category, o_orderstatus AS name, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderkey::VARCHAR END AS value, CASE WHEN o_orderkey % 5 > 0 THEN (o_orderkey % 9)::INT END AS page_number, o_orderdate < TIMESTAMP '1995-01-01' AS old FROM orders),
f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc_id, category, name, old ORDER BY seq) = 1)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.seq, 1000000 + b.seq) AS seq, coalesce(a.category, b.category) AS category, coalesce(a.name, b.name) AS name,
  CASE WHEN b.seq IS NULL OR a.value <> '' THEN a.value ELSE b.value END AS value, coalesce(b.page_number, a.page_number) AS page_number
FROM (SELECT * FROM f WHERE old) a FULL JOIN (SELECT * FROM f WHERE NOT old) b ON a.doc_id = b.doc_id AND a.category = b.category AND a.name = b.name""")
def merge_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MRG-03: stored values unless blank, new pages."""
    k = F.col("o_orderkey")
    o = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), k.alias("seq"), F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("name"), F.when(k % 4 == 0, "").otherwise(k.cast("string")).alias("value"), F.when(k % 5 > 0, (k % 9).cast("int")).alias("page_number"), (F.col("o_orderdate") < F.lit("1995-01-01").cast("timestamp")).alias("old"))
    return merge.metrics(o.where("old").drop("old"), o.where("not old").drop("old"))


@query("""
SELECT c_nationkey AS doc_id, c_custkey::BIGINT AS seq, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 5 > c_custkey % 3 + 1 THEN 'Tabel ' || c_custkey || ': Saldo' ELSE 'Table ' || c_custkey || '. Balance' END AS caption,
  CASE WHEN c_custkey % 2 = 0 THEN greatest(c_custkey % 5, c_custkey % 3 + 1) ELSE c_custkey % 3 + 1 END::INT AS n_rows FROM customer""")
def merge_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MRG-04: tables of one number meet, the one with more rows stays."""
    k = F.col("c_custkey")
    c = t(spark, sf_dir, "customer")
    table = lambda df, caption, n: df.select(F.col("c_nationkey").alias("doc_id"), k.alias("seq"), caption.alias("caption"), F.array_repeat(F.array(F.lit("1"), F.lit("2")), n.cast("int")).alias("rows"))
    old = table(c, F.concat(F.lit("Table "), k.cast("string"), F.lit(". Balance")), k % 3 + 1)
    new = table(c.where(k % 2 == 0), F.concat(F.lit("Tabel "), k.cast("string"), F.lit(": Saldo")), k % 5)
    return merge.tables(old, new).select("doc_id", "seq", "caption", F.size("rows").alias("n_rows"))


@query(f"""
WITH {_ITEMS} SELECT doc_id, CASE WHEN seq <= 4 THEN seq ELSE 1000000 + seq END AS seq, 'kg:' || seq AS node_id,
  CASE WHEN seq = 1 OR (seq <= 4 AND seq % 2 = 0) THEN CASE WHEN seq % 2 = 0 THEN 'old' ELSE '' END ELSE 'new' END AS label, CASE WHEN seq = 1 THEN '' WHEN seq <= 4 AND seq % 3 = 0 THEN 'a' ELSE 'b' END AS same_as FROM i""")
def merge_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MRG-06: blank labels and empty lists are filled."""
    n = F.col("seq")
    i = _items(spark, sf_dir).withColumn("node_id", F.concat(F.lit("kg:"), n.cast("string")))
    none = F.array().cast("array<string>")
    old = i.where("seq <= 4").withColumn("label", F.when(n % 2 == 0, "old").otherwise("")).withColumn("same_as", F.when(n % 3 == 0, F.array(F.lit("a"))).otherwise(none))
    new = i.where("seq >= 2").withColumn("label", F.lit("new")).withColumn("same_as", F.array(F.lit("b")))
    return merge.nodes(old, new).withColumn("same_as", F.array_join("same_as", "|"))


@query(f"""
WITH {_ITEMS} SELECT doc_id, CASE WHEN seq <= 4 THEN seq ELSE 1000000 + seq END AS seq, 'n' || seq AS src, 'n' || seq + 1 AS dst, 'uses' AS type, CASE WHEN seq = 1 THEN 0.25 ELSE 0.75 END::DOUBLE AS weight FROM i""")
def merge_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MRG-06: the new properties of an edge win."""
    node = lambda k: F.concat(F.lit("n"), (F.col("seq") + k).cast("string"))
    i = _items(spark, sf_dir).select("doc_id", "seq", node(0).alias("src"), node(1).alias("dst"), F.lit("uses").alias("type"))
    return merge.edges(i.where("seq <= 4").withColumn("weight", F.lit(0.25)), i.where("seq >= 2").withColumn("weight", F.lit(0.75)))


@query(f"""
WITH {_ITEMS} SELECT doc_id, CASE WHEN seq <= 4 THEN seq ELSE 1000000 + seq END AS seq, seq::INT AS step_number, CASE WHEN seq = 1 THEN 'Mix' ELSE 'Mix well' END AS name FROM i""")
def merge_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MRG-07: steps meet by number."""
    i = _items(spark, sf_dir).withColumn("step_number", F.col("seq").cast("int"))
    return merge.procedures(i.where("seq <= 4").withColumn("name", F.lit("Mix")), i.where("seq >= 2").withColumn("name", F.lit("Mix well")))


@query("""
SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 3 = 0 THEN 'doc:2024-b' ELSE 'doc:2020-a' END AS id, CASE WHEN c_custkey % 2 = 0 THEN 'Report on ' || c_mktsegment || ' at length' ELSE 'Report on ' || c_mktsegment END AS name,
  CASE WHEN c_custkey % 5 = 0 THEN 'Old House' ELSE 'New House' END AS publisher, c_mktsegment || '|trade' AS keywords FROM customer""")
def merge_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MRG-10: the longer name, a dated id, the new publisher unless blank, keywords of both."""
    k, m = F.col("c_custkey"), F.col("c_mktsegment")
    c = t(spark, sf_dir, "customer")
    doc = lambda i, name, publisher, words: c.select(k.alias("doc_id"), i.alias("id"), name.alias("name"), publisher.alias("publisher"), F.lit("2024-01-01").alias("date_published"), words.alias("keywords"))
    title = F.concat(F.lit("Report on "), m)
    old = doc(F.when(k % 3 == 0, "doc:undated-a").otherwise("doc:2020-a"), title, F.lit("Old House"), F.array(m))
    new = doc(F.lit("doc:2024-b"), F.when(k % 2 == 0, F.concat(title, F.lit(" at length"))).otherwise("Report"), F.when(k % 5 == 0, " ").otherwise("New House"), F.array(F.lower(m), F.lit("trade")))
    return merge.documents(old, new, ("name",)).select("doc_id", "id", "name", "publisher", F.array_join("keywords", "|").alias("keywords"))


@query("""
SELECT c_custkey, c_name || ' of 3.5' AS plain, 'THE ' || c_mktsegment AS spaced, 'Report on ' || replace(c_name, '#', ' ') AS title, 'We study ' || c_mktsegment || '.' || chr(10) || 'It grows.' AS abstract FROM customer""")
def front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-03 to STR-06: cleaned text, title and abstract, whole."""
    plain = text.sanitize_for_extraction(F.concat(F.lit("## DATA TABEL / METRIK SPESIFIK: **"), F.col("c_name"), F.lit("** of 3 . 5")))
    title = text.clean_title(F.concat(F.lit('"SMITH et al: Report on '), F.col("c_name"), F.lit(', Ann Lee"')), F.array(F.lit("Ann Lee")))
    abstract = text.clean_abstract(F.concat(F.lit("Copyright 2024 Wiley\nAbstract: We study "), F.col("c_mktsegment"), F.lit(".\nIt grows.\nKeywords: a, b\n1. Introduction\nMore")))
    c = spread(t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"))
    return c.select("c_custkey", plain.alias("plain"), text.fix_title_spacing(F.concat(F.lit("THE"), F.col("c_mktsegment"))).alias("spaced"), title.alias("title"), abstract.alias("abstract"))


@query("""
SELECT o_orderkey AS doc_id, 'Table 1. Status' AS caption, 'key|status|note' AS headers, o_orderkey || '|' || o_orderstatus || '|late twice;x|' || o_orderpriority || '|' AS cells FROM orders""")
def flat_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-26: columns set apart by tabs or two spaces; long rows are joined at the end, short ones filled."""
    o = t(spark, sf_dir, "orders")
    body = F.concat(F.lit("Table 1. Status\nkey\tstatus\tnote\n"), F.col("o_orderkey").cast("string"), F.lit("\t"), F.col("o_orderstatus"), F.lit("\tlate\ttwice\nx  "), F.col("o_orderpriority"))
    rows = o.select(F.col("o_orderkey").alias("doc_id"), F.lit(0).cast("long").alias("chunk_seq"), F.lit(1).alias("page_idx"), F.lit("table").alias("chunk_type"), body.alias("text"))
    got = tables.flat_tables(spread(rows))
    return got.select("doc_id", "caption", F.array_join("headers", "|").alias("headers"), F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), ";").alias("cells"))


@query("""
SELECT count(*) AS n_docs, round(avg(o_orderkey % 100), 1) AS avg_score, round(avg((o_orderkey % 8) / 4.0), 2) AS avg_seconds, sum(o_orderkey % 7)::BIGINT AS n_citations, sum(o_orderkey % 3)::BIGINT AS n_sections FROM orders""")
def corpus_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-10: totals over reports."""
    k = F.col("o_orderkey")
    return validate.corpus_totals(t(spark, sf_dir, "orders").select((k % 100).alias("score"), ((k % 8) / 4.0).alias("seconds"), (k % 7).alias("n_citations"), (k % 3).alias("n_sections")))


@query("""
SELECT c_custkey, concat_ws('|', CASE WHEN c_custkey % 2 = 0 THEN 'date' END, CASE WHEN c_custkey % 3 = 0 THEN 'author' END, CASE WHEN c_custkey % 5 = 0 THEN 'doi' END) AS missing FROM customer""")
def missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL-05: what a complete record lacks."""
    k, none = F.col("c_custkey"), F.array().cast("array<string>")
    got = validate.missing_fields(F.when(k % 2 > 0, "2024"), F.when(k % 3 == 0, none).otherwise(F.array("c_name")), F.when(k % 5 == 0, " ").otherwise("10.1/x"))
    return t(spark, sf_dir, "customer").select("c_custkey", F.array_join(got, "|").alias("missing"))


@query(f"""
WITH {_ITEMS} SELECT doc_id, seq, CASE WHEN seq <= 4 THEN 'given ' || seq ELSE 'own' END AS summary, CASE WHEN seq <= 4 THEN 1 ELSE 0 END AS n_points FROM i""")
def section_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-01: sections meet the first given one of their name."""
    n = F.col("seq").cast("string")
    i = _items(spark, sf_dir)
    none = F.array().cast("array<string>")
    found = i.select("doc_id", "seq", F.concat(F.lit("Topic "), n).alias("section_name"), F.lit("own").alias("summary"), none.alias("key_points"))
    given = i.where("seq <= 4").select("doc_id", "seq", F.concat(F.lit("TOPIC "), n).alias("section_name"), F.concat(F.lit("given "), n).alias("summary"), F.array(n).alias("key_points"))
    later = given.withColumn("seq", F.col("seq") + 100).withColumn("summary", F.lit("later"))
    return outline.take_summaries(found, given.unionByName(later)).select("doc_id", "seq", "summary", F.size("key_points").alias("n_points"))


@query(f"""
WITH {_ITEMS} SELECT doc_id, CASE WHEN seq <= 5 THEN seq ELSE 1000000 + seq END AS seq, CASE WHEN seq % 2 = 0 THEN seq || '. Topic ' || seq ELSE 'Part ' || seq || ' methods and data' END AS section_name,
  CASE WHEN seq <= 5 THEN 's' ELSE '' END AS summary, (seq + 10)::INT AS page_start FROM i""")
def heading_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-02, STR-24: headings meet sections by number or by the beginning of their names; others are added."""
    n, even = F.col("seq").cast("string"), F.col("seq") % 2 == 0
    i = _items(spark, sf_dir)
    name = F.when(even, F.concat(n, F.lit(". Topic "), n)).otherwise(F.concat(F.lit("Part "), n, F.lit(" methods and data")))
    headings = i.select("doc_id", "seq", (F.col("seq") + 10).cast("int").alias("page"), name.alias("heading"))
    old = F.when(even, F.concat(n, F.lit(". Old"))).otherwise(F.concat(F.lit("Part "), n, F.lit(" methods")))
    return outline.resolve_pages(headings, i.where("seq <= 5").select("doc_id", "seq", old.alias("section_name"), F.lit("s").alias("summary"), F.lit(1).alias("page_start")))


@query("""
SELECT (SELECT count(*) FROM customer) AS n_files, (SELECT count(*) FROM orders) AS n_chunks, (SELECT count(DISTINCT o_custkey) FROM orders) AS n_chunked, (SELECT count(*) FROM supplier) AS n_documents, (SELECT count(*) > 0 FROM orders) AS indexed""")
def store_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-15."""
    return validate.store_counts(t(spark, sf_dir, "customer"), t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id")), t(spark, sf_dir, "supplier"))


@query("""
SELECT o_custkey AS doc_id, o_orderkey AS chunk_seq, o_orderkey % 2 = 0 AND EXISTS (SELECT 1 FROM orders r WHERE r.o_orderstatus = 'F' AND r.o_custkey = o.o_custkey AND r.o_orderpriority = o.o_orderpriority) AS flat_capture FROM orders o""")
def captured_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHK-11: tables that hold a region cut out of the same document's pages."""
    o = t(spark, sf_dir, "orders").withColumnsRenamed({"o_custkey": "doc_id", "o_orderkey": "chunk_seq"})
    text = F.concat(F.lit("DATA TABEL 1: "), F.col("chunk_seq").cast("string"), F.lit("\nstatus | "), F.col("o_orderpriority"))
    rows = o.select("doc_id", "chunk_seq", F.when(F.col("chunk_seq") % 2 == 0, "table").otherwise("paragraph").alias("chunk_type"), text.alias("text"))
    return chunks.mark_captured(rows, o.where("o_orderstatus = 'F'").select("doc_id", F.col("o_orderpriority").alias("region"))).select("doc_id", "chunk_seq", "flat_capture")


@query("""
SELECT c_custkey, '{"@type":["Article"],"name":"' || c_name || '","author":[{"name":"' || c_mktsegment || '"}],"@context":"https://schema.org"}' AS json FROM customer""")
def schema_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL-06, FIL-07: the keys of Schema.org, and nothing empty at any depth."""
    raw = F.concat(F.lit('{"schema_json_ld": {"@type": ["Article"], "name": "'), F.col("c_name"), F.lit('", "description": "", "junk": 1, "author": [{"name": "'), F.col("c_mktsegment"), F.lit('", "x": null, "y": [[], [""]]}, {}], "hasPart": [], "about": {"a": {}}}}'))
    return t(spark, sf_dir, "customer").select("c_custkey", export.schema_org(raw).alias("json"))


@query("""
SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 2 = 0 THEN 'Trade in ' || c_mktsegment || ' by year' ELSE 'Trade in ' || c_mktsegment END AS headline, 'CC BY 4.0' AS license, 'Report' AS genre, '2024-05-01' AS date_published FROM customer""")
def merge_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MRG-10: of the ten fields the longer value counts, of equal ones the stored one."""
    c, k, title = t(spark, sf_dir, "customer"), F.col("c_custkey"), F.concat(F.lit("Trade in "), F.col("c_mktsegment"))
    old = c.select(k.alias("doc_id"), title.alias("headline"), F.lit("").alias("license"), F.lit("Report").alias("genre"), F.lit("2024").alias("date_published"))
    new = c.select(k.alias("doc_id"), F.when(k % 2 == 0, F.concat(title, F.lit(" by year"))).otherwise("Trade").alias("headline"), F.lit("CC BY 4.0").alias("license"), F.lit("Thesis").alias("genre"), F.lit("2024-05-01").alias("date_published"))
    return merge.documents(old, new)


@query("""
SELECT c_custkey::VARCHAR AS file_name, 20 + CASE WHEN c_custkey % 3 = 0 THEN 20 ELSE 10 END + CASE WHEN c_custkey % 2 = 0 THEN 20 ELSE 10 END + CASE WHEN c_custkey % 5 = 0 THEN 20 ELSE 0 END AS score FROM customer""")
def stored_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL-01 over stored JSON-LD."""
    k = F.col("c_custkey")
    body = F.concat(
        F.lit('{"@context": "https://schema.org", "@type": '), F.when(k % 3 == 0, '"Article"').otherwise('["Thing"]'), F.lit(', "name": "'), F.col("c_name"), F.lit('", "description": "A study of '), F.col("c_mktsegment"),
        F.when(k % 2 == 0, " and what is near it").otherwise(""), F.lit('", "keywords": "a, b"'), F.when(k % 5 == 0, ', "citation": ["x"]').otherwise(""), F.lit("}"),
    )
    files = t(spark, sf_dir, "customer").select(k.cast("string").alias("file_name"), F.parse_json(body).alias("root"))
    return validate.json_checks(files).select("file_name", "score")


@query("""
SELECT s_suppkey AS doc_id, '{"@context":"https://schema.org","@type":["Article"],"@id":"doc:' || s_suppkey || '","name":"Supply & demand of ' || s_name || '","headline":"Supply & demand of ' || s_name || '","description":"Line one\\nline \\"two\\"","inLanguage":"en","datePublished":"2024-05-01","publisher":{"@type":"Organization","name":"Wiley"},"keywords":["' || n_name || '","supply"],"author":[{"@type":"Person","name":"Ann ' || n_name
  || '","affiliation":[{"@type":"EducationalOrganization","name":"' || n_name || '"}]}],"identifier":[{"@type":"PropertyValue","propertyID":"DOI","value":"10.1000/' || s_suppkey || '"}],"sameAs":"https://doi.org/10.1000/' || s_suppkey || '"}' AS json FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def linked_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON-04, SNK-01: linked data of documents, made anew."""
    return export.packaged(_papers(spark, sf_dir)).select("doc_id", "json")


from scriptorium import stateful_queries  # noqa: E402, F401  they add themselves


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)
