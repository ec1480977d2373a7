import pytest
from pyspark.sql import functions as F

from scriptorium.operators import chunks, export, flat, graph, merge, metrics, outline, retrieve, tables, validate
from scriptorium.plans import extract


def pages(spark, texts, doc="d"):
    return spark.createDataFrame([(doc, i + 1, str(i + 1), t) for i, t in enumerate(texts)], "doc_id string, page_idx int, page_label string, text string")


def test_running_headers_and_footers_go(spark):
    p = pages(spark, [f"JOURNAL OF THINGS\nText {i} begins here\nand ends\nfoot note line\n{i}" for i in range(1, 5)])
    lines = chunks.lines_of(p)
    assert {r["key"] for r in chunks.running_lines(lines).collect()} == {"JOURNAL OF THINGS"}
    left = [r["line"] for r in chunks.strip_running(lines).where("page_idx = 2").orderBy("line_no").collect()]
    assert left == ["Text 2 begins here", "and ends"]


def test_paragraphs_are_stitched_over_pages(spark):
    b = spark.createDataFrame([("d", 1, 0, "The implemen-"), ("d", 2, 0, "tation works well"), ("d", 3, 0, "New thought."), ("d", 3, 1, "which goes on")], "doc_id string, page_idx int, block_no int, text string")
    got = [(r["text"], r["page_span"]) for r in chunks.stitch(b).orderBy("chunk_seq").collect()]
    assert got == [("The implementation works well", [1, 2]), ("New thought.", [3]), ("which goes on", [3])]


def test_tables_are_stitched_without_repeated_headers(spark):
    t1 = "Table 1. Results\n| A | B |\n|---|---|\n| 1 | 2 |"
    t2 = "Table 1 (continued)\n| A | B |\n|---|---|\n| 3 | 4 |"
    b = spark.createDataFrame([("d", 1, 0, t1), ("d", 2, 0, t2), ("d", 2, 1, "A paragraph follows.")], "doc_id string, page_idx int, block_no int, text string")
    rows = chunks.stitch(b).orderBy("chunk_seq").collect()
    assert rows[0]["chunk_type"] == "table" and rows[0]["table_id"] == 1 and rows[0]["page_span"] == [1, 2]
    assert rows[0]["text"].endswith("| 1 | 2 |\n| 3 | 4 |") and rows[1]["chunk_type"] == "paragraph"
    assert chunks.stitch(b).select(chunks.caption_hint(F.col("text"), F.col("page_idx")).alias("h")).first()["h"] == "Table 1. Results"


def test_inline_tables_and_captions(spark):
    flat = "Some prose.\nTable 2. Values\nA  B\n1  2\n" + "word " * 20
    b = spark.createDataFrame([("d", 1, 0, flat)], "doc_id string, page_idx int, block_no int, text string")
    assert [r["text"].split("\n")[0] for r in chunks.inline_tables(b).orderBy("block_no").collect()][1] == "Table 2. Values"
    b = spark.createDataFrame([("d", 1, 0, "Table 3. Caption"), ("d", 1, 1, "| A | B |\n| 1 | 2 |")], "doc_id string, page_idx int, block_no int, text string")
    assert [r["text"] for r in chunks.merge_caption_blocks(b).collect()] == ["Table 3. Caption\n| A | B |\n| 1 | 2 |"]


def test_problem_pages_and_replacement(spark):
    c = spark.createDataFrame([("d", 1, "Table 4. Lost numbers here", "paragraph", 5), ("d", 2, "as see Table 9. Not a caption", "paragraph", 6)], "doc_id string, chunk_seq int, text string, chunk_type string, page_idx int")
    none = spark.createDataFrame([], "doc_id string, page_idx int, table_no int")
    assert [(r["page_idx"], r["table_no"]) for r in chunks.problem_pages(c, none).collect()] == [(5, 4)]


def test_choices_of_chunks(spark):
    rows = [("d", i, f"text {i}" if i != 8 else "REFERENCES\n[1] A.", "paragraph", i) for i in range(1, 11)]
    c = spark.createDataFrame(rows, "doc_id string, chunk_seq int, text string, chunk_type string, page_idx int")
    assert chunks.cover_chunks(c).count() == 2
    assert [r["chunk_seq"] for r in chunks.bibliography_chunks(c).orderBy("chunk_seq").collect()] == [8, 9, 10]
    assert chunks.chunks_of(c, "nobody").count() == 10


def test_markdown_table(spark):
    body = "Table 2. Growth of\nthe market\n| Year | Value |\n|---|---|\n| 2020 | **5** |\n| 2021 | 6 |"
    t = spark.createDataFrame([(body,), ("Figure 1. X\n| A | B |\n| 1 | 2 |",), ("| x | y |\n|--|--|\n| 1 | 2 |\n| 3 | 4 |",)], "t string").select(tables.parse_markdown(F.col("t"), F.lit(3), F.lit("en")).alias("p")).collect()
    assert t[0]["p"]["caption"] == "Table 2. Growth of the market" and t[0]["p"]["rows"] == [["2020", "5"], ["2021", "6"]]
    assert t[1]["p"] is None and t[2]["p"] is None


def test_table_fragments_stay_apart_over_page_gaps(spark):
    rows = [("d", 1, "Table 1. X", 2, ["A", "B"], [["1", "2"]]), ("d", 2, "Table 1. X", 3, ["A", "B"], [["A", "b "], ["3", "4"]]), ("d", 3, "Table 1. X", 10, ["A", "B"], [["5", "6"]])]
    f = spark.createDataFrame(rows, "doc_id string, seq int, caption string, page_number int, headers array<string>, rows array<array<string>>")
    got = [(r["page_number"], r["rows"]) for r in tables.consolidate(f).orderBy("first_seq").collect()]
    assert got == [(3, [["1", "2"], ["3", "4"]]), (10, [["5", "6"]])]
    assert f.select(tables.is_descriptive(F.array(F.lit("Strength"), F.lit("x")), F.col("rows")).alias("d")).first()["d"]


def test_flat_table():
    assert flat.parse("Table 1. T\nA  B  C\n1  2  3  4\n5  6") == ("Table 1. T", ["A", "B", "C"], [["1", "2", "3 4"], ["5", "6", ""]])
    assert flat.parse("Just one line") is None and flat.parse("") is None and flat.parse("Table 2. Prose\nwithout any columns\nthat one could see") is None


def test_flat_table_with_single_spaces():
    text = "Table 2. Grasping\nMethod Success rate Time\nRandom Forest 91.2 3.4\nNet 88.0% 12\nDeep Q Network 70.5 n/a\nOurs 99.1"
    assert flat.parse(text) == (
        "Table 2. Grasping",
        ["Method", "Success rate", "Time"],
        [["Random Forest", "91.2", "3.4"], ["Net", "88.0%", "12"], ["Deep Q Network", "70.5", "n/a"], ["Ours", "99.1", ""]],
    )
    # names all in capitals: the places of the columns decide
    assert flat.parse("Table 3. Rain\nTown Name Days Millimetres\nNorth End 120 1245.55\nEast Side 100 2266.30")[1] == ["Town Name", "Days", "Millimetres"]
    assert flat.parse("Table 7. Years\n2020 2021\n1 2\n3 4") is None


def test_flat_table_in_one_line():
    text = "Table 4. Success of grasps Method Rate Time Push 88.1% 2.9 Pull 70 3,1 Twist 12.5 9"
    assert flat.parse(text) == ("Table 4. Success of grasps", ["Method", "Rate", "Time"], [["Push", "88.1%", "2.9"], ["Pull", "70", "3,1"], ["Twist", "12.5", "9"]])
    assert flat.parse("Tabel 5: hasil uji Alat Satu 1 2 Alat Dua 3 4")[1:] == (["Item", "Column 1", "Column 2"], [["Alat Satu", "1", "2"], ["Alat Dua", "3", "4"]])
    assert flat.parse("Table 6. Nothing but words here") is None


def test_outline_is_monotonic(spark):
    rows = [(1, 1, "1. Introduction"), (2, 5, "3. Results"), (3, 2, "2. Methods"), (4, 1, "3.1 Too early"), (5, 6, "3.1 Details"), (6, 3, "IV. Late"), (7, 1, "Abstract")]
    c = spark.createDataFrame([("d", s, p, h) for s, p, h in rows], "doc_id string, seq int, page int, heading string")
    got = [r["heading"] for r in outline.monotonic_outline(c).orderBy("place").collect()]
    assert got == ["1. Introduction", "2. Methods", "3. Results", "3.1 Details", "Abstract"]


def test_heading_candidates_stop_at_references(spark):
    lines = chunks.lines_of(pages(spark, ["1. Introduction\nSome text that is prose.\n2. Methods of\nsampling\n3.2 | 4 | 5\nREFERENCES\n4. Not a heading"]))
    assert [r["heading"] for r in outline.heading_candidates(lines).orderBy("seq").collect()] == ["1. Introduction", "2. Methods of sampling"]


def test_sections_are_filtered(spark):
    rows = [(1, "1. Introduction", "", 1), (2, "References", "x", 9), (3, "section", "A summary without a name", 2), (4, "2. Methods", "A long enough summary of it", 3), (5, "Department of X, Y, 12345", "", 1)]
    s = spark.createDataFrame([("d", *r) for r in rows], "doc_id string, seq int, section_name string, summary string, page_start int")
    got = {r["section_name"]: r["summary"] for r in outline.filter_sections(s).collect()}
    assert got == {"1. Introduction": "A summary without a name", "2. Methods": "A long enough summary of it"}


def test_section_pages_from_headings(spark):
    h = spark.createDataFrame([("d", 1, 4, "2. Methods"), ("d", 2, 6, "9. New")], "doc_id string, seq int, page int, heading string")
    s = spark.createDataFrame([("d", 1, "2. Methods", "s", 1)], "doc_id string, seq int, section_name string, summary string, page_start int")
    got = {(r["section_name"], r["page_start"]) for r in outline.resolve_pages(h, s).collect()}
    assert got == {("2. Methods", 4), ("9. New", 6)}
    h = spark.createDataFrame([("d", 1, 4, "Methods and data"), ("d", 2, 5, "BAB II"), ("d", 3, 6, "Section"), ("d", 4, 7, "IV. Ends")], h.schema)
    s = spark.createDataFrame([("d", 1, "Methods", "s", 1), ("d", 2, "bab ii theory", "s", 1), ("d", 3, "iv. end", "s", 1)], s.schema)
    got = {(r["section_name"], r["page_start"]) for r in outline.resolve_pages(h, s).collect()}
    assert got == {("Methods and data", 4), ("BAB II", 5), ("IV. Ends", 7)}


def test_metrics(spark):
    text = "Efficiency = 94.5% and the pressure: 120 mmHg. Cost 0.22 €/kWh for electricity. We took 614 observation points. Received: 2020. Mass = 1,234.5 kg"
    got = spark.range(1).select(metrics.extract_metrics(F.lit(text), F.lit(2)).alias("m")).first()["m"]
    found = {(m["name"], m["value"], m["unit"]) for m in got}
    assert ("Efficiency", 94.5, "%") in found and ("Pressure", 120.0, "mmHg") in found
    assert ("Electricity", 0.22, "€/kWh") in found and ("Observation Points", 614.0, "points") in found
    assert not any(m["name"] == "Mass" or "Received" in m["name"] for m in got)


def test_formulas_and_codes(spark):
    r = spark.range(1).select(metrics.formulas(F.lit("$$a+b=c$$\nRMSE = x / n\n$$x$$")).alias("f"), metrics.technical_codes(F.lit("An ESP32-S3 and MAX485 but A1")).alias("c")).first()
    assert r["f"] == ["$$a+b=c$$", "RMSE = x / n"] and r["c"] == ["ESP32-S3", "MAX485"]


def test_graph_health_and_orphans(spark):
    n = spark.createDataFrame([("d", x) for x in "abcd"], "doc_id string, node_id string")
    e = spark.createDataFrame([("d", "a", "b"), ("d", "b", "c")], "doc_id string, src string, dst string")
    r = graph.health(n, e).first()
    assert (r["n_orphans"], r["density"], r["connectivity"], r["score"]) == (1, 0.1667, 0.5, 0.88)
    assert [x["node_id"] for x in graph.orphans(n, e).collect()] == ["d"]


def test_contradictions_and_trade_offs(spark):
    rows = [("a", 1, "t", "Methane emissions increase sharply across wetland soils"), ("a", 2, "t", "Methane emissions decrease sharply across wetland soils"), ("b", 1, "t", "Systems increase throughput under heavy network load"), ("b", 2, "t", "Systems decrease latency under heavy network load")]
    c = spark.createDataFrame(rows, "doc_id string, seq int, tag string, text string")
    assert [(r["doc_id"], r["word"]) for r in graph.antonym_conflicts(c).collect()] == [("a", "increase")]
    n = spark.createDataFrame([("a", 1, "The sensor does not measure water flow rates"), ("a", 2, "The sensor will measure water flow rates")], "doc_id string, seq int, text string")
    assert graph.negation_conflicts(n).count() == 1


def test_authorities(spark):
    from scriptorium.sources import authorities

    nodes = spark.createDataFrame([("d", "1", "kg:Organization", "Institut Teknologi Bandung", ["x"]), ("d", "2", "kg:Concept", "deep learning for PCR", None)], "doc_id string, node_id string, type string, label string, same_as array<string>")
    got = {r["node_id"]: r["same_as"] for r in graph.enrich(nodes, authorities.institutions(spark), authorities.concepts(spark)).collect()}
    assert got["1"] == ["x", "https://ror.org/04sbc6a41"] and got["2"] == ["https://www.wikidata.org/wiki/Q197536"]


def test_merging_loses_nothing(spark):
    ddl = "doc_id string, seq int, name string, affiliation string, identifier string, email string"
    old = spark.createDataFrame([("d", 1, "Ann B.", "Lab", None, None), ("d", 2, "Old", None, None, None)], ddl)
    new = spark.createDataFrame([("d", 1, "ann b", None, "0000-1", "a@b"), ("d", 2, "New", None, None, None)], ddl)
    got = {r["name"]: (r["affiliation"], r["identifier"], r["email"]) for r in merge.authors(old, new).collect()}
    assert got == {"Ann B.": ("Lab", "0000-1", "a@b"), "Old": (None, None, None), "New": (None, None, None)}
    same = merge.authors(old, old).orderBy("seq").collect()
    assert same == old.withColumn("seq", F.col("seq").cast("long")).orderBy("seq").collect()


def test_document_merge_keeps_a_dated_id(spark):
    ddl = "doc_id string, id string, name string, publisher string, keywords array<string>"
    old = spark.createDataFrame([("d", "doc:2020-01-01/x", "A", "P", ["Solar", "x1"])], ddl)
    new = spark.createDataFrame([("d", "doc:undated/x", "A longer", "Q", ["solar", "wind"])], ddl)
    r = merge.documents(old, new).first()
    assert (r["id"], r["name"], r["publisher"], r["keywords"]) == ("doc:2020-01-01/x", "A longer", "Q", ["Solar", "x1", "wind"])


def test_stored_documents_are_cleaned(spark):
    rows = [(None,), ("{broken",), ("[1]",), ('{"name": "x", "about": [[null, ""], 0, {"a": []}], "junk": 1, "@context": "c"}',), ('{"schema_json_ld": {}, "name": "y"}',)]
    got = [r["j"] for r in spark.createDataFrame(rows, "raw string").coalesce(1).select(export.schema_org(F.col("raw")).alias("j")).collect()]
    assert got == [None, None, '{"@context":"https://schema.org"}', '{"name":"x","about":[0],"@context":"c"}', '{"name":"y","@context":"https://schema.org"}']


def test_captured_regions_are_marked(spark):
    c = spark.createDataFrame([("d", 1, "table", "DATA TABEL 1: a b\nx y"), ("d", 2, "table", "a b\nz"), ("d", 3, "paragraph", "a b"), ("e", 1, "table", "a b")], "doc_id string, chunk_seq int, chunk_type string, text string")
    got = {(r["doc_id"], r["chunk_seq"]) for r in chunks.mark_captured(c, spark.createDataFrame([("d", "a b"), ("d", "a"), ("e", "")], "doc_id string, region string")).where("flat_capture").collect()}
    assert got == {("d", 2)}


def test_store_counts_of_an_empty_store(spark):
    none = spark.createDataFrame([], "doc_id string")
    assert validate.store_counts(none, none, none).first().asDict() == {"n_files": 0, "n_chunks": 0, "n_chunked": 0, "n_documents": 0, "indexed": False}


def test_scores(spark):
    r = spark.range(1).select(validate.integrity(F.lit(0), F.lit(0), F.lit(True)).alias("g"), validate.integrity(F.lit(3), F.lit(2), F.lit(False)).alias("b")).select("g", "b", validate.readiness(F.lit(75), F.col("g")).alias("r")).first()
    assert r["g"]["score"] == 100 and r["b"]["score"] == 30 and r["r"]["score"] == 88 and r["r"]["badge"] == "excellent"


def test_retrieval(spark):
    i = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.0, 1.0], "b"), (3, [1.0, 1.0], "a")], "id long, embedding array<double>, source string")
    q = spark.createDataFrame([(9, [1.0, 0.1])], "query_id long, query array<double>")
    assert [r["id"] for r in retrieve.top_k(i, q, 2).orderBy("rank").collect()] == [1, 3]
    assert [r["id"] for r in retrieve.top_k(i, q, 2, F.col("source") == "b").collect()] == [2]
    c = spark.createDataFrame([(1, "s.pdf", "200", 1, "text a"), (3, "s.pdf", "200", 2, "text c")], "id long, source string, page_label string, page_idx int, text string")
    r = retrieve.answer_context(retrieve.top_k(i, q, 2), c).first()
    assert r["context"].startswith("[1] s.pdf (p. 200)\ntext a") and r["sources"] == ["s.pdf (p. 200)"]


def test_export_strings(spark):

    row = [("d", "doc:1", ["Article"], "On Things", "An abstract", "en", "2024-05-01", "Wiley", False, "10.1/x1", ["k1"], [("Ann Bee", ["Lab"])])]
    ddl = "doc_id string, id string, type array<string>, name string, description string, in_language string, date_published string, publisher string, publisher_inferred boolean, doi string, keywords array<string>, authors array<struct<name:string,affiliations:array<string>>>"
    d = spark.createDataFrame(row, ddl)
    r = d.select(export.bibtex().alias("b"), export.ris().alias("r"), export.csl_json().alias("c")).first()
    assert r["b"].startswith("@article{bee2024on,") and "  doi = {10.1/x1}," in r["b"]
    assert "AU  - Ann Bee" in r["r"] and r["r"].endswith("ER  - \n")
    assert '"family":"Bee","given":"Ann"' in r["c"]
    ttl = export.turtle(export.turtle_lines(d)).first()["turtle"]
    assert "<doc:1> schema:author <kg:person_ann_bee_1> ." in ttl
    assert d.select(export.sparql_insert(F.lit(ttl)).alias("s")).first()["s"].startswith("PREFIX schema:")


def test_extraction_end_to_end(spark):
    p = pages(spark, ["Deep Learning for Peat\nAnn Bee, Carl Dee\nAbstract\nWe study the method of peat and the use of it in the field for this research.\nKeywords: peat, carbon\n1. Introduction\nThe accuracy = 95% in tests.", "2. Results\nTable 1. Values\n| Year | Tons |\n|---|---|\n| 2020 | 5 |\n| 2021 | 6 |", "REFERENCES\n[1] A. Writer, A study of things, 2001.\n[2] B. Writer, Another study of things, 2002.\n[3] C. Writer, A third study of things, 2003."])
    d = extract.documents(extract.chunks_of_pages(p)).first()
    assert d["in_language"] == "en" and d["name"] == "Deep Learning for Peat" and d["keywords"] == ["peat", "carbon"]
    assert len(d["citations"]) == 3 and d["metrics"][0]["value"] == 95.0
    y = extract.yields(extract.documents(extract.chunks_of_pages(p))).first()
    assert y["n_citations"] == 3 and y["n_metrics"] >= 1


def test_partition_counts_do_not_matter(spark):
    p = pages(spark, [f"Line {i} goes on\nand on." for i in range(6)])
    results = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(chunks.stitch(chunks.page_blocks(chunks.lines_of(p))).orderBy("chunk_seq").collect())
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1]


def test_reparsed_tables_find_their_pages(spark):
    schema = "doc_id string, seq int, table_nos array<int>, page_idx int"
    again = [("d", 0, [4], None), ("d", 1, [], 7), ("d", 2, [], None), ("d", 3, [4], None), ("e", 0, [1], 9), ("e", 1, [], 9), ("f", 0, [3], None), ("f", 1, [], 2), ("f", 2, [], None)]
    problems = spark.createDataFrame([("d", 5, 4), ("d", 5, 6), ("d", 7, 9), ("d", 8, 2), ("e", 3, 8), ("f", 1, 1), ("f", 2, 3)], "doc_id string, page_idx int, table_no int")
    got = {(r["doc_id"], r["seq"], r["page_idx"]) for r in chunks.match_reparsed(spark.createDataFrame(again, schema), problems).collect()}
    # d: by number, by page, by place, and nothing free; e: the only page takes all; f: by number, its named page is taken and so is its place
    assert got == {("d", 0, 5), ("d", 1, 7), ("d", 2, 8), ("e", 0, 3), ("e", 1, 3), ("f", 0, 2)}


def test_pairs_arise_only_where_words_can_suffice(spark):
    from scriptorium.operators import overlap

    common = ["c1", "c2", "c3"]
    rows = [("d", i, [*common, f"own{i}", f"pair{i // 2}"]) for i in range(60)] + [("d", 100, None), ("d", 101, []), ("e", 1, [*common, "x"]), ("e", 2, [*common, "x", "x"])]
    sets = spark.createDataFrame(rows, "doc_id string, seq int, words array<string>")
    got = {(r["doc_id"], r["a"], r["b"], len(r["shared"])) for r in overlap.overlapping(sets, 4).collect()}
    assert got == {("d", 2 * i, 2 * i + 1, 4) for i in range(30)} | {("e", 1, 2, 4)}
    firsts = overlap.rare_prefixes(sets, 4)
    # of 60 * 59 / 2 pairs that share common words, 31 are compared
    assert overlap.candidates(firsts, 4).count() == 31
    assert overlap.candidates(firsts, 4, split=1).count() == 31
    assert overlap.overlapping(sets, 3).count() == 60 * 59 // 2 + 1


def test_a_claim_with_several_opposites_and_words_over_the_edge(spark):
    text = ["More pressure makes higher yields in reactor vessels", "Less pressure makes lower yields in reactor vessels", "Reactor vessels whose pressure yields increase", "Decrease in pressure of reactor vessels cut yields"]
    c = spark.createDataFrame([("a", i, "t", x) for i, x in enumerate(text)], "doc_id string, seq int, tag string, text string")
    got = {(r["seq_a"], r["seq_b"], r["word"], r["antonym"]) for r in graph.antonym_conflicts(c).collect()}
    # `increase` ends its claim, so the word behind it is the first of the next one
    assert got == {(0, 1, "more", "less"), (0, 1, "higher", "lower"), (2, 3, "increase", "decrease")}


def test_graph_json(spark):
    import json

    d = spark.createDataFrame([("d", "doc:1", ["Article"], "On Things", "An abstract", [("Ann Bee",)])], "doc_id string, id string, type array<string>, name string, description string, authors array<struct<name:string>>")
    n = spark.createDataFrame([("d", 1, "kg:a", "kg:Concept", "a")], "doc_id string, seq int, node_id string, type string, label string")
    e = spark.createDataFrame([("d", 1, "kg:a", "kg:b", "causes")], "doc_id string, seq int, src string, dst string, type string")
    g = json.loads(export.json_graph(d, n, e).first()["json"])["@graph"]
    assert [x["@id"] for x in g] == ["doc:1", "kg:person_ann_bee", "kg:a", "kg:a"] and g[3]["statement"] == {"kg:causes": {"@id": "kg:b"}}


def test_flat_tables_reach_documents(spark):
    """Tables of columns set apart by white space, in a document of their own and beside one with bars. Adjacent tables are one."""
    page = "Stock of goods in the year 2020\n\nTable 1. Stock by month\nmonth\tstock\tprice\nMay\t12\t3\nJune\t14\t4"
    bars = "Table 2. Bars\n| x name | y name |\n| --- | --- |\n| 1 | 2 |\n| 3 | 4 |"
    p = spark.createDataFrame([("a", 1, page), ("b", 1, page), ("b", 2, "A page of words stands between these two tables."), ("b", 3, bars)], "doc_id string, page_idx int, text string")
    got = {r["doc_id"]: [(t["caption"], t["rows"]) for t in r["tables"] or []] for r in extract.documents(extract.chunks_of_pages(p)).select("doc_id", "tables").collect()}
    flat = ("Table 1. Stock by month", [["May", "12", "3"], ["June", "14", "4"]])
    assert flat in got["a"]
    assert flat in got["b"] and len(got["b"]) == 2


def test_numbers_of_a_run(spark):
    from scriptorium.plans import extract
    from scriptorium.plans.progress import Stages

    rows = [("a", 1, "A Study of Rivers\nin the North\nAnn Lee\nUniversity of X\n\nAbstract\nWe study rivers and what they carry along.\n\n1. Introduction\nThe efficiency = 94.5% was found."), ("a", 2, "2. Methods\nWe measured.\n\nTable 1. Flow\n| River | Flow |\n|---|---|\n| a | 1 |\n| b | 2 |"), ("b", 1, None)]
    stages = Stages()
    docs = extract.documents(extract.chunks_of_pages(spark.createDataFrame(rows, "doc_id string, page_idx int, text string")), stages=stages).collect()
    got = stages.report()
    assert [d["doc_id"] for d in docs] == ["a"]
    assert got["chunks"] == {"rows": 3, "tables": 1}
    assert got["tables"] == {"rows": 1, "without_bars": 0} and got["quantities"]["rows"] >= 1
    assert got["headings"]["rows"] >= got["sections"]["rows"] >= 2
    assert got["documents"] == {"rows": 1, "untitled": 0, "undated": 1, "without_authors": 0}
    with pytest.raises(ValueError):
        stages.watch(spark.range(1), "chunks")


def test_json_is_coerced_and_what_does_not_fit_is_told(spark):
    from scriptorium.operators import coerce

    bodies = ['{"title": "T", "authors": ["A", {"name": "B", "@type": "Organization"}], "score": "12,5 %", "tags": "one"}', '{"name": {"x": 1}, "author": [{"role": 1}], "score": [1], "extra": 1}', '{"name": null, "headline": "H"}', "[1, 2]", None]
    rows = spark.createDataFrame(list(enumerate(bodies)), "id int, j string").select("id", F.try_parse_json("j").alias("v"))
    fields = {"name": "string", "author": "people", "keywords": "array<string>", "score": "double", "description": "string"}
    seen = coerce.observed(rows.where("id < 3"))
    assert {"title", "headline", "extra"} <= set(seen) and coerce.plan(fields, seen)["description"] == []
    fits, lost = coerce.coerced(rows, fields, ["id"], names=coerce.plan(fields, seen))
    got = {r["id"]: (r["name"], [tuple(a) for a in r["author"] or []], r["keywords"], r["score"], r["description"]) for r in fits.collect()}
    assert got[0] == ("T", [("Person", "A"), ("Organization", "B")], ["one"], 12.5, None)
    assert got[1] == (None, [], None, None, None) and got[2] == ("H", [], None, None, None) and got[3] == got[4] == (None, [], None, None, None)
    assert {(r["id"], r["field"], r["value"]) for r in lost.collect()} == {(1, "name", '{"x":1}'), (1, "author", '[{"role":1}]'), (1, "score", "[1]")}
    with pytest.raises(ValueError):
        coerce.coerced(rows, {"name": "date"}, ["id"])
