"""What costs most in an expression stands in it once, and joins of what grows with the rows aren't broadcast."""

from pyspark.sql import functions as F

from scriptorium.functions import authors, bibliography, metadata, text
from scriptorium.operators import graph, merge, metrics, outline, tables, validate
from scriptorium.queries import spread
from scriptorium.session import dealt


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def times(spark, column, sign):
    return optimized(spark.range(1).select(F.col("id").cast("string").alias("c")).repartition(1).select(column(F.col("c")).alias("v"))).count(sign)


def test_parts_of_expressions_stand_once(spark):
    assert times(spark, metadata.keywords, "```") == 1
    assert times(spark, text.clean_abstract, "```") == 1
    assert times(spark, text.clean_title, "```") == 1
    assert times(spark, metadata.language, "[^\\p{L}\\p{N}_]+") == 1
    assert times(spark, bibliography.references, "<[^>]+>") == 1
    assert times(spark, lambda c: metrics.extract_metrics(c, F.lit(1)), "\\[\\s*\\d+") == 1
    assert times(spark, lambda c: F.array(*[F.to_json(F.struct(x)) for x in outline.sort_key(c, F.lit(1))]), "^[\\d.]*") == 1


def test_strip_takes_all_white_space(value):
    assert value(text.strip, "　\x85 a  b\t\n  ") == "a  b"


def test_names_are_cleaned_once_in_refine(spark):
    m = spark.createDataFrame([(1, 1, "the **accuracy** of Alpha", "1,25", "", "Halaman 3", 3)], "doc_id long, seq long, name string, value string, unit string, context string, page int")
    got = metrics.refine(m.repartition(1))
    assert optimized(got).count("attributed") == 1  # the list of edge words
    assert got.first()["name"] == "accuracy of Alpha"


def test_keyless_rows_take_no_second_pass(spark):
    rows = spark.createDataFrame([(1, 1, "", "a"), (1, 2, "", "b"), (1, 3, "n", "c")], "doc_id long, seq long, node_id string, label string").repartition(1)
    got = merge.nodes(rows, rows)
    assert optimized(got).count("LogicalRDD") + optimized(got).count("LocalRelation") == 2
    assert sorted((r["seq"], r["label"]) for r in got.collect()) == [(1, "a"), (2, "b"), (3, "c"), (1_000_001, "a"), (1_000_002, "b")]


def test_claims_are_merged_not_broadcast(spark):
    c = spark.createDataFrame([(1, 0, "x", "Sensors increase river water flow rates"), (1, 1, "x", "Sensors decrease river water flow rates")], "doc_id long, seq long, tag string, text string")
    got = graph.antonym_conflicts(c)
    assert "BroadcastHashJoin" not in physical(got) and "increase" in {r["word"] for r in got.collect()}
    docs = spark.createDataFrame([(1, "d", ["a"], ["b"])], "doc_id long, description string, keywords array<string>, entities array<string>")
    sections = c.select("doc_id", "seq", F.lit("s").alias("section_name"), F.col("text").alias("summary"), F.lit(1).alias("page_start"))
    m = spark.createDataFrame([(1, 0, "n", "1", "%", "", 1)], "doc_id long, seq long, name string, value string, unit string, context string, page int")
    nodes = spark.createDataFrame([(1, "k")], "doc_id long, node_id string")
    got = validate.adversarial(docs, sections, m, nodes)
    assert "Broadcast" not in physical(got) and got.first()["n_antonyms"] == 1


def test_a_small_file_is_spread(spark):
    assert spread(spark.range(10).repartition(5)).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_lines_of_authors_tables_and_publishers_are_taken_apart_once(spark):
    assert times(spark, authors.scores, "graduate") == 1  # the pattern of members
    assert times(spark, lambda c: tables.parse_markdown(c, F.lit(1), F.lit("en")), "^[|\\s\\-:]+$") == 1
    assert times(spark, metadata.publisher, "Inderscience") == 1 and times(spark, metadata.publisher, "transactions") == 1
    assert times(spark, lambda c: metadata.parse_date(F.reverse(c)), "reverse(") == 1


def test_fragments_are_looked_at_once_and_cleaned_as_before(spark):
    rows = [
        (1, 1, "Table 1. 5 of  ﬁve", 1, ["*A*", " b:"], [["x  y", None], ["<b>1</b>", "- 2"]]),
        (1, 2, "Table 1. 5 of five", 2, ["A", "b"], [["a", "B"], ["p ", "q"], ["a", "c"]]),
        (2, 1, None, 1, ["A ", "b"], [[" 1", "2;"], [None, "3"]]),
        (3, 1, "**Tabel 2**: Parts", 1, ["Part", "n"], []),
        (4, 1, "Table 3. Plain parts", 1, ["Part", "n"], [["a", "1"]]),
    ]
    f = spark.createDataFrame(rows, "doc_id long, seq long, caption string, page_number int, headers array<string>, rows array<array<string>>")
    got = tables.consolidate(f.repartition(2))
    assert {r["doc_id"]: (r["caption"], r["headers"], r["rows"], r["page_number"]) for r in got.collect()} == {
        1: ("Table 1.5 of five", ["A", "b"], [["x y", ""], ["1", "2"], ["p", "q"], ["a", "c"]], 2),
        2: ("Table Data", ["A", "b"], [["1", "2"], ["", "3"]], 1),
        3: ("Table 2: Parts", ["Part", "n"], [], 1),
        4: ("Table 3. Plain parts", ["Part", "n"], [["a", "1"]], 1),
    }
    assert optimized(got).count("```") == 3  # cells, headers and the caption, each cleaned in one place


def test_little_text_that_costs_much_is_dealt_over_all_cores(spark):
    got = dealt(spark.range(1000).repartition(1), "id").groupBy("id").count()
    assert got.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    assert spark.range(1000).repartition(1).groupBy("id").count().rdd.getNumPartitions() < 8


def test_quantities_are_looked_for_where_a_number_follows(value):
    names = lambda c: F.to_json(F.transform(metrics.extract_metrics(c, F.lit(1)), lambda m: F.concat(m["name"], F.lit("="), m["value"].cast("string"))))
    assert value(names, "The mass is about 5 kg. Net weight: $ ,5 kg, and speed =\n.7 m/s; this is not: a number") == value(names, "The mass is approximately 5 kg. Net weight: $ ,5 kg, and speed =\n.7 m/s; this is not: a number")
    assert "Mass=5.0" in value(names, "The mass is about 5 kg") and value(names, "what is: nothing of 7 kinds") == "[]"
