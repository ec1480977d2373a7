import json
import time

import pytest
from pyspark.sql import functions as F

from scriptorium.sources import readers, sinks
from scriptorium.sources.merge_store import MergeStore, newest
from scriptorium.streaming import incremental


def test_pdf_folder_filter(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "b.pdf").write_bytes(b"no pdf")
    (tmp_path / "c.txt").write_bytes(b"%PDF")
    ok, bad = readers.pdf_files(spark, str(tmp_path))
    assert [r["file_name"] for r in ok.collect()] == ["a.pdf"]
    assert {r["file_name"]: r["reason"] for r in bad.collect()} == {"b.pdf": "no PDF content", "c.txt": "no PDF suffix"}
    pages = readers.pdf_pages(ok, lambda b: [b.decode(), "two"]).orderBy("page_idx").collect()
    assert [(r["page_idx"], r["text"]) for r in pages] == [(1, "%PDF-1.4 x"), (2, "two")]

    def broken(content):
        raise ValueError("no xref")

    r = readers.pdf_pages(ok, broken).collect()
    assert [(x["doc_id"], x["page_idx"], x["error"]) for x in r] == [("a.pdf", None, "ValueError: no xref")]


def test_chunks_are_parsed_once(spark, tmp_path):
    path, asked = str(tmp_path / "cache"), []

    def parse(files):
        asked.append(sorted(r["doc_id"] for r in files.collect()))
        return files.select("doc_id", F.lit(1).alias("chunk_seq"), F.concat("doc_id", F.lit(" text")).alias("text"))

    files = spark.createDataFrame([("a",), ("b",)], "doc_id string")
    assert readers.cached_chunks(spark, files, "plain", parse, path).count() == 2
    more = files.union(spark.createDataFrame([("c",)], "doc_id string"))
    assert readers.cached_chunks(spark, more, "plain", parse, path).count() == 3
    assert readers.cached_chunks(spark, files, "other", parse, path).count() == 2
    assert asked == [["a", "b"], ["c"], ["a", "b"]]


def test_command_line(spark, tmp_path, capsys):
    from scriptorium import cli

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"%PDF-1.4 A careful study of parts\n\nAbstract: We study parts at length and find that they differ a lot.\n\nKeywords: parts, lines")
    cli.main(["batch", str(tmp_path / "in"), str(tmp_path / "docs"), "--format", "parquet", "--store", str(tmp_path / "chunks")], lambda b: [b.decode()[9:]])
    docs = spark.read.parquet(str(tmp_path / "docs"))
    marks = {"jsonld": '"@context":"https://schema.org"', "turtle": "@prefix", "graph": '"@graph":[', "html": "application/ld+json", "cypher": "MERGE (p:Paper", "bibtex": "title ="}
    for kind, mark in marks.items():
        assert mark in "\n".join(r["text"] for r in cli.texts(docs, kind).collect())
    sinks.write_texts(cli.texts(docs, "jsonld"), "text", str(tmp_path / "jsonld"))
    capsys.readouterr()
    cli.main(["validate", str(tmp_path / "jsonld")])
    assert "context and type" in capsys.readouterr().out


def test_inventory(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"schema_json_ld": {"author": [1, 2], "hasPart": [{"@type": "CreativeWork"}, {"@type": "Table"}], "citation": ["x"]}}))
    r = readers.inventory(readers.jsonld_files(spark, str(tmp_path))).first()
    assert (r["n_authors"], r["n_sections"], r["n_tables"], r["n_citations"], r["n_metrics"]) == (2, 1, 1, 1, 0)


def test_webhook_aliases(spark):
    body = json.dumps({"event_type": "e", "context": {"name": "J"}, "submission": {"title": "T", "authors": [{"givenName": "A", "familyName": "B"}]}})
    r = readers.webhook_events(spark.createDataFrame([(body,), ("{broken",)], ["value"])).collect()
    assert (r[0]["event"], r[0]["journal"], r[0]["title"], r[0]["authors"]) == ("e", "J", "T", ["A B"]) and r[1]["title"] is None


def test_store(spark, tmp_path):
    path = str(tmp_path / "docs")
    sinks.upsert_documents(spark, spark.createDataFrame([("a", 1), ("b", 1)], "file_name string, v int"), path)
    sinks.upsert_documents(spark, spark.createDataFrame([("b", 2), ("c", 2)], "file_name string, v int"), path)
    store = MergeStore(spark, path, "file_name")
    assert {(r["file_name"], r["v"]) for r in store.read().collect()} == {("a", 1), ("b", 2), ("c", 2)}
    sinks.delete_document(spark, {"file_name": path}, "a")
    assert store.read().count() == 2


def test_chunk_store(spark, tmp_path):
    path, schema = str(tmp_path / "chunks"), "doc_id string, chunk_seq int, text string"
    sinks.replace_chunks(spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 1, "z")], schema), path)
    sinks.replace_chunks(spark.createDataFrame([("a", 1, "new")], schema), path)
    assert [tuple(r) for r in readers.stored_chunks(spark, path, "a").collect()] == [("a", 1, "new")]
    assert readers.stored_chunks(spark, path).count() == 2 and readers.stored_chunks(spark, path, "nobody").count() == 0


def test_stream_merges_and_replays(spark, tmp_path):
    source, path = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for i, rows in enumerate(([("a", 1, "x"), ("b", 1, "y")], [("a", 2, "z"), ("a", 1, "old")])):
        spark.createDataFrame(rows, "doc_id string, version int, v string").coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("doc_id string, version int, v string").parquet(str(source))
        incremental.merge_stream(stream, path, str(tmp_path / f"cp{i}"), name=f"s{i}").awaitTermination()  # the second run merges the first batch again
        time.sleep(0.1)
    assert {(r["doc_id"], r["v"]) for r in MergeStore(spark, path).read().collect()} == {("a", "z"), ("b", "y")}


def _files(path):
    return {f.relative_to(path): f.stat().st_mtime_ns for f in path.glob("data/*/*/*.parquet")}


def _add(old, new):
    return old.unionByName(new).groupBy("k").agg(F.sum("v").alias("v"))


def test_a_batch_rewrites_its_buckets_alone(spark, tmp_path):
    store = MergeStore(spark, str(tmp_path), "k", buckets=8, keep=1)
    assert store.version() is None
    assert store.merge(spark.range(200).selectExpr("id AS k", "1L AS v"), _add, 0)
    before, was = _files(tmp_path), store.version()
    assert len(was.folders) == 8
    batch = spark.range(3, 4).selectExpr("id AS k", "5L AS v")
    assert store.merge(batch, _add, 1)
    now = store.version()
    changed = {b for b in was.folders if now.folders[b] != was.folders[b]}
    assert len(changed) == 1
    kept = {f: m for f, m in before.items() if f"bucket={next(iter(changed))}" not in f.parts}
    assert kept.items() <= _files(tmp_path).items() and len(kept) >= 7
    assert store.lookup(batch).collect()[0]["v"] == 6 and store.read().count() == 200


def test_a_batch_is_merged_once_and_failures_leave_the_old_version(spark, tmp_path):
    store = MergeStore(spark, str(tmp_path), "k", buckets=4)
    one = spark.createDataFrame([("a", 1)], "k string, v long")
    assert store.merge(one, _add, 0, "s") and not store.merge(one, _add, 0, "s")
    assert store.merge(one, _add, 0, "other")

    def broken(old, new):
        return new.withColumn("v", F.raise_error(F.lit("no")).cast("long"))

    number = store.version().number
    with pytest.raises(Exception, match="no"):
        store.merge(one, broken, 1, "s")
    assert store.version().number == number and [tuple(r) for r in store.read().collect()] == [("a", 2)]
    assert store.merge(one, _add, 1, "s") and store.read().first()["v"] == 3


def test_of_two_writers_the_slower_starts_again(spark, tmp_path):
    one = spark.createDataFrame([("a", 1)], "k string, v long")
    store, other, turns = MergeStore(spark, str(tmp_path), "k"), MergeStore(spark, str(tmp_path), "k"), []

    def late(old, new):
        if not turns:
            other.merge(one, _add)
        turns.append(1)
        return _add(old, new)

    assert store.merge(one, late) and len(turns) == 2 and store.read().first()["v"] == 2


def test_store_grows_columns_deletes_and_keeps_versions(spark, tmp_path):
    store = MergeStore(spark, str(tmp_path), ["k"], buckets=4, keep=2)
    rule = newest(["k"], "v")
    store.merge(spark.createDataFrame([("a", 1), ("b", 1), (None, 7)], "k string, v long"), rule)
    store.merge(spark.createDataFrame([("a", 2, "n")], "k string, v long, note string"), rule)
    store.merge(spark.createDataFrame([("b", 0)], "k string, v long"), rule)
    assert {tuple(r) for r in store.read().collect()} == {("a", 2, "n"), ("b", 1, None), (None, 7, None)}
    assert store.read(2).count() == 3
    store.delete(spark.createDataFrame([("a",), ("zz",)], "k string"))
    assert {r["k"] for r in store.read().collect()} == {"b", None}
    assert store.merge(store.read().limit(0), rule, 9) and store.read().count() == 2


def test_elements(spark):
    e = spark.createDataFrame([("d", 1, "Title", "A", 1), ("d", 2, "Table", "| x |", None)], "doc_id string, seq int, type string, text string, page_number int")
    assert [(r["chunk_type"], r["page_idx"]) for r in readers.element_chunks(e).orderBy("chunk_seq").collect()] == [("paragraph", 1), ("table", 1)]


def test_entry_without_the_optional_parts():
    import __spark_entry__ as e

    assert "lang_detect_matrix" in e.queries() and set(e.oracle_sql()) <= set(e.queries())


def test_model_stage_defaults_to_nothing(spark):
    from scriptorium.functions import enrichment

    df = spark.createDataFrame([("p",)], ["prompt"])
    assert enrichment.model_stage(df, None).first()["answer"] is None
    assert enrichment.model_stage(df, lambda ps: ["{a: 1}"] * len(ps)).select(F.col("answer")).first()["answer"] == '{"a": 1}'
