import json
import os
import time

import pytest

from scriptorium.sources.page_source import page_source, text_pages
from scriptorium.sources.statement_sink import delivery, statement_sink


def rows(df):
    return sorted(tuple(r) for r in df.fillna("-").fillna(0).collect())


def test_text_pages():
    assert text_pages(b"one\n- 7 -\fiv\ntwo\fthree\n") == [("7", "one\n- 7 -"), ("iv", "iv\ntwo"), (None, "three\n")]


def test_an_empty_file_has_no_pages(spark, tmp_path):
    assert text_pages(b"") == []
    (tmp_path / "a.txt").write_bytes(b"")
    (tmp_path / "b.txt").write_bytes(b"one\f\ftwo\f")
    spark.dataSource.register(page_source())
    got = rows(spark.read.format("pages").load(f"file://{tmp_path}"))
    assert [(r[0], r[3]) for r in got] == [("b.txt", "one"), ("b.txt", ""), ("b.txt", "two")]


def test_a_folder_of_pages_with_a_broken_file(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"12\nfirst\fsecond")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.txt").write_bytes(b"\xff\xfe broken")
    (tmp_path / "c.txt").write_bytes("\f".join(f"page {i}" for i in range(100)).encode())
    (tmp_path / "_SUCCESS").write_bytes(b"")
    (tmp_path / "d.pdf").write_bytes(b"x")
    spark.dataSource.register(page_source())
    df = spark.read.format("pages").option("suffix", ".txt").option("taskBytes", "300").load(f"file://{tmp_path}")
    assert df.rdd.getNumPartitions() > 2  # the long file is read by several tasks
    got = rows(df)
    assert [r for r in got if r[0] == "a.txt"] == [("a.txt", 1, "12", "12\nfirst", "-"), ("a.txt", 2, "-", "second", "-")]
    assert [r[4].split(":")[0] for r in got if r[0] == "b.txt"] == ["UnicodeDecodeError"]
    assert [r[3] for r in got if r[0] == "c.txt"] == [f"page {i}" for i in range(100)]


def test_a_reader_of_the_caller_and_an_empty_folder(spark, tmp_path):
    def read(content):
        return [("xi", content.decode()[::-1])]

    spark.dataSource.register(page_source(read, "backwards"))
    assert rows(spark.read.format("backwards").load(str(tmp_path))) == []
    (tmp_path / "a.pdf").write_bytes(b"abc")
    assert rows(spark.read.format("backwards").load(str(tmp_path))) == [("a.pdf", 1, "xi", "cba", "-")]


def test_new_files_as_a_stream(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    spark.dataSource.register(page_source())

    def turn():
        stream = spark.readStream.format("pages").load(str(folder))
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out).awaitTermination()
        return spark.read.parquet(out).count()

    (folder / "a").write_bytes(b"1\f2")
    assert turn() == 2
    time.sleep(0.05)
    (folder / "b").write_bytes(b"3\f4\f5")
    assert turn() == 5 and turn() == 5


def receiver(folder, breaks=()):
    """Keeps each batch under its id, once; breaks: batch ids at which it fails, before or after it has kept them, the first time."""

    def send(batch, statements):
        path = os.path.join(folder, batch.replace("/", "_"))
        early, late = batch in breaks, batch + "!" in breaks
        flag = path + ".failed"
        if early and not os.path.exists(flag):
            open(flag, "x").close()
            raise ConnectionError("before")
        if not os.path.exists(path):
            with open(path + ".part", "w") as f:
                json.dump(statements, f)
            os.rename(path + ".part", path)
        if late and not os.path.exists(flag):
            open(flag, "x").close()
            raise ConnectionError("after")

    return send


def kept(folder):
    return [s for f in os.listdir(folder) if not f.endswith(".failed") for s in json.load(open(os.path.join(folder, f)))]


@pytest.fixture
def statements(spark):
    return spark.range(400).selectExpr("CAST(id % 40 AS STRING) AS doc_id", "CAST(id % 3 AS INT) AS block", "CAST(id AS INT) AS idx", "concat('S', id) AS statement")


def test_batches_are_tried_again(spark, statements, tmp_path):
    ended = []
    spark.dataSource.register(statement_sink(receiver(str(tmp_path), ("r/0/0", "r/1/1!")), lambda *x: ended.append(x)))
    delivery(statements, 4).write.format("statements").options(run="r", batch=7, wait=0.01).mode("append").save()
    assert sorted(kept(tmp_path)) == sorted(f"S{i}" for i in range(400))
    assert len([f for f in os.listdir(tmp_path) if f.endswith(".failed")]) == 2
    orders = [json.load(open(tmp_path / f)) for f in os.listdir(tmp_path) if not f.endswith(".failed")]
    assert max(map(len, orders)) == 7


def test_a_failed_run_is_repeated_and_nothing_is_applied_twice(spark, statements, tmp_path):
    spark.dataSource.register(statement_sink(receiver(str(tmp_path), ("r/2/3!",))))
    write = lambda: delivery(statements, 4).write.format("statements").options(run="r", batch=7, tries=1).mode("append").save()
    with pytest.raises(Exception, match="after"):
        write()
    assert 0 < len(kept(tmp_path)) < 400
    write()
    assert sorted(kept(tmp_path)) == sorted(f"S{i}" for i in range(400))


def test_a_run_needs_a_name(spark, statements):
    spark.dataSource.register(statement_sink(print))
    with pytest.raises(Exception, match="run"):
        delivery(statements).write.format("statements").mode("append").save()
