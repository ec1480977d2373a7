import random

import corpus_pipeline


def test_stages(spark, docs, tmp_path):
    r = random.Random(9)
    words = [a + b for a in ("ta", "lo", "mer", "sin", "po") for b in ("ra", "nel", "di", "vos", "qua")]
    text = lambda n: " ".join(r.choice(words) + str(r.randrange(50)) for _ in range(n))
    passage = text(70)
    rows = [(i, text(80), f"src{i % 3}") for i in range(200)]
    toxic = [i for i in range(200) if i % 5 == 0]
    rows = [(i, t.replace(" ", " blorgscum ", 3) if i in toxic else t, s) for i, t, s in rows]
    item = text(30)
    rows += [(300, rows[1][1], "src1"), (301, rows[2][1] + " more", "src2"), (302, text(40) + " " + item + " " + text(300), "src0"), (303, text(20) + "\n" + passage, "src1"), (304, text(20) + "\n" + passage, "src1"), (305, None, "src0"), (306, text(200), None)]
    d = docs(rows)
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept, docs_now = [], d
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs_now = stage(spark, docs_now, str(tmp_path))
        assert docs_now.columns == d.columns, name
        docs_now.write.parquet(str(tmp_path / name))
        docs_now = spark.read.parquet(str(tmp_path / name))
        kept.append({x["doc_id"]: x["text"] for x in docs_now.collect()})
    assert not set(toxic) & set(kept[0]) and set(range(200)) - set(toxic) <= set(kept[0]) and 305 in kept[0]
    assert kept[1][303].endswith(passage) and passage not in kept[1][304] and kept[1][304]
    assert 301 not in kept[2] and 300 not in kept[2] and {1, 2, 303, 304, 306} <= set(kept[2])
    assert set(kept[2]) - set(kept[3]) == {302}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x["doc_id"] for x in out} == set(kept[3]) and all(x["taken"] <= 2 * x["size"] for x in out)
