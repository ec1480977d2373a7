import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.operators import vector_index

SCHEMA = "id long, source string, embedding array<double>"


@pytest.fixture(scope="module")
def corpus():
    r = np.random.default_rng(1)
    centres = r.normal(0, 1, (12, 16))
    x = np.concatenate([c + r.normal(0, 0.15, (60, 16)) for c in centres])
    return [(i, f"s{i % 3}", v.tolist()) for i, v in enumerate(x)] + [(9000, "s0", x[0].tolist()), (9001, "s1", (2 * x[0]).tolist())]


def brute(rows, q, k, ok=lambda s: True):
    q = np.array(q) / np.linalg.norm(q)
    s = sorted((-float(np.round(np.array(v) @ q / np.linalg.norm(v), 9)), i) for i, src, v in rows if ok(src))
    return [i for _, i in s[:k]]


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["id"])
    return out


def test_exact_pruned_and_by_source(spark, corpus, tmp_path):
    bad = [(9100, "s0", None), (9101, "s0", []), (9102, "s0", [0.0] * 16), (9103, "s0", [float("nan")] * 16)]
    vector_index.build(spark.createDataFrame(corpus + bad, SCHEMA), str(tmp_path), lists=12, part_rows=40)
    index = vector_index.load(spark, str(tmp_path))
    asked = spark.createDataFrame([(i, v) for i, _, v in corpus[::50]] + [(-1, [0.0] * 16), (-2, None)], "query_id long, query array<double>")
    got = vector_index.search(spark, index, asked, 5, probes=1)
    plan = got._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    want = {i: brute(corpus, v, 5) for i, _, v in corpus[::50]}
    assert found(got) == want
    near = found(vector_index.search(spark, index, asked, 5, probes=1, exact=False))
    assert np.mean([len(set(near[q]) & set(want[q])) / 5 for q in want]) > 0.9  # vectors in clusters
    only = found(vector_index.search(spark, index, asked, 5, payload=F.col("source") == "s1"))
    assert only == {i: brute(corpus, v, 5, lambda s: s == "s1") for i, _, v in corpus[::50]}
    # lists that can't matter aren't met: of 12 lists a query in a tight cluster needs few
    units = asked.select("query_id", vector_index.unit(F.col("query")).alias("q")).where("q IS NOT NULL")
    low = vector_index._lists_of(units, index).where("low < 0.4").groupBy("query_id").count().agg(F.avg("count")).first()[0]
    assert low < 4


def test_nothing_to_index(spark, tmp_path):
    index = vector_index.build(spark.createDataFrame([(1, "s", None)], SCHEMA), str(tmp_path))
    asked = spark.createDataFrame([(1, [1.0])], "query_id long, query array<double>")
    assert vector_index.search(spark, index, asked).count() == 0
