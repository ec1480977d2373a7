import numpy as np
from pyspark.sql import functions as F

from scriptorium.llm import graph_ann


def test_recall_ties_and_bad_vectors(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(600, 8)) * r.uniform(0.5, 2, (600, 1))
    x[100:160] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(2000, None), (2020, [0.0] * 8), (2040, [float("nan")] * 8), (2060, [1.0, None]), (2080, [float("inf")] * 8), (None, x[0].tolist()), (2001, [])]
    df = spark.createDataFrame(rows + bad + [rows[20]], "vec_id long, embedding array<double>").withColumn("v", F.lit(1))
    p = graph_ann.Params(shard_rows=150, query_rows=7)
    out = graph_ann.nearest(df, F.col("vec_id") % 20 == 0, p=p).collect()
    got = {}
    for o in sorted(out, key=lambda o: (o["query_id"], o["rank"])):
        got.setdefault(o["query_id"], []).append((o["rank"], o["vec_id"], o["score"]))
    assert set(got) == set(range(0, 600, 20))
    hits = 0
    for q, found in got.items():
        s = x @ x[q]
        order = [i for i in sorted(range(600), key=lambda i: (-(x[i] * x[q]).sum(), i)) if i != q][:20]
        assert [f[0] for f in found] == list(range(1, 21)) and all(abs(f[2] - s[f[1]]) < 1e-12 for f in found)
        assert [(-f[2], f[1]) for f in found] == sorted((-f[2], f[1]) for f in found)
        hits += len({f[1] for f in found} & set(order))
    assert hits / (20 * len(got)) >= 0.95
    near = graph_ann.nearest(df, F.col("vec_id") % 20 == 0, p=graph_ann.Params(shard_rows=150, probes=3)).collect()
    assert {o["query_id"] for o in near} == set(got) and all(abs(o["score"] - x[o["vec_id"]] @ x[o["query_id"]]) < 1e-12 for o in near)
    uneven = spark.createDataFrame([(20, [1.0, 2.0]), (1, [1.0]), (2, [0.5, 0.0, 9.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r["vec_id"], r["score"]) for r in graph_ann.nearest(uneven, F.col("vec_id") == 20).orderBy("rank").collect()] == [(3, 2.0), (1, 1.0), (2, 0.5)]
    few = graph_ann.nearest(df.where("vec_id < 5"), F.col("vec_id") == 0, p=p).collect()
    assert len(few) == 4
    assert graph_ann.nearest(df.limit(0), F.col("vec_id") == 0).count() == 0
