import io
from contextlib import redirect_stdout
from functools import reduce

import numpy as np
from pyspark.sql import functions as F

from scriptorium.operators import retrieve, vector_index
from scriptorium.operators.nearest import nearest


def plan(df):
    with redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def test_blocks_give_what_all_pairs_give(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(60, 8)).astype(np.float32).astype(float).tolist()
    x = x + x[:20] + [x[0]] * 10  # copies, whose order is by id alone
    rows = [(i, v) for i, v in enumerate(x)] + [(900, [1.0, 2.0]), (901, None), (902, [0.0] * 8)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    asked = df.where("id % 7 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    found = retrieve.top_k(df, asked, 5, max_queries=4)
    assert "NestedLoop" not in plan(found) and "CartesianProduct" not in plan(found)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["score"]))

    def cosine(a, b):
        dot = lambda u, v: reduce(lambda s, pq: s + pq[0] * pq[1], zip(u, v, strict=True), 0.0)  # noqa: E731  in order; sum() would compensate
        return dot(a, b) / (np.sqrt(dot(a, a)) * np.sqrt(dot(b, b)))

    x = {i: np.array(v, dtype=np.float32).astype(float).tolist() for i, v in enumerate(x)}
    for q in (i for i in x if i % 7 == 0):
        assert got[q] == sorted(((i, cosine(v, x[q])) for i, v in x.items()), key=lambda p: (-p[1], p[0]))[:5]
    sized = lambda d, v, n: d.select(F.lit(1).alias("key"), *[c for c in d.columns if c != v], F.col(v).alias("v" if n == "n" else "q"), F.lit(1.0).alias(n))
    whole = df.where("id < 900")
    small = nearest(sized(whole, "embedding", "n"), sized(asked.where("query_id < 900"), "query", "qn"), "key", 3, part_rows=16, block_queries=3)
    assert small.groupBy("query_id").count().agg(F.min("count")).first()[0] >= 9  # three rows of each of several blocks


def test_index_search_multiplies_blocks(spark, tmp_path):
    rows = [(i, "s", [float(i % 5 + 1), float(i % 3), 1.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, source string, embedding array<double>")
    index = vector_index.build(df, f"file://{tmp_path}/index", lists=4)
    asked = df.where("id < 3").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    found = vector_index.search(spark, index, asked, 4)
    assert "FlatMapCoGroupsInArrow" in plan(found) and [r["id"] for r in found.where("query_id = 0").orderBy("rank").collect()] == [0, 15, 30, 6]
