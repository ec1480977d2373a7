import random

import numpy as np
from pyspark.sql import functions as F

from scriptorium.llm import quality, toxicity


def corpus(n=160):
    r = random.Random(5)
    words = [a + b for a in ("ta", "lo", "mer", "sin", "po") for b in ("ra", "nel", "di", "vos", "qua")]
    rows, labels = [], []
    for i in range(n):
        w = [r.choice(words) for _ in range(40)]
        toxic, good = i % 4 == 0, i % 3 != 0
        if toxic:
            w[7] = "blorgscum"
        if not good:
            w = [x + "$$$" for x in w]
        rows.append((i, " ".join(w)))
        labels.append((i, int(good), int(toxic)))
    return rows, labels


def run(spark, docs, module, f, label):
    rows, labels = corpus()
    extra = [(1000, None), (1001, ""), (1002, "word " * 30000), (7, rows[7][1]), (None, "no id")]
    d = docs(rows + extra).withColumn("score", F.lit("clash")).withColumn("y", F.lit(1))
    lab = spark.createDataFrame([*labels, (5, None, None), (None, 1, 1), (3, 0, 0), (9, -3, -3), (8, 5, 7)], "doc_id long, quality int, toxic int")
    out = f(d, lab).select("doc_id", "held_out", "score", "predicted", "y").collect()
    assert len(out) == len(rows) + len(extra)
    truth = {i: x for i, *x in labels}
    held = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    right = [r["predicted"] == truth[r["doc_id"]][label] for r in held]
    assert len(held) > 20 and sum(right) / len(right) > 0.9
    assert all(0 <= r["score"] <= 1 for r in out)
    assert len({r["score"] for r in out if r["doc_id"] == 7}) == 1
    again = f(d, lab).select("doc_id", "score").collect()
    assert sorted((r["doc_id"] or -1, r["score"]) for r in again) == sorted((r["doc_id"] or -1, r["score"]) for r in out)
    none = lab.where("false")
    assert {r["score"] for r in f(docs(rows[:3]), none).collect()} == {0.5}
    assert f(docs([]).limit(0), lab).count() == 0


def test_toxicity(spark, docs):
    run(spark, docs, toxicity, lambda d, x: toxicity.score_toxicity(d, x), 1)


def test_quality(spark, docs):
    run(spark, docs, quality, lambda d, x: quality.score_quality(d, x), 0)


def test_grams_do_not_cross_texts():
    a, b = toxicity.text_buckets(["abc", "abc"], (3,), 18)
    assert (a == b).all() and len(a) == 3
    assert len(toxicity.text_buckets(["abcabc"], (3,), 18)[0]) == 5
    assert len(toxicity.text_buckets([""], (3,), 18)[0]) == 0


def test_scores_against_plain_python(spark, docs):
    rows, labels = corpus(60)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    texts = [*rows, (900, ""), (901, "Übel blorgscum übel " * 50)]
    p = toxicity.Params()
    weights, bias = toxicity.train(docs(rows), lab, p)
    for r in toxicity.score_toxicity(docs(texts), lab).collect():
        if r["doc_id"] < 60 or r["doc_id"] > 899:
            t = f"\0{r['text'].lower()}\0"
            grams = {t[i : i + n] for n in p.sizes for i in range(len(t) - n + 1) if len(t) > 2}
            h = {int(toxicity.gram_hashes(toxicity.code_points([""])[0][:0] if not g else np.array([ord(c) for c in g], dtype=np.uint32), len(g))[0]) & (1 << p.bits) - 1 for g in grams}
            assert abs(r["score"] - 1 / (1 + np.exp(-(weights[sorted(h)].sum() + bias)))) < 1e-9
    assert (toxicity.train(docs(rows), lab, toxicity.Params(max_features=100))[0] != 0).sum() == 100 < (toxicity.train(docs(rows), lab, toxicity.Params(max_features=None))[0] != 0).sum()
    assert toxicity.train(docs(rows), lab, toxicity.Params(max_train_chars=0))[1] == 0.0
    q = quality.Params()
    weights, bias = quality.train(docs(rows), lab, q)
    for r in quality.score_quality(docs(texts), lab).collect():
        parts = [(o, f) for _, _, o, f in quality.text_features([r["text"]], q)]
        buckets = np.concatenate([f for _, f in parts]).tolist() if parts else []
        mean = sum(weights[b] for b in buckets) / max(1, len(buckets))
        assert abs(r["score"] - 1 / (1 + np.exp(-(mean + bias)))) < 1e-9
