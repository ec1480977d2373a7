import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from scriptorium.llm import lm_score


def test_lattice_sums_over_all_cuts():
    pieces = sorted([b" a", b"b", b" ab", b"ab", b" ", b"a"])
    lat = lm_score.Lattice(pieces)
    w = np.log(np.array([0.1, 0.2, 0.15, 0.25, 0.2, 0.1]))
    p = dict(zip(pieces, np.exp(w), strict=True))

    def brute(s):
        return 1.0 if not s else sum(p.get(s[:k], 0) * brute(s[k:]) for k in range(1, len(s) + 1))

    words = [b"ab", b"a", b"abab", b"b"]
    got = lat.scores(words, w)
    assert np.allclose(np.exp(got), [brute(b" " + x) for x in words])
    assert np.isclose(lat.long_forward(b" abab", w), got[2])
    total = np.zeros(len(pieces) + 1)
    lat.expected([b"ab"], np.array([1.0]), w, 0.0, 1.0, total)
    spelled = sum(n * len(x) for n, x in zip(total, pieces, strict=False))
    assert math.isclose(spelled, 3.0) and math.isclose(total[-1], 1.0)  # the expected pieces spell the word


def test_arcs_are_all_pieces_of_a_word_and_no_start_is_followed_for_nothing():
    pieces, _ = lm_score.vocabulary(None)
    lat, held = lm_score.Lattice(pieces), set(pieces)
    words = lm_score.matrix([b"information", b"internation", b"zzqxjkwvbqz", "éé日本x".encode()])
    got = {(w, i, k, int(x)) for (i, k), (at, ids) in lat.arcs(words).items() for w, x in zip(np.arange(len(words))[at].tolist(), ids, strict=True)}
    want = {(w, i, j - i, lat.index[x]) for w, row in enumerate(words) for i in range(words.shape[1]) for j in range(i + 1, words.shape[1] + 1) if (x := row[i:j].tobytes()) in held}
    assert got == want
    for x in (b" info", b"nternat", b"\xc3"):  # beginnings of longer pieces are marked, so that what begins none can be left
        h = sum((c + 1) * int(p) for c, p in zip(x, lm_score.powers(lm_score.POWER, len(x)), strict=True)) + len(x)
        longer = any(len(y) > len(x) and y.startswith(x) for y in pieces)
        assert not longer or lat.filter[lat.slot(np.array([h % (1 << 64)], dtype=np.uint64))[0]] & lm_score.BEGINNING


def test_small_batches_of_words_are_scored_together():
    batch = pa.record_batch([pa.array([b"word"] * 2000, type=pa.binary()), pa.array([1] * 2000)], names=["word", "c"])
    assert [t.num_rows for t in lm_score.together(iter([batch] * 40))] == [66_000, 14_000]
    long = pa.record_batch([pa.array([b"x" * (3 << 20)], type=pa.binary()), pa.array([1])], names=["word", "c"])
    assert [t.num_rows for t in lm_score.together(iter([long] * 5))] == [2, 2, 1] and not list(lm_score.together(iter([])))


def test_scores_against_counts(spark, docs):
    rows = [(i, f"The cat sat on the MAT {i % 5}\tand\nÉté {'x' * (i % 3 + 1)}") for i in range(30)]
    pieces, weights = lm_score.vocabulary(None)
    logp = dict(zip(pieces, weights, strict=True))
    longest = max(map(len, pieces))

    def forward(text):
        """All cuts of the whole text into pieces, by a plain recursion over its bytes."""
        data = b"".join(b" " + w for w in text.encode().lower().split())
        alpha = [0.0]
        for j in range(1, len(data) + 1):
            terms = [alpha[j - k] + logp[data[j - k : j]] for k in range(1, min(longest, j) + 1) if data[j - k : j] in logp]
            alpha.append(float(np.logaddexp.reduce(terms)))
        return alpha[-1]

    rows += [(100, None), (101, ""), (102, "word" * 2000), (103, "a " * 5000), (4, rows[4][1])]
    out = lm_score.score_lm(docs(rows).selectExpr("*", "1 AS score", "2 AS block", "3 AS word")).collect()
    assert len(out) == len(rows)
    low = lambda t: (t or "").encode().lower().split()
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    c, ends = Counter(), 0
    for i, t in rows:
        if not held(i):
            c.update(low(t))
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + 1
    want = {}
    for i, t in rows:
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in low(t)) + math.log10((ends + 1) / (n + v + 1))
        want[i] = (held(i), len(low(t)) + 1, sum(c[w] > 0 for w in low(t)) + 1, n, base)
    for r in out:
        a = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == a[:4] and math.isclose(r["base_score"], a[4], rel_tol=1e-9)
        assert math.isfinite(r["score"]) and r["score"] < 0
        if r["doc_id"] < 30 or r["doc_id"] in (100, 101):
            text = dict(rows)[r["doc_id"]] or ""
            seen = ends + 1.0
            end = seen / (seen + n - ends)
            whole = forward(text) / math.log(10) + len(low(text)) * math.log10(1 - end) + math.log10(end)
            assert math.isclose(r["score"], whole, rel_tol=1e-9)
    fitted = lm_score.score_lm(docs(rows), lm_score.Params(rounds=1, whole_words=True)).collect()
    assert sum(x["score"] for x in fitted) > sum(x["score"] for x in out)


def test_no_training_rows(spark, docs):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = lm_score.score_lm(docs([(held, "new words")])).first()
    assert (r["train_tokens"], r["n_known"], r["n_tokens"], r["base_score"]) == (0, 0, 3, 0.0) and math.isfinite(r["score"])
    assert lm_score.score_lm(docs([(1, "x")]).limit(0)).count() == 0


def test_the_query_learns_from_training_documents(spark, tmp_path):
    from pyspark.sql import functions as F

    from scriptorium.llm import queries

    words = [f"{a}{b}onth" for a in ("k", "br", "st", "m", "v") for b in ("a", "ei", "u", "oa")]
    rows = [(i, " ".join(words[(i * k + k * k) % len(words)] for k in range(1, 40)) + f" odd{i}th") for i in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    held = queries.op3_lm_score(spark, f"file://{tmp_path}").where("held_out")
    r = held.agg(F.sum("n_tokens").alias("n"), F.sum("score").alias("score"), F.sum("base_score").alias("base"), F.count_if(F.col("score").isNull() | F.isnan("score")).alias("bad")).first()
    assert r["bad"] == 0 and r["score"] / r["n"] > r["base"] / r["n"] - 1
