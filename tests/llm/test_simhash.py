import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from scriptorium.llm import simhash
from scriptorium.llm._components import components


def union(n, pairs):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return [root(i) for i in range(n)]


def test_components(spark):
    r = random.Random(1)
    pairs = [(i, i + 1) for i in range(40)] + [(r.randrange(50, 150), r.randrange(50, 150)) for _ in range(60)] + [(200, x) for x in range(201, 260)]
    got = {x["id"]: x["component"] for x in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = union(300, pairs)
    assert got == {i: want[i] for p in pairs if p[0] != p[1] for i in p}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_thresholds_add_up():
    sample = np.random.default_rng(0).integers(-(2**62), 2**62, (300, 2))
    for p, n in ((simhash.NEAR, 1000), (simhash.NEAR, 10**6), (simhash.NEAR, 10**10)):
        parts = simhash.plan(sample, n, p)
        assert sum(t for _, t in parts) >= p.max_bits - 16 + 1 and all(t >= 0 for _, t in parts)
        assert sorted(b for bits, _ in parts for b in bits) == sorted({b for bits, _ in parts for b in bits})


def test_pairs_are_complete_with_and_without_hot_values(spark):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(20)]
    fps = set()
    for b in base:
        for _ in range(20):
            x = b
            for _ in range(r.randrange(4)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    want = union(len(signed), [(i, j) for i in range(len(signed)) for j in range(i) if ((signed[i] ^ signed[j]) & (2**64 - 1)).bit_count() <= 2])
    for hot in (1000, 3):
        p = simhash.Params(hot=hot, block_rows=16)
        nodes = spark.createDataFrame([(x, x) for x in signed], "id long, f0 long")
        place = {x: i for i, x in enumerate(signed)}
        found = [(place[x["a"]], place[x["b"]]) for x in simhash.links(nodes, p, 2).collect()]
        assert union(len(signed), found) == want
        assert all(want[a] == want[b] for a, b in found)  # two nodes that meet in a hub need not be linked themselves


def naive_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return format(sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)), "016x")


def test_fingerprints_against_a_plain_count(spark, docs):
    r = random.Random(11)
    rows = [(i, " ".join(r.choice("ab Cd é x\t y\n Z9").strip() or "w" for _ in range(r.randrange(0, 40)))) for i in range(120)]
    rows += [(500, None), (501, " \x0b\x0c\r"), (502, "A\x85b\u2003c d"), (503, "tie tie tie tie")]
    got = {x["doc_id"]: x["fingerprint"] for x in simhash.simhash_components(docs(rows)).collect()}
    assert got == {i: naive_fingerprint(t) for i, t in rows}


def test_simhash_rows(spark, docs):
    rows = [(5, "The cat sat on the mat today"), (3, "the CAT sat on  the mat\ntoday"), (9, None), (8, ""), (7, " \t"), (1, "one"), (2, "two words"), (11, "x y z " * 4000), (5, "The cat sat on the mat today"), (None, "one")]
    out = simhash.simhash_components(docs(rows).withColumn("f0", F.lit(1))).collect()
    assert len(out) == len(rows)
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in out]
    assert {c for d, _, c in got if d in (3, 5)} == {3} and {(f, c) for d, f, c in got if d in (7, 8, 9)} == {("0" * 16, 7)}
    assert {c for d, _, c in got if d is None} == {1}
    assert simhash.simhash_components(docs(rows).limit(0)).count() == 0


def test_near_duplicates_against_brute_force(spark, docs):
    r = random.Random(7)
    rows, n = [], 0
    for g in range(12):
        words = [f"g{g}w{r.randrange(500)}" for _ in range(120)]
        for _ in range(6):
            w = list(words)
            for _ in range(r.randrange(4)):
                w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
            rows.append((n, " ".join(w)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, rows[0][1].upper()), (None, rows[0][1])]
    sets = [set(zip(*[(t or "").lower().split()[k:] for k in range(5)], strict=False)) for _, t in rows[:-1]]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if (not sets[i] and not sets[j]) or len(sets[i] & sets[j]) >= 0.8 * max(1, len(sets[i] | sets[j]))]
    want = union(len(sets), links)
    for hot in (32, 2):
        p = simhash.Params(shingle=5, words=2, max_bits=15, hot=hot, block_rows=8)
        got = {x["doc_id"]: x["class_id"] for x in simhash.near_duplicates(docs(rows), 0.8, p).collect()}
        assert got == dict(enumerate(want))
    kept = [x["doc_id"] for x in simhash.drop_near_duplicates(docs(rows)).collect()]
    assert sorted(x for x in kept if x is not None) == sorted(set(want)) and None in kept


def test_repeated_phrases_do_not_rule_fingerprints(spark, docs):
    r = random.Random(5)
    rows = []
    for g in range(20):
        body, phrase = (" ".join(f"g{g}w{r.randrange(10**6)}" for _ in range(n)) for n in (300, 10))
        rows += [(2 * g, f"{body} {phrase}"), (2 * g + 1, " ".join([body] + [phrase] * 60))]
    got = {x["doc_id"]: x["class_id"] for x in simhash.near_duplicates(docs(rows)).collect()}
    assert got == {i: i - i % 2 for i in range(40)}


def test_recall_does_not_depend_on_the_count():
    rate, r = simhash.bit_rate(0.8), np.random.default_rng(2)
    assert abs(rate - 0.1515) < 0.001
    for count in (10, 10**3, 10**5, 10**6, 10**7, 10**8):
        p = simhash.near_params(count, 0.8)
        parts = simhash.plan(r.integers(-(2**62), 2**62, (300, p.words)), count, p)
        assert all(len(bits) >= simhash.narrowest(count) for bits, _ in parts)
        assert simhash.recall_of(parts, rate) >= 0.99
        apart = r.random((4000, 64 * p.words)) < rate
        found = np.any([apart[:, bits].sum(axis=1) <= t for bits, t in parts], axis=0)
        assert found.mean() >= 0.983


def test_shared_ids_texts_and_other_columns(spark, docs):
    rows = [(1, "alpha beta gamma delta epsilon"), (2, "alpha beta gamma delta epsilon"), (2, "quite another text stands here"), (3, "quite another text stands here"), (2, "quite another text stands here"), (None, "alpha beta gamma delta epsilon"), (None, None), (7, None), (8, " ")]
    out = simhash.drop_near_duplicates(docs(rows).selectExpr("*", "'x' AS text_key", "1 AS h"))
    assert out.columns[-2:] == ["text_key", "h"]
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    assert got == sorted([(1, rows[0][1]), (2, rows[2][1]), (None, rows[0][1]), (None, None), (7, None)], key=str)
    named = docs(rows).selectExpr("'k' || doc_id AS doc_id", "text")
    assert sorted(r["doc_id"] for r in simhash.drop_near_duplicates(named).collect() if r["doc_id"]) == ["k1", "k2", "k7"]
    assert simhash.drop_near_duplicates(docs(rows).limit(0)).count() == 0
