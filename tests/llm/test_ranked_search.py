import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from scriptorium.llm import ranked_search
from scriptorium.llm.ranked_search import Params

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    tfs = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(1 for _, _, n in tfs if n), sum(n for _, _, n in tfs)
    df = Counter(t for _, c, _ in tfs for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in tfs:
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return out


def corpus(seed):
    r = random.Random(seed)
    words = ["w%d" % int(r.paretovariate(0.6)) for _ in range(300)] + ["É", "ÉA", "𝒳y", "Stop_word"]
    docs = [(i, r.choice([" ", ", ", "\n", "\0"]).join(r.choices(words, k=r.randint(0, 60)))) for i in range(400)]
    docs += [(400, docs[7][1]), (7, docs[7][1]), (None, docs[7][1]), (401, None), (402, ""), (403, "...")]
    items = [(i, " ".join(r.choices(words, k=r.randint(1, 12)))) for i in range(25)] + [(25, docs[7][1]), (26, None), (27, ""), (28, "absent"), (3, "w1 W1 w2")]
    return docs, items


@pytest.mark.parametrize("p", [Params(), Params(k=3, block=2, shard_chars=2000, step=1, query_chars=60), Params(k=7, block=5, shard_chars=5000)], ids=str)
def test_like_brute_force(spark, p):
    docs, items = corpus(p.block)
    index = ranked_search.build_index(spark.createDataFrame(docs, "doc_id long, text string"), p)
    got = ranked_search.search(index, spark.createDataFrame(items, "item_id long, text string"), p).collect()
    key = lambda x: tuple(str(c) for c in x)
    assert sorted([tuple(x) for x in got], key=key) == sorted(brute(docs, items, p.k), key=key)


def test_nothing_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 5, "x")], "doc_id long, text string, score int, term string")
    items = spark.createDataFrame([("q", "A", 1)], "item_id string, text string, rank int")
    assert [tuple(r)[:3] for r in ranked_search.search(ranked_search.build_index(docs), items).collect()] == [("q", 1, 1)]
    two = docs.unionByName(docs.selectExpr("2 AS doc_id", "'c' AS text", "score", "term"))
    assert [tuple(r)[:3] for r in ranked_search.search(ranked_search.build_index(two), items).collect()] == [("q", 1, 1)]
    none = ranked_search.build_index(docs.limit(0))
    assert ranked_search.search(none, items).count() == 0
    assert ranked_search.search(ranked_search.build_index(two), items.limit(0)).count() == 0


def test_a_very_long_text(spark):
    docs = spark.createDataFrame([(1, "long " * 200_000 + "needle"), (2, "needle"), (3, "x")], "doc_id long, text string")
    got = ranked_search.search(ranked_search.build_index(docs), spark.createDataFrame([(1, "needle")], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["rank"]) for r in got] == [(2, 1), (1, 2)]


def test_blocks_below_the_threshold_stay_compressed():
    p = Params(k=2, block=4, step=1)
    raws = [b"common " * 3 + b"rare " * (9 if i in (50, 51) else 0) + b"filler " * 5 for i in range(200)]
    columns, m = ranked_search.posting_blocks(raws, 200, 2000, p)
    n = len(columns["term"])
    rows = pa.table(columns | {"ids": pa.nulls(n, pa.list_(pa.int64())), "m": pa.nulls(n, pa.list_(pa.int64()))})
    of_docs = {c: [None] for c in rows.column_names} | {"term": [b""], "ids": [list(range(200))], "m": [m.tolist()]}
    shard = ranked_search.Shard(pa.concat_tables([rows, pa.table(of_docs, schema=rows.schema)]))
    docs, scores = shard.search({b"rare": 4000, b"common": 1}, p)
    assert docs.tolist() == [50, 51] and shard.open.sum() < 6 < len(shard.open)


def test_packing():
    v = np.array([0, 127, 128, 16383, 16384, 2**31, 2**40, 5], dtype=np.int64)
    data, ends = ranked_search.packed(v)
    assert ranked_search.unpacked(data).tolist() == v.tolist() and ends[-1] == len(data)
    assert ranked_search.unpacked(data[:0]).tolist() == []
