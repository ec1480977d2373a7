import random
from collections import Counter

import numpy as np
import pytest

from scriptorium.llm import substrings
from scriptorium.llm.substrings import Params


def brute(texts, window):
    """Kept words and number removed of each text."""
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


def corpus(seed, window):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefghij") * r.randint(1, 3)
    shared = [[word() for _ in range(r.randint(window - 3, 3 * window))] for _ in range(4)]
    texts = []
    for _ in range(40):
        w = [word() for _ in range(r.randint(0, 2 * window))]
        if r.random() < 0.6:
            s = r.choice(shared)
            a = r.randint(0, len(s) // 2)
            w[len(w) // 2 : len(w) // 2] = s[a : a + r.randint(window - 2, len(s))]
        texts.append(r.choice([" ", "\n", "\t "]).join(w))
    texts += [texts[0], texts[1] + " x", "a " * 90, "", None, "é ü " * 30, "one\0two " * 20 + "end", "one\1two " * 20 + "end"]
    return texts


@pytest.mark.parametrize("p", [Params(12, 4), Params(12, 4, group_rows=3), Params(12, 12), Params(7, 1, bucket_rows=5)], ids=str)
def test_like_brute_force(spark, docs, p):
    texts = corpus(p.window + p.prefix + p.group_rows, p.window)
    got = {r["doc_id"]: r for r in substrings.dedup_substrings(docs([(i, t) for i, t in enumerate(texts)]), p).collect()}
    for i, (n, gone, text) in enumerate(brute(texts, p.window)):
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["text"]) == (n, gone, None if texts[i] is None else text)
    assert sum(r["n_removed"] for r in got.values()) > 100


def test_nulls_repeats_extra_columns_and_empty_tables(spark):
    long = " ".join(f"w{i}" for i in range(60))
    schema = "doc_id long, n_words string, k1 int, text string, marks int"
    rows = [(1, "x", 1, long, 1), (1, "x", 1, long, 1), (None, "y", None, "a  b", None), (2, None, 2, None, 2), (1, "z", 3, "other", 3)]
    out = sorted((str(r) for r in substrings.dedup_substrings(spark.createDataFrame(rows, schema)).collect()))
    assert out == sorted([
        *["Row(doc_id=1, k1=1, text='', marks=1, n_words=60, n_removed=60)"] * 2,
        "Row(doc_id=None, k1=None, text='a b', marks=None, n_words=2, n_removed=0)",
        "Row(doc_id=2, k1=2, text=None, marks=2, n_words=0, n_removed=0)",
        "Row(doc_id=1, k1=3, text='other', marks=3, n_words=1, n_removed=0)",
    ])
    assert substrings.dedup_substrings(spark.createDataFrame([], schema)).count() == 0


def test_one_text_that_repeats_itself_and_a_very_long_one(spark, docs):
    r = random.Random(5)
    passage = [str(r.random()) for _ in range(40)]
    text = " ".join([str(r.random()) for _ in range(50_000)] + passage + ["between"] + passage)
    got = substrings.dedup_substrings(docs([(1, text), (2, "same " * 5000)])).select("doc_id", "n_words", "n_removed").collect()
    assert {tuple(x) for x in got} == {(1, 50_081, 80), (2, 5000, 5000)}


def test_least_places():
    v = np.array([5, 3, 3, 9, 1, 1, 7], dtype=np.uint64)
    assert substrings.least_places(v, 3).tolist() == [1, 1, 4, 4, 4]
    assert substrings.least_places(v, 1).tolist() == list(range(7))
    assert substrings.least_places(v, 8).tolist() == []
