import hashlib
import random
import re

from pyspark.sql import functions as F

import corpus_pipeline
from scriptorium.llm import line_dedup

LONG = " ".join(f"w{i}" for i in range(60))
OTHER = " ".join(f"v{i}" for i in range(55))


def test_long_passages_go_but_the_first(spark, docs):
    rows = [(3, f"own three\n{LONG}\nend three"), (1, f"own one\n{LONG}"), (2, f"{LONG}\nown two\n{OTHER}"), (4, f"clean\nshort\nclean again\n{OTHER}x"), (5, OTHER), (6, None), (7, ""), (8, "short\nown"), (9, LONG)]
    d = docs(rows).withColumn("n_lines", F.lit("clash"))
    out = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup.dedup_lines(d).collect()}
    assert out[1] == (rows[1][1], 0) and out[3] == ("own three\nend three", 1)
    assert out[2] == (f"own two\n{OTHER}", 1) and out[5] == ("", 1) and out[9] == ("", 1)
    assert out[4] == (rows[3][1], 0) and out[6] == (None, 0) and out[7] == ("", 0) and out[8] == ("short\nown", 0)


def test_boundaries_resist_shifts(spark, docs):
    passage = [f"line {i} of a passage that many share" for i in range(24)]
    rows = [(1, "\n".join(["a first line"] + passage)), (2, "\n".join(["b", "c", "d"] + passage + ["tail"]))]
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs(rows)).collect()}
    assert out[1]["n_removed"] == 0 and out[2]["n_removed"] >= 12
    assert out[2]["text"].startswith("b\nc\nd")


def test_repeats_within_a_document_null_ids_and_empty_tables(spark, docs):
    d = docs([(1, f"{LONG}\nmiddle\n{LONG}"), (None, LONG), (1, f"{LONG}\nmiddle\n{LONG}")])
    out = [(r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(d).collect()]
    assert sorted(out, key=str) == sorted([(1, f"{LONG}\nmiddle"), (1, f"{LONG}\nmiddle"), (None, LONG)], key=str)
    assert line_dedup.dedup_lines(d.limit(0)).count() == 0


def test_passages_of_short_lines_go_whole(spark, docs):
    rows = []
    for t, (n, words) in enumerate([(2, 30), (2, 49), (3, 20), (4, 15), (6, 10), (10, 6), (24, 10)] * 20):
        passage = [" ".join(f"t{t}l{i}w{k}" for k in range(words)) for i in range(n)]
        rows += [(2 * t, "\n".join([f"head of {t}", *passage, f"tail of {t}"])), (2 * t + 1, "\n".join([f"other {t}", f"b{t}", *passage, f"end {t}"]))]
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup_stage(spark, docs(rows), "").collect()}
    for t in range(len(rows) // 2):
        assert out[2 * t] == rows[2 * t][1] and out[2 * t + 1] == f"other {t}\nb{t}\nend {t}"


def test_runs_keep_first_occurrences_and_what_chunks_remove(spark, docs):
    short = "ten words stand in this line and then no more"
    rows = [(1, f"own\n{LONG}\n{LONG}"), (2, "\n".join([short] * 9)), (3, f"{LONG}\n\n{OTHER}"), (4, f"x\n{LONG}\n\n{OTHER}\n"), (5, None), (None, LONG), (6, ""), (6, f"new\n{LONG}")]
    d = docs(rows).withColumn("n_lines", F.lit("clash"))
    out = sorted(((r["doc_id"], r["text"], r["n_removed"]) for r in line_dedup.dedup_lines(d).collect()), key=str)
    want = [(1, f"own\n{LONG}", 1), (2, "\n".join([short] * 5), 4), (3, f"\n{OTHER}", 1), (4, "x\n\n", 2), (5, None, 0), (None, LONG, 0), (6, "", 0), (6, "new", 1)]
    assert out == sorted(want, key=str)
    assert line_dedup.dedup_lines(d.limit(0)).count() == 0


def plain(rows, p):
    """The chunks and what goes, in plain Python."""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    e = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:8], 16)
    found = {}
    for d, text in rows:
        own = [(i, s, len(word.findall(s))) for i, s in enumerate((text or "").split("\n")) if word.search(s)]
        spans, start = set(), 0
        for j, (_, s, _) in enumerate(own):
            rolling = e(s)
            for k in range(1, p.window):
                rolling = rolling * 31 % 1000003 + (e(own[j - k][1]) if j >= k else 0)
            if rolling % 1000003 % p.every == 0 or j == len(own) - 1:
                if j > start and sum(x[2] for x in own[start : j + 1]) >= p.least_words:
                    spans.add((start, j))
                start = j + 1
        for j in range(len(own)):
            for step in (1, -1):
                k = j
                while 0 <= k < len(own) and sum(x[2] for x in own[min(j, k) : max(j, k) + 1]) < p.run_words:
                    k += step
                if 0 <= k < len(own):
                    spans.add((min(j, k), max(j, k)))
        for a, b in spans:
            found.setdefault(tuple(x[1] for x in own[a : b + 1]), []).append((d, own[a][0], own[b][0] + 1))
    gone = {}
    for places in found.values():
        places.sort()
        f = places[0]
        for d, a, b in places[1:]:
            gone.setdefault(d, set()).update(range(max(a, f[2]) if d == f[0] else a, b))
    return {d: (t if d not in gone else "\n".join(s for i, s in enumerate(t.split("\n")) if i not in gone[d]), len(gone.get(d, ()))) for d, t in rows}


def test_against_plain_python_also_when_hashes_collide(spark, docs):
    r = random.Random(8)
    pool = [" ".join(f"w{r.randrange(40)}" for _ in range(r.choice([0, 1, 3, 8, 20, 55]))) for _ in range(30)]
    rows = [(d, "\n".join(r.choice(pool) if r.random() < 0.7 else f"own {d} {k}" for k in range(r.randrange(1, 25)))) for d in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "\n".join(pool * 40)), (104, "x " * 30000)]
    for p in (line_dedup.Params(), line_dedup.Params(hash_bits=5), line_dedup.Params(window=3, every=2, least_words=0, run_words=15)):
        got = {x["doc_id"]: (x["text"], x["n_removed"]) for x in line_dedup.dedup_lines(docs(rows), p).collect()}
        assert got == plain(rows, p)


def test_rows_that_share_an_id(spark, docs):
    rows = [(1, f"a\n{LONG}"), (1, f"b\n{LONG}"), (2, LONG), (2, LONG)]
    got = sorted((x["doc_id"], x["text"]) for x in line_dedup.dedup_lines(docs(rows)).collect())
    assert got in (sorted([(1, f"a\n{LONG}"), (1, "b"), (2, ""), (2, "")]), sorted([(1, "a"), (1, f"b\n{LONG}"), (2, ""), (2, "")]))
