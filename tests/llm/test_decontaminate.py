import random

from scriptorium.llm import decontaminate


def brute(rows, items, k0=5, least=0.8):
    out = set()
    words = lambda t: (t or "").lower().split()
    sh = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    for i, t in items:
        k = min(k0, len(words(t)))
        q = sh(words(t), k) if k else set()
        out |= {(d, i) for d, x in rows if q and len(q & sh(words(x), k)) >= least * len(q) - 1e-9}
    return out


def test_items_in_long_documents(spark, docs):
    r = random.Random(2)
    vocab = [f"t{i}" for i in range(3000)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.randrange(3, 60)))) for i in range(40)] + [(90, None), (91, ""), (92, "two words")]
    rows = []
    for d in range(60):
        w = [r.choice(vocab) for _ in range(r.randrange(0, 900))]
        for _ in range(r.randrange(3)):
            i, t = items[r.randrange(40)]
            x = t.split()
            if r.random() < 0.5 and len(x) > 20:
                x[r.randrange(len(x))] = "changed"
            w[5:5] = x
        rows.append((d, " ".join(w)))
    rows += [(200, " ".join(t for _, t in items if t)), (201, None), (202, ""), (203, items[3][1].upper()), (200, items[0][1]), (None, items[1][1])]
    it = spark.createDataFrame(items, "item_id long, text string")
    for p in (decontaminate.Params(), decontaminate.Params(hashes=4), decontaminate.Params(block_chars=500)):
        got = {(x["doc_id"], x["item_id"]) for x in decontaminate.contained_items(docs(rows).selectExpr("*", "1 AS item_id"), it, p).collect()}
        assert got == brute(rows, items)
    hit = brute([(i, t) for i, (_, t) in enumerate(rows)], items)
    want = sorted((r for i, r in enumerate(rows) if i not in {d for d, _ in hit}), key=str)
    for p in (decontaminate.Params(), decontaminate.Params(block_chars=500)):
        left = decontaminate.drop_contaminated(docs(rows).selectExpr("*", "1 AS item_id"), it, p)
        assert sorted(((x["doc_id"], x["text"]) for x in left.collect()), key=str) == want and left.columns[-1] == "item_id"
    twice = docs([(1, items[0][1]), (1, "clean words of another row")])
    assert [x["text"] for x in decontaminate.drop_contaminated(twice, it).collect()] == ["clean words of another row"]
    assert decontaminate.drop_contaminated(docs(rows), it.limit(0)).count() == len(rows)
    assert decontaminate.contained_items(docs(rows), it.limit(0)).count() == 0
    assert decontaminate.contained_items(docs(rows).limit(0), it).count() == 0
