import hashlib
import math

import numpy as np
import pytest

from scriptorium.llm import vector_codes
from scriptorium.llm.vector_codes import Params

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, p):
    """(vec_id, label, code, error) of each kept row, and the codebooks."""
    kept = [(i, [math.floor(p.scale * float(x)) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    first = {}
    for i, v, _ in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        first.setdefault(i, v)
    start = list(first.values())[: p.entries]
    width = len(start[0]) // p.parts
    books = [[v[k * width : (k + 1) * width] for v in start] for k in range(p.parts)]
    near = lambda part, book: min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), j) for j, e in enumerate(book))
    for _ in range(p.rounds):
        for k, book in enumerate(books):
            groups = {}
            for _, v, _ in kept:
                part = v[k * width : (k + 1) * width]
                groups.setdefault(near(part, book)[1], []).append(part)
            books[k] = [[sum(c) // len(groups[j]) for c in zip(*groups[j], strict=True)] if j in groups else e for j, e in enumerate(book)]
    out = []
    for i, v, label in kept:
        found = [near(v[k * width : (k + 1) * width], books[k]) for k in range(p.parts)]
        out.append((i, label, "".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found)))
    return out, books


@pytest.mark.parametrize("p", [Params(), Params(parts=4, entries=3, rounds=3)], ids=["contract", "small"])
def test_like_brute_force(spark, p):
    r = np.random.default_rng(3)
    rows = [(int(i), [float(np.float32(x)) for x in r.normal(0, 0.2, 32).round(1)], int(i) % 3 or None) for i in r.permutation(150)]
    rows += [rows[0], rows[1], (rows[2][0], rows[3][1], 7), (None, rows[4][1], None), (500, None, 1), (501, [None] + rows[0][1][1:], 1), (502, [float("nan")] + rows[0][1][1:], 1), (503, [float("inf")] + rows[0][1][1:], 1)]
    want, books = brute(rows, p)
    total = {}
    for _, label, _, e in want:
        total[label] = total.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    got = vector_codes.compress(spark.createDataFrame(rows, SCHEMA), p).collect()
    key = lambda x: tuple(str(c) for c in x)
    assert sorted([tuple(x) for x in got], key=key) == sorted([(i, lb, c, e, total[lb], sha) for i, lb, c, e in want], key=key)


def test_other_lengths_empty_tables_and_extra_columns(spark):
    rows = [(1, [0.5] * 16, None), (2, [0.25] * 16, None), (3, [0.5] * 32, None), (4, [], None), (5, [0.5] * 3, None)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS code", "2 AS row", "3 AS error")
    assert {(r["vec_id"], r["error"]) for r in vector_codes.compress(df).collect()} == {(1, 0), (2, 0)}
    assert vector_codes.compress(spark.createDataFrame([], SCHEMA)).count() == 0
    assert vector_codes.compress(spark.createDataFrame([(9, None, 1)], SCHEMA)).count() == 0


def test_large_components_are_cut_off_and_codes_decode(spark):
    rows = [(i, [float(i) * 10.0**k for k in range(16)], 0) for i in range(3)]
    fitted = vector_codes.fit(spark.createDataFrame(rows, SCHEMA))
    got = {r["vec_id"]: r["codes"] for r in vector_codes.encode(fitted).collect()}
    assert np.allclose(vector_codes.decode(got[1], fitted.books)[:4], [1, 10, 100, 1000], atol=0.01)
    assert max(b.max() for b in fitted.books) == vector_codes.LARGEST
