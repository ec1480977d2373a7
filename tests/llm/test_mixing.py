import numpy as np
import pytest

from scriptorium.llm import mixing


def test_targets_share_the_excess():
    got = mixing.targets([("a", 100), ("b", 10), ("c", 400), (None, 50)], mixing.Params())
    assert got[None] <= 100 and got["b"] == 20 and sum(got.values()) <= 1.5 * 560 + 1e-9
    assert abs(got["a"] - 200) < 1e-9
    assert mixing.targets([("a", 0)], mixing.Params()) == {"a": 0.0}


def test_permutations():
    for n in (1, 2, 3, 17, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 5).tolist()) == list(range(n))
    assert mixing.permuted(np.arange(50), 1000, 5).tolist() == mixing.permuted(np.arange(1000), 1000, 5)[:50].tolist()


def test_mix(spark, docs):
    rows = [(i, " ".join(f"s{i % 3}w{k}" for k in range(20 + i % 60)), f"src{i % 3}") for i in range(400)]
    rows += [(1000, None, None), (1001, "", "empty"), (1002, "w " * 9000, "src0"), (7, rows[7][1], "src1"), (1003, "last words here", None), (None, "no id", "src2")]
    d = docs(rows).selectExpr("*", "'clash' AS size")
    out = mixing.mix_sources(d).collect()
    assert len(out) == len(rows)
    want = {}
    for _, t, s in rows:
        want[s] = want.get(s, 0) + len((t or "").split())
    assert all(r["taken"] <= 2 * r["size"] and r["source_size"] == want[r["source"]] for r in out)
    for s in want:
        own = [r for r in out if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(4, 0.02 * own[0]["target"])
    again = mixing.mix_sources(d.repartition(7)).collect()
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
    assert sorted(map(key, out)) == sorted(map(key, again))
    assert mixing.mix_sources(d.limit(0)).count() == 0


def test_blocks_hold_what_the_mix_takes(spark, docs):
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(30))) for i in range(20)]
    d = docs(rows)
    blocks = mixing.mixed_blocks(d).collect()
    count = {}
    for b in blocks:
        for w in b["text"].split():
            count[w.split("w")[0]] = count.get(w.split("w")[0], 0) + 1
    assert count == {f"d{r['doc_id']}": r["taken"] for r in mixing.mix_sources(d).collect() if r["taken"]}


def test_taken_against_plain_python(spark, docs):
    """The draws again, one shard after the other, and every slot's block by a permutation over the words themselves."""
    p = mixing.Params(block_words=5, shard_slots=16)
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(3 + i * 7 % 23)), f"s{min(i % 7, 3)}") for i in range(90)] + [(900, None, None), (901, "tail", None)]
    out = {r["doc_id"]: r for r in mixing.mix_sources(docs(rows), p).collect()}
    plan = mixing._plan(docs(rows), p)
    draws = [(r["sid"], r["shard"], r["at"], r["n"]) for r in mixing._draws(spark, plan, p).collect()]
    per_shard, per_source = {}, {}
    for sid, shard, at, n in draws:
        per_shard[shard] = per_shard.get(shard, 0) + n
        per_source.setdefault(sid, []).extend(range(at, at + n))
    total = round(sum(plan.slots))
    assert per_shard == {s: min(16, total - 16 * s) for s in range(-(-total // 16))}
    assert all(sorted(j) == list(range(len(j))) and len(j) <= 2 * plan.blocks[sid] for sid, j in per_source.items())
    taken = {}
    placed = sorted(((r["sid"], r["start"], r["doc_id"], r["size"]) for r in plan.placed.collect()), key=lambda r: r[:2])
    for sid, j in per_source.items():
        words = [d for s, start, d, size in placed if s == sid for _ in range(size)]
        n = int(plan.blocks[sid])
        for turn in range(2):
            key = int(mixing.mixed(np.array([p.seed * 1_000_003 + sid * 8_191 + turn], dtype=np.uint64))[0])
            order = mixing.permuted(np.arange(n), n, key)
            for x in j:
                if x // n == turn:
                    for d in words[5 * order[x % n] : 5 * order[x % n] + 5]:
                        taken[d] = taken.get(d, 0) + 1
    assert {d: r["taken"] for d, r in out.items()} == {d: taken.get(d, 0) for d in out}


def test_too_many_sources_are_an_error(spark, docs):
    with pytest.raises(ValueError):
        mixing.mix_sources(docs([(i, "a b", f"s{i}") for i in range(5)]), mixing.Params(max_sources=4))
