"""Mixing sources to target weights, in blocks of words.

The texts of a source are laid end to end and cut into blocks of one fixed length. The mix is cut into output shards of a
fixed number of slots; for each shard a multinomial over the sources, weighted by their targets, draws how many of its slots
each source fills. Prefix sums over shards give each source's slots in a shard their numbers, and the j-th slot of a source
takes the block to which a pseudorandom permutation of its blocks (one for each pass over the source) maps it; blocks are
joined by index. A source gives each block `most` times at most: slots drawn beyond that are drawn again among sources
that have room. So are those beyond a source's target, among sources short of theirs, for the first `held_turns` turns. No draw depends on partitions or order of rows, so reruns agree. Nothing is ever ordered within a whole
source or shard: offsets are prefix sums over groups, then within a group.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.llm._common import materialize, mixed, passes, text_key
from scriptorium.llm.line_dedup import words_in


@dataclass(frozen=True)
class Params:
    """block_words: words of a block; held_turns: turns of drawing in which totals are held to the targets; 0: the first draw stands but for the cap, and totals differ from targets by about the root of a source's number of blocks, in blocks. bucket_rows: documents, and shards, ordered by one task; max_sources bounds what the driver holds, a row a source (more are an error)."""

    weights: tuple[float, ...] = (5, 2, 1)
    share: float = 1.5
    most: float = 2.0
    held_turns: int = 3
    block_words: int = 16
    shard_slots: int = 4096
    task_slots: int = 1 << 18
    bucket_rows: int = 500
    max_sources: int = 100_000
    seed: int = 17


def targets(sizes: list[tuple[str | None, int]], p: Params) -> dict[str | None, float]:
    """By source: its share of `share` times all words by weight, but `most` times its own size at most; the excess goes to the others."""
    names = sorted((s for s, _ in sizes), key=lambda s: (s is None, s or ""))
    own = dict(sizes)
    weight = {s: p.weights[i % len(p.weights)] for i, s in enumerate(names)}
    left, free, out = p.share * sum(own.values()), list(names), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > p.most * own[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            out[s] = p.most * own[s]
        left -= sum(out[s] for s in over)
        free = [s for s in free if s not in out]
    return out


def permuted(at: np.ndarray, size: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of range(size) at some places: four Feistel rounds, walked until the result is in range."""
    half = max(1, (max(2, size - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    out = at.astype(np.uint64)
    todo = np.arange(len(out))
    keys = mixed(np.arange(4, dtype=np.uint64) + np.uint64(key & (2**64 - 1)))
    while len(todo):
        x = out[todo]
        left, right = x >> shift, x & mask
        for k in keys:
            left, right = right, left ^ (mixed(right + k) & mask)
        out[todo] = x = (left << shift) | right
        todo = todo[x >= np.uint64(size)]
    return out.astype(np.int64)


@dataclass(frozen=True)
class Plan:
    """placed: documents with sid, source_size, target and the place of their first word; sources: sid, blocks; blocks, slots and limits by sid."""

    placed: DataFrame
    sources: DataFrame
    blocks: np.ndarray
    slots: np.ndarray
    limits: np.ndarray


def _plan(docs: DataFrame, p: Params) -> Plan:
    spark = docs.sparkSession
    base = docs.select("doc_id", text_key(F.col("text")).alias("key"), "source", words_in(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    base = materialize(base, "mix-sizes")
    found = base.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(p.max_sources + 1).collect()
    if len(found) > p.max_sources:
        raise ValueError(f"more than {p.max_sources} sources")
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [(r["source"], int(r["size"])) for r in found]
    target = targets(sizes, p)
    rows = [(i, s, size, float(target[s]), -(-size // p.block_words)) for i, (s, size) in enumerate(sizes)]
    blocks = np.array([r[4] for r in rows], dtype=np.int64)
    slots = np.array([t * b / size if size else 0.0 for _, _, size, t, b in rows])
    sources = spark.createDataFrame(rows, "sid int, __s string, source_size long, target double, blocks long")
    buckets = max(1, -(-sum(r["n"] for r in found) // p.bucket_rows))
    own = base.join(sources, F.col("source").eqNullSafe(F.col("__s"))).drop("__s", "blocks")
    own = own.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "key"), F.lit(buckets)))
    placed = _offsets(own, ["sid"], "bucket", ["doc_id", "key", "size"], "size", "start")
    return Plan(placed, sources.select("sid", "blocks"), blocks, slots, np.floor(p.most * blocks).astype(np.int64))


def _offsets(rows: DataFrame, keys: list[str], group: str, order: list[str], n: str, name: str) -> DataFrame:
    """rows with the sum of n over all rows of their keys before them, by group, then by order: sums over groups, then within each."""
    sums = rows.groupBy(*keys, group).agg(F.sum(n).alias("__n"))
    before = sums.withColumn("__before", F.sum("__n").over(Window.partitionBy(*keys).orderBy(group)) - F.col("__n")).drop("__n")
    w = Window.partitionBy(*keys, group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.join(before, [*keys, group]).withColumn(name, F.col("__before") + F.sum(n).over(w) - F.col(n)).drop("__before", group)


def _draws(spark: SparkSession, plan: Plan, p: Params) -> DataFrame:
    """sid, shard, at, n: the slots at, ... at + n - 1 of a source stand in the shard."""
    total = int(round(plan.slots.sum()))
    shards = max(1, -(-total // p.shard_slots))
    need = spark.range(shards).select(F.col("id").alias("shard"), F.least(F.lit(p.shard_slots), F.lit(total) - F.col("id") * p.shard_slots).alias("n"))
    used, turn, out = np.zeros_like(plan.limits), 0, None
    weight = plan.slots
    goals = np.minimum(np.ceil(plan.slots - 1e-9), plan.limits).astype(np.int64)
    while weight.sum() > 0:
        limit = goals if turn < p.held_turns else plan.limits
        limits = spark.createDataFrame([(i, int(x)) for i, x in enumerate(limit)], "sid int, limit long")
        chance, seed = weight / weight.sum(), p.seed + 1_000_003 * turn

        def draw(frames, chance=chance, seed=seed):
            for f in frames:
                for shard, n in zip(f["shard"], f["n"], strict=True):
                    got = np.random.Generator(np.random.Philox(key=[seed, int(shard)])).multinomial(int(n), chance)
                    sid = np.flatnonzero(got)
                    yield pd.DataFrame({"sid": sid.astype(np.int32), "shard": shard, "n": got[sid]})

        drawn = need.mapInPandas(draw, "sid int, shard long, n long").withColumn("group", F.expr(f"shard div {p.bucket_rows}"))
        first = spark.createDataFrame([(i, int(x)) for i, x in enumerate(used)], "sid int, used long")
        drawn = _offsets(drawn, ["sid"], "group", ["shard"], "n", "at").join(first, "sid").join(limits, "sid")
        drawn = drawn.select("sid", "shard", (F.col("at") + F.col("used")).alias("at"), "n", F.greatest(F.lit(0), F.least("n", F.col("limit") - F.col("at") - F.col("used"))).alias("fits"))
        drawn = materialize(drawn, "mix-draws")
        fits = drawn.where("fits > 0").select("sid", "shard", "at", F.col("fits").alias("n"))
        out = fits if out is None else out.unionByName(fits)
        for r in drawn.groupBy("sid").agg(F.sum("fits").alias("n")).collect():  # a row a source
            used[r["sid"]] += r["n"]
        need = drawn.groupBy("shard").agg(F.sum(F.col("n") - F.col("fits")).alias("n")).where("n > 0")
        if need.isEmpty():
            break
        # by how far each source is from its target; when none is, by what room it has
        weight = np.maximum(goals - used, 0).astype(float)
        weight = weight if weight.sum() > 0 and turn < p.held_turns else np.maximum(plan.limits - used, 0).astype(float)
        turn += 1
    return spark.createDataFrame([], "sid int, shard long, at long, n long") if out is None else out


def _slots(spark: SparkSession, plan: Plan, p: Params) -> DataFrame:
    """sid, shard, j, block: a row for each slot of the mix, the j-th of its source."""
    blocks, seed = plan.blocks, p.seed

    def take(frames):
        for f in frames:
            sid, shard, at, n = (f[c].to_numpy() for c in ("sid", "shard", "at", "n"))
            for a, b in passes(n, p.task_slots):
                own = np.repeat(sid[a:b], n[a:b])
                j = np.arange(len(own)) + np.repeat(at[a:b] - np.concatenate(([0], np.cumsum(n[a:b])[:-1])), n[a:b])
                turn, place = j // blocks[own], j % blocks[own]
                # slots of one source and turn go through one permutation together
                order = np.lexsort((turn, own))
                new = np.flatnonzero(np.concatenate(([True], (np.diff(own[order]) != 0) | (np.diff(turn[order]) != 0))))
                block = np.empty(len(own), dtype=np.int64)
                for some in np.split(order, new[1:]):
                    s, t = int(own[some[0]]), int(turn[some[0]])
                    block[some] = permuted(place[some], int(blocks[s]), int(mixed(np.array([seed * 1_000_003 + s * 8_191 + t], dtype=np.uint64))[0]))
                yield pd.DataFrame({"sid": own.astype(np.int32), "shard": np.repeat(shard[a:b], n[a:b]), "j": j, "block": block})

    # a fixed number of tasks: the few rows that hold the draws would else meet in one
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(plan.slots.sum()) // p.task_slots))
    return _draws(spark, plan, p).repartition(tasks, "sid", "shard").mapInPandas(take, "sid int, shard long, j long, block long")


def _pieces(placed: DataFrame, p: Params) -> DataFrame:
    """sid, start (which name a document that has words), block, and the words of the document that fall into it: from `first` (0 is the document's first word), `n` of them."""
    ends, size = F.col("start") + F.col("size"), p.block_words
    out = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"start div {size}"), F.expr(f"(start + size - 1) div {size}"))))
    first = F.greatest(F.col("start"), F.col("block") * size)
    return out.select("sid", "start", "block", (first - F.col("start")).alias("first"), (F.least(ends, (F.col("block") + 1) * size) - first).alias("n"))


def mix_sources(docs: DataFrame, p: Params | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for each row of docs; taken counts the words that the mix takes of it, repeats too.

    Null texts have size 0 and null sources are one source, the last. A source without words gets no slots. Repeated rows
    are packed each for itself; of rows that share a doc_id and differ in text each counts by its own. An empty table gives
    an empty result. A block is taken `most` times at most, so no document exceeds that. Other columns are not read.
    """
    p = p or Params()
    plan = _plan(docs, p)
    placed = materialize(plan.placed, "mix-places")
    takes = _slots(docs.sparkSession, plan, p).groupBy("sid", "block").agg(F.count("*").alias("times"))
    taken = (
        _pieces(placed, p)
        .select("sid", "block", "start", "n")
        .join(takes.hint("merge"), ["sid", "block"])  # their number isn't known to the optimizer, so never broadcast
        .groupBy("sid", "start")
        .agg(F.sum(F.col("n") * F.col("times")).alias("taken"))
    )
    some, none = placed.where("size > 0"), placed.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    out = some.join(taken.hint("merge"), ["sid", "start"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))
    keys = ["doc_id", "source", "size", "source_size", "target", "taken"]
    return out.select(*keys).unionByName(none.select(*keys))


def mixed_blocks(docs: DataFrame, p: Params | None = None) -> DataFrame:
    """shard, slot, source, block, text: the mix itself, each block's words joined by single spaces. In a shard the slots of all sources are shuffled."""
    p = p or Params()
    plan = _plan(docs, p)
    placed = materialize(plan.placed, "mix-places")
    pieces = _pieces(placed, p).join(placed.select("sid", "start", "doc_id", "key", "source", "size").where("size > 0"), ["sid", "start"])
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), 1)
    texts = docs.select(F.col("doc_id").alias("__id"), text_key(F.col("text")).alias("__key"), F.col("source").alias("__s"), words.alias("words")).dropDuplicates(["__id", "__key", "__s"])
    cut = pieces.join(texts, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__key")) & F.col("source").eqNullSafe(F.col("__s")))
    cut = cut.select("sid", "block", "source", "start", F.array_join(F.slice("words", (F.col("first") + 1).cast("int"), F.col("n").cast("int")), " ").alias("part"))
    parts = F.array_sort(F.collect_list(F.struct("start", "part")))
    blocks = cut.groupBy("sid", "source", "block").agg(F.array_join(F.transform(parts, lambda x: x["part"]), " ").alias("text"))
    slot = F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(p.seed), "sid", "j"), "sid", "j")) - 1
    slots = _slots(docs.sparkSession, plan, p).withColumn("slot", slot)
    return slots.hint("merge").join(blocks, ["sid", "block"]).select("shard", "slot", "source", "block", "text")
