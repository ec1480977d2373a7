"""SimHash near-dedup by the generalised pigeonhole principle.

The bits of a fingerprint are grouped into partitions, correlated bits together. Two fingerprints within `max_bits` of each
other are within t_i in at least one partition i, for any thresholds t_i >= -1 that add up to max_bits - partitions + 1
(-1: the partition isn't probed). Estimated candidate counts (from a bounded sample of fingerprints, scaled to their
number) choose the number of partitions and, by dynamic programming, the thresholds. Fingerprints are stored under their
value in each partition; probes are all values within t_i; what meets is verified.

Near copies differ in a binomial number of bits instead, so where a recall is stated, the programme chooses the cheapest
thresholds by which a pair at the least similarity agrees within t_i in some partition with that probability. Recall is
the same at every size; more fingerprints make partitions wider, and it is paid by more words and probes.

A value that more than `hot` fingerprints share isn't joined pair by pair. All fingerprints that are stored under such a
value or probe it are compared in blocks, each pair of blocks in one task, which returns a spanning forest of its links
instead of all pairs. No link is lost, and no task returns more rows than it holds fingerprints.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm._common import byte_texts, materialize, mixed, passes, small_batches, text_key, with_fields, word_hashes
from scriptorium.llm._components import components
from scriptorium.llm.decontaminate import shingle_hashes


@dataclass(frozen=True)
class Params:
    """words: 64-bit words of a fingerprint. sample bounds the fingerprints from which counts are estimated; block_rows and block_chars what one task holds from either side. recall: share of pairs at the similarity that is to be found, instead of max_bits."""

    shingle: int = 3
    words: int = 1
    max_bits: int = 2
    hot: int = 64
    sample: int = 2048
    block_rows: int = 4096
    block_chars: int = 8 << 20
    seed: int = 42
    recall: float | None = None
    similarity: float = 0.8


#: Five words and a Jaccard similarity of 0.8: fingerprints propose, shingle sets decide. near_params adds the words that a recall takes.
NEAR = Params(shingle=5, words=2, max_bits=15, hot=12)
#: Pairs that share a partition go on to the comparison of shingle sets within this share of differing bits; at a similarity of 0.8 about 0.15 differ.
NEAR_SHARE = 0.27
#: Words that candidates are compared by, and the recall of near copies at the least similarity.
NEAR_WORDS, NEAR_RECALL = 2, 0.99


# ---- fingerprints


def fingerprint_words(hashes: np.ndarray, words: int) -> list[int]:
    """Bit j is 1 if it is 1 in over half the hashes. The second and further words come from remixed hashes."""
    if not len(hashes):
        return [0] * words
    total = np.zeros(64 * words, dtype=np.int64)
    step = max(1, (1 << 16) // words)
    for k in range(0, len(hashes), step):
        h = hashes[k : k + step, None]
        if words > 1:
            h = np.concatenate((h, mixed(h + np.arange(1, words, dtype=np.uint64))), axis=1)
        total += np.unpackbits(np.ascontiguousarray(h, dtype="<u8").view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(total * 2 > len(hashes), bitorder="little").view("<i8").tolist()


def exact_hashes(words: list[bytes], k: int, seed: int) -> np.ndarray:
    """XXH64 of each k-word shingle, repeats included; of the whole sequence if it is shorter."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], dtype=np.uint64)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=False)], dtype=np.uint64)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.lower() changes A-Z only


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, p: Params) -> DataFrame:
    """docs without text, with f0, f1 ... (long), the words of each text's fingerprint; a text without words has zeros."""
    rest = docs.drop("text")
    names = [f"f{w}" for w in range(p.words)]
    schema = with_fields(rest, ", ".join(f"{n} long" for n in names))

    def run(batches):
        for batch in batches:
            found = [fingerprint_words(exact_hashes(words_of(t.as_py()), p.shingle, p.seed), p.words) for t in batch.column("text")]
            kept = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "text"]
            yield pa.record_batch([*kept, *(pa.array([f[w] for f in found], type=pa.int64()) for w in range(p.words))], names=schema.names)

    return docs.mapInArrow(run, schema)


def text_classes(docs: DataFrame, p: Params) -> DataFrame:
    """docs without text, with chars, h and h2 (128 bits that stand for the word sequence), and the fingerprint over distinct shingles.

    All of it comes from one pass over the texts. In a run of equal texts the fingerprint is made once.
    """
    rest = docs.drop("text")
    names = [f"f{w}" for w in range(p.words)]
    schema = with_fields(rest, "chars long, h long, h2 long, " + ", ".join(f"{n} long" for n in names))

    def run(batches):
        for batch in batches:
            chars, keys, prints, made = [], ([], []), [], {}
            for t in batch.column("text"):
                text = t.as_py() or ""
                words = words_of(text)
                both = xxhash.xxh3_128_intdigest(b" ".join(words))
                if both not in made:
                    data, _ = byte_texts([text])
                    h = word_hashes(data)[2]
                    made[both] = fingerprint_words(np.unique(shingle_hashes(h, min(p.shingle, len(h)))), p.words) if len(h) else [0] * p.words
                chars.append(len(text))
                keys[0].append(signed(both >> 64))
                keys[1].append(signed(both & (2**64 - 1)))
                prints.append(made[both])
            kept = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "text"]
            columns = [chars, *keys, *([f[w] for f in prints] for w in range(p.words))]
            yield pa.record_batch([*kept, *(pa.array(c, type=pa.int64()) for c in columns)], names=schema.names)

    return docs.mapInArrow(run, schema)


# ---- partitions and thresholds


def bit_matrix(sample: np.ndarray) -> np.ndarray:
    """sample: n x words (int64). n x bits of 0 and 1."""
    return np.unpackbits(np.ascontiguousarray(sample).astype("<i8").view(np.uint8).reshape(len(sample), -1), axis=1, bitorder="little")


def grouped_bits(bits: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in groups of about equal size; each group grows by the bit that correlates most with what it holds."""
    n = bits.shape[1]
    x = bits - bits.mean(axis=0)
    scale = np.sqrt((x * x).sum(axis=0))
    near = np.abs(x.T @ x) / np.maximum(np.outer(scale, scale), 1e-9)
    np.fill_diagonal(near, 0)
    free, out = list(range(n)), []
    for g in range(parts):
        size = len(free) // (parts - g)
        first = max(free, key=lambda b: (near[b, free].sum(), -b))
        group = [first]
        free.remove(first)
        while len(group) < size:
            best = max(free, key=lambda b: (near[b, group].sum(), -b))
            group.append(best)
            free.remove(best)
        out.append(sorted(group))
    return out


def ball(width: int, radius: int) -> int:
    return sum(math.comb(width, r) for r in range(radius + 1))


def thresholds(costs: list[list[float]], total: int) -> tuple[float, list[int]] | None:
    """costs[i][t + 1] is the cost of threshold t for partition i; the cheapest choice whose sum is the total."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for s, (cost, chosen) in best.items():
            for k, c in enumerate(row):
                t = k - 1
                if s + t not in new or cost + c < new[s + t][0]:
                    new[s + t] = (cost + c, [*chosen, t])
        best = new
    return best.get(total)


def narrowest(count: int) -> int:
    """A partition has about as many values as there are fingerprints, or else most values would be hot."""
    return min(32, max(8, math.ceil(math.log2(max(2, count))) - 2))


def bit_rate(similarity: float) -> float:
    """Share of bits in which texts of that Jaccard similarity differ, if they are equally long; less if not."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def agreeing(width: int, radius: int, rate: float) -> float:
    """Probability that `radius` or fewer of so many bits differ."""
    return sum(math.comb(width, r) * rate**r * (1 - rate) ** (width - r) for r in range(radius + 1))


def recall_of(parts: list[tuple[list[int], int]], rate: float) -> float:
    return 1 - math.prod(1 - agreeing(len(bits), t, rate) for bits, t in parts)


def recalling(costs: list[list[float]], widths: list[int], p: Params, steps: int = 1000) -> tuple[float, list[int]] | None:
    """costs[i][t + 1] is the cost of threshold t for partition i; the cheapest choice that reaches the recall."""
    rate, need = bit_rate(p.similarity), -math.log(1 - p.recall)
    gain = [[0, *(int(-math.log(1 - agreeing(w, t, rate)) / need * steps) for t in range(len(row) - 1))] for w, row in zip(widths, costs, strict=True)]
    best: dict[int, tuple[float, tuple]] = {0: (0.0, ())}
    for row, gains in zip(costs, gain, strict=True):
        new: dict[int, tuple[float, tuple]] = {}
        for s, (cost, chosen) in best.items():
            for k, c in enumerate(row):
                to = min(steps, s + gains[k])
                if to not in new or cost + c < new[to][0]:
                    new[to] = (cost + c, (chosen, k - 1))
        best = new
    if steps not in best:
        return None
    cost, chosen = best[steps]
    out = []
    while chosen:
        chosen, t = chosen
        out.append(t)
    return cost, out[::-1]


def near_params(count: int, similarity: float, recall: float = NEAR_RECALL) -> Params:
    """NEAR with as many words as reach the recall at the least cost: rows of the index and of probes, and the words themselves."""
    best = None
    for words in (2, 3, 4, 6, 8, 12, 16, 24, 32):
        p = replace(NEAR, words=words, recall=recall, similarity=similarity)
        width = narrowest(count)
        row = [0.0, *(1 + ball(width, t) for t in range(4) if ball(width, t) <= 6000)]
        parts = 64 * words // width
        got = recalling([row] * parts, [width] * parts, p)
        if got and (best is None or got[0] + 10 * words < best[0]):
            best = (got[0] + 10 * words, p)
    if best is None:
        raise ValueError("no number of words reaches this recall")
    return best[1]


def recall_plan(bits: np.ndarray, count: int, p: Params) -> list[tuple[list[int], int]]:
    """Partitions of neighbouring bits, which are independent for a pair, and their thresholds."""
    some, width = bits[: min(len(bits), 256)], narrowest(count)
    cuts = np.linspace(0, bits.shape[1], bits.shape[1] // width + 1).astype(int).tolist()
    groups = [list(range(a, b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    costs = []
    for g in groups:
        apart = (some[:, None, g] != bits[None, :, g]).sum(axis=2)
        others = [((apart <= t).sum() - len(some)) / apart.size for t in range(4)]  # without each one's meeting itself
        costs.append([0.0, *(1 + ball(len(g), t) + 0.05 * share * count for t, share in enumerate(others) if ball(len(g), t) <= 6000)])
    got = recalling(costs, [len(g) for g in groups], p)
    if got is None:
        raise ValueError("no thresholds for this recall")
    return [(g, t) for g, t in zip(groups, got[1], strict=True) if t >= 0]


def plan(sample: np.ndarray, count: int, p: Params) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition that is probed. count: all fingerprints."""
    bits = bit_matrix(sample) if len(sample) else np.zeros((1, 64 * p.words), dtype=np.uint8)
    if p.recall is not None:
        return recall_plan(bits, count, p)
    width = 64 * p.words
    some = bits[: min(len(bits), 256)]
    best = None
    for parts in range(max(1, -(-width // 32)), max(-(-width // 32), min(width // narrowest(count), p.max_bits + 2)) + 1):
        groups = grouped_bits(bits, parts)
        costs = []
        for g in groups:
            apart = (some[:, None, g] != bits[None, :, g]).sum(axis=2)
            shares = [(apart <= t).mean() for t in range(4)]
            costs.append([0.0, *(ball(len(g), t) + 0.05 * share * count for t, share in enumerate(shares) if ball(len(g), t) <= 6000)])
        got = thresholds(costs, p.max_bits - parts + 1)
        if got and (best is None or got[0] < best[0]):
            best = (got[0], [(g, t) for g, t in zip(groups, got[1], strict=True) if t >= 0])
    if best is None:
        raise ValueError("no thresholds for these parameters")
    return best[1]


# ---- candidates


def _value(bits: list[int]) -> Column:
    runs: list[list[int]] = []  # place in the value, first bit, number of neighbouring bits of one word
    for j, b in enumerate(bits):
        if runs and b == runs[-1][1] + runs[-1][2] and b % 64:
            runs[-1][2] += 1
        else:
            runs.append([j, b, 1])
    parts = [F.shiftleft(F.shiftrightunsigned(F.col(f"f{b // 64}"), b % 64).bitwiseAND(F.lit((1 << n) - 1).cast("long")), j) for j, b, n in runs]
    out = parts[0]
    for x in parts[1:]:
        out = out.bitwiseOR(x)
    return out


def _apart(words: int) -> Column:
    out = F.bit_count(F.col("f0").bitwiseXOR(F.col("g0"))).cast("int")
    for w in range(1, words):
        out = out + F.bit_count(F.col(f"f{w}").bitwiseXOR(F.col(f"g{w}")))
    return out


def _probes(value: Column, masks: list[int], even: int) -> Column:
    """The values to look up. Values an odd number of bits apart differ in parity, so of two such only the even one probes."""
    every, some = (F.array(*[F.lit(m).cast("long") for m in x]) for x in (masks, [m for m in masks if m.bit_count() % 2 == 0]))
    return F.transform(F.when(F.bit_count(value) % 2 == even, every).otherwise(some), lambda m: value.bitwiseXOR(m))


def links(nodes: DataFrame, p: Params, limit: int) -> DataFrame:
    """nodes: id and distinct fingerprints. Edges a, b whose components are those of the links within the limit (by the first NEAR_WORDS words) between nodes that share a value; an edge itself may join two nodes that have a partner in common."""
    count = nodes.count()
    names = [f"f{w}" for w in range(p.words)]
    rows = nodes.select(*names).orderBy(F.xxhash64(*names), *names).limit(p.sample).toPandas()
    parts = plan(rows.to_numpy(dtype=np.int64), count, p)
    stored, probed = [], []
    for i, (bits, radius) in enumerate(parts):
        value = F.lit(i << 32).cast("long").bitwiseOR(_value(bits))
        masks = [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(len(bits)), r)]
        stored.append(value)
        probed.append(_probes(value, masks, i.bit_count() % 2))
    names = names[:NEAR_WORDS]
    index = nodes.select("id", *names, F.explode(F.array(*stored)).alias("key"))
    probes = nodes.select("id", *names, F.explode(F.flatten(F.array(*probed))).alias("key"))
    hot = materialize(index.groupBy("key").count().where(F.col("count") > p.hot).select("key"), "hot-values")
    any_hot = not hot.isEmpty()
    cold = index.join(hot, "key", "left_anti") if any_hot else index
    other = cold.select("key", F.col("id").alias("other"), *[F.col(n).alias(n.replace("f", "g")) for n in names])
    met = probes.join(other.hint("merge"), "key").where((F.col("id") != F.col("other")) & (_apart(len(names)) <= limit))
    # within a group most pairs say the same: each node keeps its least partner, and that takes over the others
    pairs = hubs(met.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct())
    if not any_hot:
        return pairs
    members = index.join(hot, "key", "left_semi").unionByName(probes.join(hot, "key", "left_semi")).distinct()
    # a group of near copies is hot in many partitions; those of its nodes that most hot values hold are the hubs of all its stars
    members = members.withColumn("rank", F.count("*").over(Window.partitionBy("id"))).withColumnRenamed("key", "zone")
    return pairs.unionByName(hubs(linked_by_bits(materialize(members, "hot-members"), len(names), limit, p)))


def hubs(stars: DataFrame) -> DataFrame:
    """Edges a, b that join what the edges a (hub), b do: each b stays linked to its least hub, and that to b's other hubs. What b has is bounded by the values that it is stored under or probes, and by `hot` in each."""
    least = F.array_min("hubs")
    own = F.concat(F.array(F.struct(least.alias("a"), F.col("b"))), F.transform(F.filter("hubs", lambda x: x != least), lambda x: F.struct(least.alias("a"), x.alias("b"))))
    return stars.groupBy("b").agg(F.collect_set("a").alias("hubs")).select(F.inline(own)).distinct()


# ---- blocks


class Trees:
    """Nodes 0 to n - 1, joined by links; of each tree the star of its first node is kept."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, i: int, others: np.ndarray) -> None:
        for x in np.unique(self.label[others]).tolist():
            if x != self.label[i]:
                self.label[self.label == x] = self.label[i]

    def stars(self, ids: np.ndarray) -> pd.DataFrame:
        _, first, tree = np.unique(self.label, return_index=True, return_inverse=True)
        root = first[tree]
        other = np.flatnonzero(root != np.arange(len(ids)))
        return pd.DataFrame({"a": ids[root[other]], "b": ids[other]}, dtype="int64")


def in_blocks(zones: DataFrame, p: Params, chars: str | None) -> DataFrame:
    """zones: zone, id and more. Each row for every pair of blocks (x <= y) that its own block is part of; columns x, y."""
    size = zones.groupBy("zone").agg(F.count("*").alias("n"), (F.sum(chars) if chars else F.lit(0)).alias("c")).where("n > 1")
    blocks = F.greatest(F.ceil(F.col("n") / p.block_rows), F.ceil(F.col("c") / p.block_chars)).cast("int")
    out = zones.join(size.select("zone", blocks.alias("blocks")), "zone")
    out = out.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    return out.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"x": F.least("own", "o"), "y": F.greatest("own", "o")}).drop("o", "own", "blocks")


def linked_by_bits(zones: DataFrame, words: int, limit: int, p: Params) -> DataFrame:
    """A spanning forest of each pair of blocks of a zone, over links of `limit` or fewer differing bits: stars of the nodes of the highest rank."""
    names = [f"f{w}" for w in range(words)]

    def compare(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["rank", "id"], ascending=[False, True])
        data = f[names].to_numpy(dtype=np.int64).view(np.uint64)
        got = Trees(len(f))
        for i in range(len(f) - 1):
            near = np.flatnonzero(np.bitwise_count(data[i + 1 :] ^ data[i]).sum(axis=1, dtype=np.int64) <= limit)
            if len(near):
                got.join(i, near + i + 1)
        return got.stars(f["id"].to_numpy())

    return in_blocks(zones, p, None).groupBy("zone", "x", "y").applyInPandas(compare, "a long, b long")


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; of a text of fewer words that of the whole."""
    out = []
    for a, b in passes(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) if texts else np.zeros(0, np.int64)):
        data, offsets = byte_texts(texts[a:b])
        starts, _, h = word_hashes(data)
        cut = np.searchsorted(starts, offsets)
        for i in range(b - a):
            own = h[cut[i] : cut[i + 1]]
            out.append(np.unique(shingle_hashes(own, min(k, len(own)))) if len(own) else np.zeros(0, np.uint64))
    return out


def linked_by_sets(blocks: DataFrame, p: Params, similarity: float) -> DataFrame:
    """blocks: zone, x, y, id, text. A spanning forest of each pair of blocks, over links of that Jaccard similarity or more; counted by postings."""

    def compare(f: pd.DataFrame) -> pd.DataFrame:
        f = f.drop_duplicates("id").sort_values("id")
        sets = shingle_sets(f["text"].tolist(), p.shingle)
        sizes = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), sizes)
        values, place, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = n[place] > 1
        place, owner = place[shared], owner[shared]
        order = np.lexsort((owner, place))
        posting = owner[order]
        begin = np.searchsorted(place[order], np.arange(len(values) + 1))
        cut = np.searchsorted(owner, np.arange(len(sets) + 1))
        got = Trees(len(sets))
        for i in range(len(sets)):
            own = place[cut[i] : cut[i + 1]]
            if len(own) >= similarity * sizes[i]:
                common = np.zeros(len(sets), dtype=np.int64)
                for k in range(0, len(own), 4096):
                    part = own[k : k + 4096]
                    lengths = begin[part + 1] - begin[part]
                    at = np.repeat(begin[part] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
                    common += np.bincount(posting[at], minlength=len(sets))
                same = (common >= similarity * (sizes + sizes[i] - common) - 1e-9) & (common > 0)
                same[: i + 1] = False
                if same.any():
                    got.join(i, np.flatnonzero(same))
        return got.stars(f["id"].to_numpy())

    return blocks.groupBy("zone", "x", "y").applyInPandas(compare, "a long, b long")


# ---- operators


def simhash_components(docs: DataFrame, p: Params | None = None) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits a word), component_id for each row of docs.

    Fingerprints of max_bits or fewer differing bits are linked; component_id is the least doc_id that is reachable.
    Null, empty and white-space texts have fingerprint zero and are linked like any other. Rows whose doc_id is null
    get the component of their fingerprint, null if no row in it has an id. Repeated rows stay. Other columns are not read.
    """
    p = p or Params()
    if p.words != 1:
        raise ValueError("components are over fingerprints of one word")
    small_batches(docs.sparkSession)
    own = materialize(fingerprints(docs.select("doc_id", "text"), p), "fingerprints")
    nodes = materialize(own.groupBy(F.col("f0").alias("id")).agg(F.min("doc_id").alias("least")).withColumn("f0", F.col("id")), "nodes")
    found = components(links(nodes.select("id", "f0"), p, p.max_bits))
    named = nodes.join(found, "id", "left").select("id", "least", F.coalesce("component", "id").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select(F.col("id").alias("f0"), "component_id")
    return own.join(named, "f0").select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def near_duplicates(docs: DataFrame, similarity: float = 0.8, p: Params | None = None) -> DataFrame:
    """doc_id, text_key, class_id, class_key for each document: the class is named by the first of its group (least doc_id, then text_key).

    A document is a doc_id with a text: rows that share a doc_id and differ in text are two, told apart by text_key; equal
    rows are one. Texts are compared by their distinct five-word shingles with A-Z lower-cased; texts without words are
    copies of each other. Documents of equal word sequence are one node before anything else. Rows whose doc_id is null
    take no part. doc_id may be of any type that has an order.
    """
    small_batches(docs.sparkSession)
    base = docs.where(F.col("doc_id").isNotNull()).select("doc_id", text_key(F.col("text")).alias("text_key"), "text")
    p = p or near_params(base.count(), similarity)
    prints = [f"f{w}" for w in range(p.words)]
    rows = materialize(text_classes(base, p), "text-classes")
    nodes = rows.groupBy("h", "h2", *prints).agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.max("chars").alias("chars"))
    # h names a node; should two share it, h2 tells them apart
    again = F.row_number().over(Window.partitionBy("h").orderBy("h2")) > 1
    nodes = materialize(nodes.select(F.when(again, F.xxhash64("h2", "h")).otherwise(F.col("h")).alias("id"), "h", "h2", *prints, "first", "chars"), "nodes")
    limit = int(NEAR_SHARE * 64 * min(p.words, NEAR_WORDS))
    zones = components(links(nodes.select("id", *prints), p, limit)).withColumnRenamed("component", "zone")
    zones = zones.join(nodes.select("id", "chars", F.col("first.doc_id").alias("doc_id"), F.col("first.text_key").alias("text_key")), "id")
    # texts are joined last, and by a merge at every size
    blocks = in_blocks(materialize(zones, "zones"), p, "chars").select("zone", "x", "y", "id", "doc_id", "text_key")
    found = components(linked_by_sets(base.join(blocks.hint("merge"), ["doc_id", "text_key"]).select("zone", "x", "y", "id", F.coalesce("text", F.lit("")).alias("text")), p, similarity))
    named = nodes.join(found, "id", "left").select("h", "h2", "first", F.coalesce("component", "id").alias("component"))
    least = named.groupBy("component").agg(F.min("first").alias("class"))
    named = named.join(least, "component").select("h", "h2", "class")
    return rows.join(named, ["h", "h2"]).select("doc_id", "text_key", F.col("class.doc_id").alias("class_id"), F.col("class.text_key").alias("class_key")).distinct()


def drop_near_duplicates(docs: DataFrame, similarity: float = 0.8, p: Params | None = None) -> DataFrame:
    """docs with one row of each group of copies and near copies, that of the least doc_id (of the least text_key, if ids are shared).

    Of rows equal in doc_id and text one stays. Rows whose doc_id is null stay. An empty table gives an empty result; other
    columns are carried along, whatever their names.
    """
    gone = near_duplicates(docs, similarity, p).where("doc_id <> class_id or text_key <> class_key").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"))
    known = docs.where(F.col("doc_id").isNotNull()).withColumn("__of", text_key(F.col("text")))
    kept = known.join(gone.hint("merge"), (F.col("doc_id") == F.col("__id")) & (F.col("__of") == F.col("__key")), "left_anti")
    return kept.dropDuplicates(["doc_id", "__of"]).select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))
