"""Substring dedup: word sequences that stand more than once are cut out, found with prefix-partitioned suffix trees.

Of the suffixes of all texts (from a word to the end of its text) those are kept that begin where the hash of `prefix` words
is the least within a window (leftmost of equal ones); each window of `window` words holds such a place, and equal windows
hold it at the same offset. Suffixes are split by their prefixes of that length. A prefix that stands once leads to no
repeat and is dropped; the others are split into groups that fit into memory, one subtree each. A prefix with more
suffixes than a group may have is lengthened to the whole window, where it is a deep node itself and is only counted.

A subtree is held in its array form: sorted suffixes and the lengths of their common prefixes, whose intervals are the
internal nodes. As a window may begin some words before its suffix, the words before are held in a second tree, read
backwards. A window that begins l words before is repeated if its leaf shares an internal node `window` - l words deep, and
one l words deep in the backward tree, with the same other leaf. Adjoining repeated windows make up the maximal repeats.

Equal texts are one text with a count, and so are equal pieces of texts, before anything is grouped: a group of copies is
one leaf. Comparison is by the words' bytes; hashes only choose places and groups.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm._common import materialize, mixed, passes, small_batches, with_fields, word_hashes


@dataclass(frozen=True)
class Params:
    """window: words of the shortest repeat; prefix: words that suffixes are split by; group_rows: distinct pieces that one prefix's subtree may have, beyond which it is lengthened; bucket_rows: pieces of all the prefixes that a task takes together, on average."""

    window: int = 35
    prefix: int = 10
    group_rows: int = 20_000
    bucket_rows: int = 20_000


def keys(text) -> list:
    """128 bits of a text, as two columns."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """For each i the place of the least (leftmost) of the values from i to i + width - 1."""
    at, span = np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        if len(values) <= step:
            return np.zeros(0, dtype=np.int64)
        less = values[step:] < values[:-step]
        values, at = np.where(less, values[step:], values[:-step]), np.where(less, at[step:], at[:-step])
        span += step
    return at


@dataclass
class Suffixes:
    """Of some texts: starts and ends of words in the joined bytes, the first word of each text (and one more); for each kept suffix its owner, word, prefix hash and the first and last window that it decides."""

    data: bytes
    starts: np.ndarray
    ends: np.ndarray
    firsts: np.ndarray
    owner: np.ndarray
    word: np.ndarray
    value: np.ndarray
    low: np.ndarray
    high: np.ndarray


def suffixes(raws: list[bytes], p: Params) -> Suffixes:
    data = b"\n".join(raws) + b"\n"
    shown = np.frombuffer(data.replace(b"\0", b"\1") if b"\0" in data else data, dtype=np.uint8)
    starts, ends, h = word_hashes(shown)
    offsets = np.concatenate(([0], np.cumsum(np.fromiter(map(len, raws), dtype=np.int64, count=len(raws)) + 1)))
    firsts = np.searchsorted(starts, offsets)
    none = np.zeros(0, dtype=np.int64)
    if len(h) < p.window:
        return Suffixes(data, starts, ends, firsts, none, none, np.zeros(0, np.uint64), none, none)
    g = np.zeros(len(h) - p.prefix + 1, dtype=np.uint64)
    for j in range(p.prefix):
        g = g * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(g)]
    g = mixed(g)
    at = least_places(g, p.window - p.prefix + 1)
    owner = np.searchsorted(firsts, np.arange(len(at)), side="right") - 1
    i = np.flatnonzero(np.arange(len(at)) + p.window <= firsts[owner + 1])
    if not len(i):
        return Suffixes(data, starts, ends, firsts, none, none, np.zeros(0, np.uint64), none, none)
    a = at[i]
    new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (i[1:] != i[:-1] + 1))))
    last = np.append(new[1:], len(i)) - 1
    return Suffixes(data, starts, ends, firsts, owner[i[new]], a[new], g[a[new]], i[new], i[last])


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    """Some texts at a time, with the place of the first."""
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
    for a, b in passes(np.fromiter(map(len, raws), dtype=np.int64, count=len(raws))):
        yield a, raws[a:b]


def prefixes(texts: DataFrame, p: Params) -> DataFrame:
    """k1, k2, v, n: how often each prefix hash begins a kept suffix of a text."""

    def find(batches):
        for batch in batches:
            for a, raws in _texts(batch):
                s = suffixes(raws, p)
                order = np.lexsort((s.value, s.owner))
                o, v = s.owner[order], s.value[order]
                cut = np.flatnonzero(np.concatenate(([True], (o[1:] != o[:-1]) | (v[1:] != v[:-1])))) if len(o) else np.zeros(0, np.int64)
                n = np.diff(np.append(cut, len(o)))
                rows = pa.array(a + o[cut])
                yield pa.record_batch([batch.column("k1").take(rows), batch.column("k2").take(rows), pa.array(v[cut].view(np.int64)), pa.array(n.astype(np.int32))], names=["k1", "k2", "v", "n"])

    return texts.mapInArrow(find, "k1 long, k2 long, v long, n int")


def pieces(texts: DataFrame, p: Params) -> DataFrame:
    """k1, k2, word, f, v, least, most, piece, copies: each kept suffix whose prefix hash is in `wanted`, with the words of all windows that it decides.

    They begin `least` to `most` words before it. f: 128 bits of the piece; piece is null where an equal one came just before.
    """

    def cut(batches):
        for batch in batches:
            copies, wanted = batch.column("copies").to_numpy(), batch.column("wanted")
            for a, raws in _texts(batch):
                s = suffixes(raws, p)
                hit = np.zeros(len(s.owner), dtype=bool)
                edge = np.searchsorted(s.owner, np.arange(len(raws) + 1))
                for d in range(len(raws)):
                    mine = slice(edge[d], edge[d + 1])
                    if edge[d] < edge[d + 1]:
                        hit[mine] = np.isin(s.value[mine].view(np.int64), np.asarray(wanted[a + d].values))
                at = np.flatnonzero(hit)
                low, high = s.low[at], s.high[at]
                most, least = (s.word[at] - low).astype(np.int32), (s.word[at] - high).astype(np.int32)
                seen: set[bytes] = set()
                names, found = [], []
                for x, y, m in zip(s.starts[low].tolist(), s.ends[high + p.window - 1].tolist(), most.tolist(), strict=True):
                    piece = b" ".join(s.data[x:y].split())
                    name = hashlib.blake2b(piece, digest_size=16, salt=m.to_bytes(4, "little")).digest()
                    names.append(name)
                    found.append(None if name in seen else piece)
                    seen.add(name)
                rows = pa.array(a + s.owner[at])
                yield pa.record_batch(
                    [batch.column("k1").take(rows), batch.column("k2").take(rows), pa.array((s.word[at] - s.firsts[s.owner[at]]).astype(np.int32)), pa.array(names, type=pa.binary()), pa.array(s.value[at].view(np.int64)),
                     pa.array(least), pa.array(most), pa.array(found, type=pa.binary()), pa.array(copies[a + s.owner[at]])],
                    names=["k1", "k2", "word", "f", "v", "least", "most", "piece", "copies"],
                )

    return texts.mapInArrow(cut, "k1 long, k2 long, word int, f binary, v long, least int, most int, piece binary, copies long")


def tree(rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows (word numbers, as many as their lengths say), and the common prefix of each with the one before: a suffix tree in array form."""
    if not rows.shape[1]:
        return np.arange(len(rows)), np.zeros(len(rows), dtype=np.int64)
    order = np.lexsort(rows.T[::-1])
    same = rows[order][1:] == rows[order][:-1]
    shared = np.where(same.all(axis=1), rows.shape[1], np.argmin(same, axis=1))
    return order, np.concatenate(([0], np.minimum(shared, np.minimum(lengths[order][1:], lengths[order][:-1]))))


def nodes(order: np.ndarray, shared: np.ndarray, depth: int) -> np.ndarray:
    """For each row the number of its node at a depth."""
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(shared < depth) if depth else np.zeros(len(order), dtype=np.int64)
    return out


def repeated(found: list[bytes], least: np.ndarray, most: np.ndarray, n: np.ndarray, p: Params) -> np.ndarray:
    """For each piece the windows that stand more than once: bit l for the one that begins l words before its suffix. n: how often the piece stands."""
    words = pc.split_pattern(pa.array(found, type=pa.large_binary()), pattern=b" ")
    code, cuts = words.flatten().dictionary_encode().indices.to_numpy(), words.offsets.to_numpy()
    size = np.diff(cuts)
    ahead = np.arange(p.window)[None, :]
    behind = np.arange(1, p.window - p.prefix + 1)[None, :]
    right = np.where(ahead < (size - most)[:, None], code[np.minimum(cuts[:-1, None] + most[:, None] + ahead, len(code) - 1)], -1)
    left = np.where(behind <= most[:, None], code[np.maximum(cuts[:-1, None] + most[:, None] - behind, 0)], -1)
    forward, backward = tree(right, np.minimum(size - most, p.window)), tree(left, most)
    out = np.zeros(len(found), dtype=np.int64)
    for x in range(p.window - p.prefix + 1):
        mine = np.flatnonzero((least <= x) & (x <= most))
        if not len(mine):
            continue
        pair = nodes(*forward, p.window - x)[mine] * (len(found) + 1) + nodes(*backward, x)[mine]
        _, inverse = np.unique(pair, return_inverse=True)
        out[mine[np.bincount(inverse, weights=n[mine])[inverse] > 1]] |= 1 << x
    return out


def _subtrees(distinct: DataFrame, p: Params) -> DataFrame:
    """f, mask of pieces whose prefixes have few enough suffixes."""
    buckets = max(1, -(-distinct.count() // p.bucket_rows))

    def grow(rows: pa.Table) -> pa.Table:
        mask = repeated(rows.column("piece").to_pylist(), rows.column("least").to_numpy(), rows.column("most").to_numpy(), rows.column("n").to_numpy(), p)
        return pa.table({"f": rows.column("f"), "mask": pa.array(mask)})

    return distinct.withColumn("bucket", F.pmod(F.xxhash64("v"), F.lit(buckets))).groupBy("bucket").applyInArrow(grow, "f binary, mask long")


def _counted(distinct: DataFrame, p: Params) -> DataFrame:
    """f, mask of the others: their windows, as prefixes at their whole length, are counted."""

    def lengthen(batches):
        for batch in batches:
            f, at, name, n = [], [], [], []
            for key, piece, least, most, times in zip(*(batch.column(c).to_pylist() for c in ("f", "piece", "least", "most", "n")), strict=True):
                w = piece.split(b" ")
                for x in range(least, most + 1):
                    f.append(key)
                    at.append(x)
                    name.append(hashlib.blake2b(b" ".join(w[most - x : most - x + p.window]), digest_size=16).digest())
                    n.append(times)
            yield pa.record_batch([pa.array(f, type=pa.binary()), pa.array(at, type=pa.int32()), pa.array(name, type=pa.binary()), pa.array(n, type=pa.int64())], names=["f", "x", "name", "n"])

    windows = materialize(distinct.mapInArrow(lengthen, "f binary, x int, name binary, n long"), "long-prefixes")
    deep = windows.groupBy("name").agg(F.sum("n").alias("n")).where("n > 1").select("name")
    return windows.join(deep, "name").groupBy("f").agg(F.bit_or(F.expr("shiftleft(1L, x)")).alias("mask"))


def repeats(docs: DataFrame, p: Params | None = None) -> DataFrame:
    """k1, k2, marks: for each text (by keys()) that has repeated windows, an array of struct(word, mask): the window that begins l words before that word is repeated if bit l of the mask is set."""
    p = p or Params()
    small_batches(docs.sparkSession)
    own = docs.where(F.col("text").isNotNull()).select(*keys(F.col("text")), "text")
    found = materialize(prefixes(own, p), "suffix-prefixes")
    twice = found.groupBy("v").agg(F.sum("n").alias("n")).where("n > 1").select("v")
    wanted = found.select("k1", "k2", "v").join(twice, "v").groupBy("k1", "k2").agg(F.collect_set("v").alias("wanted"))
    texts = own.groupBy("k1", "k2").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    all_pieces = materialize(pieces(texts.join(wanted.hint("merge"), ["k1", "k2"]), p), "suffix-pieces")
    distinct = all_pieces.groupBy("f").agg(*[F.max(c).alias(c) for c in ("v", "least", "most", "piece")], F.sum("copies").alias("n"))
    distinct = materialize(distinct, "distinct-pieces")
    large = materialize(distinct.groupBy("v").agg(F.count("*").alias("rows")).where(F.col("rows") > p.group_rows).select("v"), "long-groups")
    if large.isEmpty():
        masks = _subtrees(distinct, p)
    else:
        masks = _subtrees(distinct.join(large, "v", "left_anti"), p).unionByName(_counted(distinct.join(large, "v", "left_semi"), p))
    masks = materialize(masks.where("mask <> 0"), "repeated-windows")
    return all_pieces.select("k1", "k2", "word", "f").join(masks, "f").groupBy("k1", "k2").agg(F.collect_list(F.struct("word", "mask")).alias("marks"))


def covered(marks: list[tuple[int, int]], n_words: int, p: Params) -> np.ndarray:
    """Which words of a text lie in repeated windows."""
    edge = np.zeros(n_words + 1, dtype=np.int64)
    word, mask = np.array([m[0] for m in marks], dtype=np.int64), np.array([m[1] for m in marks], dtype=np.int64)
    for x in range(p.window - p.prefix + 1):
        at = word[(mask >> x) & 1 == 1] - x
        np.add.at(edge, at, 1)
        np.add.at(edge, at + p.window, -1)
    return np.cumsum(edge)[:n_words] > 0


def dedup_substrings(docs: DataFrame, p: Params | None = None) -> DataFrame:
    """docs with text cut down to the words that no repeated window covers, joined by one space, and the added columns n_words and n_removed (those of these names are replaced).

    Words are parted by \\x20 and \\x09-\\x0D and compared as they are. Every occurrence goes, the first too; windows are
    judged on the input. Rows are judged by their text alone, so repeated rows, repeated ids and null ids are nothing
    special: of two rows with one text of a window or more nothing stays. A null text stays null with no words; texts
    shorter than a window lose nothing. An empty table gives an empty result.
    """
    p = p or Params()
    base = docs.drop("n_words", "n_removed")
    marks = materialize(repeats(base.select("text"), p), "repeat-marks").withColumnsRenamed({"k1": "__k1", "k2": "__k2", "marks": "__marks"})
    k1, k2 = keys(F.col("text"))
    joined = base.join(marks.hint("merge"), (k1 == F.col("__k1")) & (k2 == F.col("__k2")), "left").select(*base.columns, "__marks")
    schema = with_fields(base, "n_words long, n_removed long")
    columns, names = base.columns, schema.names

    def cut(batches):
        for batch in batches:
            texts, total, gone = [], [], []
            for t, m in zip(batch.column("text").to_pylist(), batch.column("__marks"), strict=True):
                raw = (t or "").encode("utf-8", "surrogatepass").split()
                total.append(len(raw))
                n = 0
                if m.is_valid:
                    hit = covered([(x["word"], x["mask"]) for x in m.as_py()], len(raw), p)
                    n = int(hit.sum())
                    raw = [w for w, h in zip(raw, hit.tolist(), strict=True) if not h]
                gone.append(n)
                texts.append(None if t is None else b" ".join(raw).decode("utf-8", "surrogatepass"))
            own = [pa.array(texts, type=batch.schema.field("text").type) if c == "text" else batch.column(c) for c in columns]
            yield pa.record_batch([*own, pa.array(total, type=pa.int64()), pa.array(gone, type=pa.int64())], names=names)

    return joined.mapInArrow(cut, schema)


def oracle(p: Params | None = None, docs: str = "documents") -> str:
    """DuckDB SQL for doc_id, n_words, n_removed, kept_sha256; doc_ids are unique."""
    w = (p or Params()).window
    return f"""
WITH a AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM {docs}),
s AS (SELECT doc_id, unnest(w) AS s, generate_subscripts(w, 1) AS i, len(w) AS n FROM a),
x AS (SELECT doc_id, i, n, list(s) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING) AS x FROM s),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY x) AS c FROM x WHERE i <= n - {w - 1}) WHERE c > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + {w})) AS i FROM r),
k AS (SELECT s.doc_id, count(g.i) AS n_removed, string_agg(s, ' ' ORDER BY s.i) FILTER (WHERE g.i IS NULL) AS t FROM s LEFT JOIN g ON s.doc_id = g.doc_id AND s.i = g.i GROUP BY s.doc_id)
SELECT a.doc_id, len(a.w)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256 FROM a LEFT JOIN k ON a.doc_id = k.doc_id"""
