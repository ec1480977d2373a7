"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Short test items are looked for in long documents. A document's distinct word shingles are first cut down to those that
any item has (this leaves |item & document| as it is), which makes the set that is searched about as small as an item. Documents are
partitioned by the size of that set; each partition has its own bands and rows, so chosen that an item whose containment
is at the threshold collides with a probability of `recall` or more given the partition's largest size. Where no setting
reaches that (very small items against documents that hold many), shared shingles are counted instead, which misses none.
Every candidate is verified on the shingles themselves.

Items are taken in blocks of at most `block_chars` characters, each sent to the tasks as an index. Documents are never
shuffled: the pairs of a block are one pass over them, and where only the hits are to go, every block is a step of the same pass.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm._common import byte_texts, lowered, mixed, passes, small_batches, word_hashes


@dataclass(frozen=True)
class Params:
    """shingle: words a shingle has; an item of fewer words is one shingle of all its words."""

    shingle: int = 5
    threshold: float = 0.8
    hashes: int = 64
    recall: float = 0.9999
    block_chars: int = 4 << 20
    seed: int = 5


def words_of(text: str | None) -> list[bytes]:
    return lowered(np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)).tobytes().split()


def shingles(words: list[bytes], k: int) -> set[bytes]:
    return {b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)}


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k words from each on."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    return mixed(out)


def setting(item: int, most: int, p: Params) -> tuple[int, int] | None:
    """Bands and rows for items of at least so many shingles and documents of at most so many; None if none is safe."""
    shared = p.threshold * item
    similarity = min(1.0, shared / (item + most - shared)) if most >= shared else 1.0
    for rows in (8, 4, 2, 1):
        bands = p.hashes // rows
        if 1 - (1 - similarity**rows) ** bands >= p.recall:
            return bands, rows
    return None


class Index:
    """The items of one block with the same shingle length."""

    def __init__(self, items: list[tuple[object, list[bytes]]], k: int, p: Params):
        self.k, self.p = k, p
        self.ids = [i for i, _ in items]
        self.sets = [shingles(w, k) for _, w in items]
        self.sizes = np.array([len(s) for s in self.sets], dtype=np.int64)
        hashes = []
        for s in self.sets:  # a shingle's k words, hashed as in documents
            data, _ = byte_texts([x.decode("utf-8", "surrogatepass") for x in sorted(s)])
            hashes.append(np.unique(shingle_hashes(word_hashes(data)[2], k)[::k]) if s else np.zeros(0, np.uint64))
        self.universe = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
        self.item_sets = [np.searchsorted(self.universe, h) for h in hashes]
        self.filter = np.zeros(1 << 22, dtype=bool)
        self.filter[self.universe >> np.uint64(42)] = True
        random = np.random.default_rng(p.seed)
        self.salt = random.integers(1, 2**63, p.hashes, dtype=np.uint64)
        self.signatures = np.array([self.signature(s) for s in self.item_sets], dtype=np.uint64).reshape(len(items), p.hashes)
        self.least = max(1, int(np.ceil(p.threshold * self.sizes.min() - 1e-9)))
        owner = np.repeat(np.arange(len(items)), [len(s) for s in self.item_sets])
        flat = np.concatenate(self.item_sets)
        order = np.argsort(flat, kind="stable")
        self.posting, self.post_at = owner[order], np.searchsorted(flat[order], np.arange(len(self.universe) + 1))
        self.bands: dict[tuple[int, int], list[dict[bytes, list[int]]]] = {}

    def signature(self, found: np.ndarray) -> np.ndarray:
        if not len(found):
            return np.zeros(self.p.hashes, dtype=np.uint64)
        h = self.universe[found]
        return np.array([mixed(h ^ s).min() for s in self.salt], dtype=np.uint64)

    def tables(self, bands: int, rows: int) -> list[dict[bytes, list[int]]]:
        if (bands, rows) not in self.bands:
            out: list[dict[bytes, list[int]]] = [{} for _ in range(bands)]
            for i, s in enumerate(self.signatures):
                for b in range(bands):
                    out[b].setdefault(s[b * rows : (b + 1) * rows].tobytes(), []).append(i)
            self.bands[bands, rows] = out
        return self.bands[bands, rows]

    def candidates(self, found: np.ndarray) -> list[int]:
        """Items that may be contained, given the document's shingles among the universe."""
        most = 1 << int(len(found) - 1).bit_length()  # the partition of sizes in (most / 2, most]
        got = setting(int(self.sizes.min()), most, self.p)
        if got is None:
            parts = [self.posting[self.post_at[x] : self.post_at[x + 1]] for x in found]
            n = np.bincount(np.concatenate(parts), minlength=len(self.ids))
            return np.flatnonzero(n >= self.p.threshold * self.sizes - 1e-9).tolist()
        s, out = self.signature(found), set()
        for b, table in enumerate(self.tables(*got)):
            out.update(table.get(s[b * got[1] : (b + 1) * got[1]].tobytes(), ()))
        return sorted(out)

    def search(self, text: str, found: np.ndarray) -> list[tuple[object, int, int]]:
        likely = self.candidates(found)
        if not likely:
            return []
        own = shingles(words_of(text), self.k)
        shared = [(self.ids[i], len(self.sets[i] & own), len(self.sets[i])) for i in likely]
        return [x for x in shared if x[1] >= self.p.threshold * x[2] - 1e-9]


def indexes_of(items: DataFrame, p: Params):
    """The indexes of each block of items in turn, one for each shingle length."""
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-int(chars) // p.block_chars) if chars else 0
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).where("text is not null").select("item_id", "text").toArrow().to_pylist()
        by_k: dict[int, list] = {}
        for r in rows:
            w = words_of(r["text"])
            if w:
                by_k.setdefault(min(p.shingle, len(w)), []).append((r["item_id"], w))
        if by_k:
            yield [Index(v, k, p) for k, v in sorted(by_k.items())]


def contained_items(docs: DataFrame, items: DataFrame, p: Params | None = None) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment: every pair whose containment (share of the item's distinct shingles) is at the threshold or above.

    Texts are compared by their words with A-Z lower-cased. Null and empty texts and items without words match nothing.
    Repeated document rows give repeated pairs; of items that share an id each is searched for by itself. Empty tables give
    an empty result. Other columns are not read.
    """
    p = p or Params()
    small_batches(docs.sparkSession)
    kinds = dict(docs.dtypes)["doc_id"], dict(items.dtypes)["item_id"]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, n_shared long, n_item long"
    out = docs.sparkSession.createDataFrame([], schema)
    own = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    for indexes in indexes_of(items, p):
        out = out.unionByName(own.mapInArrow(searching(indexes, schema), schema))
    return out.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def hits(texts: list[str | None], indexes: list[Index]):
    """(place in texts, item id, shared, size) of every item that a text contains."""
    for a, b in passes(np.fromiter((len(t or "") for t in texts), dtype=np.int64, count=len(texts))):
        data, offsets = byte_texts(texts[a:b])
        starts, _, h = word_hashes(data)
        owner = np.searchsorted(offsets, starts, side="right") - 1
        for index in indexes:
            s = shingle_hashes(h, index.k)
            at = np.flatnonzero(index.filter[s >> np.uint64(42)])
            at = at[owner[at] == owner[at + index.k - 1]]
            place = np.minimum(np.searchsorted(index.universe, s[at]), len(index.universe) - 1)
            same = index.universe[place] == s[at]
            pair = np.unique(owner[at[same]].astype(np.int64) * len(index.universe) + place[same])
            if not len(pair):
                continue
            docs_hit, cut = np.unique(pair // len(index.universe), return_index=True)
            for d, found in zip(docs_hit.tolist(), np.split(pair % len(index.universe), cut[1:]), strict=True):
                if len(found) >= index.least:
                    yield from ((a + d, *x) for x in index.search(texts[a + d], found))


def searching(indexes: list[Index], schema: str):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def search(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            rows = [(ids[d], *x) for d, *x in hits(batch.column("text").to_pylist(), indexes)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], names=kinds.names)

    return search


def clearing(indexes: list[Index]):
    def clear(batches):
        for batch in batches:
            keep = np.ones(batch.num_rows, dtype=bool)
            keep[sorted({d for d, *_ in hits(batch.column("text").to_pylist(), indexes)})] = False
            yield batch if keep.all() else batch.filter(pa.array(keep))

    return clear


def drop_contaminated(docs: DataFrame, items: DataFrame, p: Params | None = None) -> DataFrame:
    """docs without the rows whose text holds an item; each row is judged by its own text, whatever ids it shares or lacks.

    Columns and their names are carried along. Null and empty texts stay, and so does everything if no item has words.
    """
    p = p or Params()
    small_batches(docs.sparkSession)
    out = docs
    for indexes in indexes_of(items, p):
        out = out.mapInArrow(clearing(indexes), docs.schema)
    return out


def oracle(p: Params | None = None, docs: str = "documents", items: str = "benchmark") -> str:
    p = p or Params()
    word = r"'[^\x20\x09-\x0D]+'"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH i AS (SELECT item_id, regexp_extract_all({low}, {word}) AS w FROM {items}), n AS (SELECT item_id, w, least({p.shingle}, len(w)) AS k FROM i WHERE len(w) > 0),
s AS (SELECT DISTINCT item_id, k, array_to_string(w[j:j + k - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS j FROM n)),
c AS (SELECT item_id, count(*) AS n_item FROM s GROUP BY item_id),
d AS (SELECT doc_id, regexp_extract_all({low}, {word}) AS w FROM {docs}),
t AS (SELECT DISTINCT doc_id, k, array_to_string(w[j:j + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS j FROM d, (SELECT DISTINCT k FROM n)))
SELECT doc_id, item_id, count(*) AS n_shared, any_value(n_item) AS n_item, count(*) / any_value(n_item) AS containment
FROM t JOIN s USING (k, s) JOIN c USING (item_id) GROUP BY doc_id, item_id HAVING count(*) >= {p.threshold} * any_value(n_item) - 1e-9"""
