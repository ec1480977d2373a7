"""Ranked lexical search: Block-Max WAND over an index of compressed posting blocks.

The index is a table. Documents are taken in shards as they are read, without a shuffle; in a shard a term's postings stand in
document order in blocks of a fixed number of postings, each a row with its first and last document, its greatest impact,
and the postings themselves as variable-length differences and frequencies.

A search reads the blocks of its terms and groups them by shard. All pointers of a query move over the documents together,
from the end of one block to the next: the shallow move looks up which blocks cover a stretch of documents and adds up
their greatest impacts. A stretch whose sum does not reach the score of the k-th best document so far is passed over; only
the blocks of the others are decompressed, and their documents scored. The stretches of the greatest sums are scored first,
so that the threshold is high when the others are passed through in document order. A shard gives its k best of each query.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm._common import lowered, materialize, small_batches

#: Maximal matches are terms, A-Z lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Params:
    """k: documents for each query; block: postings of a block; shard_chars: characters of a shard's texts; query_chars: of the queries that one pass over the index takes; step: stretches of documents scored before the first look at the threshold, twice as many before each further one."""

    k: int = 20
    block: int = 64
    shard_chars: int = 16 << 20
    query_chars: int = 1 << 20
    step: int = 16


@dataclass(frozen=True)
class Index:
    """blocks: shard, term, block, first, last, n, top, payload; a shard's row with the empty term has ids and m of its documents instead. n_docs: those with a term; n_terms: of all of them."""

    blocks: DataFrame
    n_docs: int
    n_terms: int


def terms_in(raws: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct terms; for each occurrence the number of its term and of its text."""
    data = lowered(np.frombuffer(b" ".join(raws) + b" ", dtype=np.uint8))
    inside = (data >= 128) | ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57))
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    offsets = np.concatenate(([0], np.cumsum(np.fromiter(map(len, raws), dtype=np.int64, count=len(raws)) + 1)))
    owner = np.searchsorted(offsets, starts, side="right") - 1
    cuts = np.concatenate(([0], np.cumsum(ends - starts)))
    found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data[inside].tobytes())]).dictionary_encode()
    return found.dictionary, found.indices.to_numpy(), owner


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the values, seven bits each and the eighth for more to come, and where each value ends."""
    size = 1 + sum((values >= 1 << 7 * k).astype(np.int64) for k in range(1, 9))
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    for k in range(int(size.max(initial=0))):
        more = np.flatnonzero(size > k)
        out[ends[more] - size[more] + k] = ((values[more] >> 7 * k) & 127) | np.where(size[more] - 1 > k, 128, 0)
    return out, ends


def unpacked(data: np.ndarray) -> np.ndarray:
    if not len(data):
        return np.zeros(0, dtype=np.int64)
    ends = np.flatnonzero(data < 128)
    starts = np.concatenate(([0], ends[:-1] + 1))
    place = np.arange(len(data)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * place), starts)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def posting_blocks(raws: list[bytes], n_docs: int, n_terms: int, p: Params) -> tuple[dict[str, pa.Array], np.ndarray]:
    """The columns of the blocks of some texts, in their order, and m of each text."""
    names, code, owner = terms_in(raws)
    m = 75 + (25 * np.bincount(owner, minlength=len(raws)) * n_docs) // n_terms
    pair, tf = np.unique((code.astype(np.int64) << 32) | owner, return_counts=True)
    term, doc = pair >> 32, pair & 0xFFFFFFFF
    new = np.concatenate(([True], term[1:] != term[:-1])) if len(term) else np.zeros(0, dtype=bool)
    nth = np.arange(len(term)) - np.flatnonzero(new)[np.cumsum(new) - 1] if len(term) else term
    begin = np.flatnonzero(nth % p.block == 0)
    end = np.append(begin[1:], len(term)) if len(begin) else begin
    step = np.where(nth % p.block == 0, 0, np.concatenate(([0], np.diff(doc))) if len(doc) else doc)
    data, ends = packed(np.column_stack((step, tf)).ravel())
    cuts = np.concatenate(([0], ends[2 * end - 1])) if len(end) else np.zeros(1, dtype=np.int64)
    top = np.maximum.reduceat(impact(tf, m[doc]), begin) if len(begin) else np.zeros(0, dtype=np.int64)
    payload = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data.tobytes())])
    i32 = lambda x: pa.array(x.astype(np.int32))
    columns = {"term": names.take(pa.array(term[begin])).cast(pa.binary()), "block": i32(nth[begin] // p.block), "first": i32(doc[begin]), "last": i32(doc[end - 1]), "n": i32(end - begin), "top": pa.array(top), "payload": payload}
    return columns, m


def build_index(docs: DataFrame, p: Params | None = None) -> Index:
    """The index of all rows of docs (doc_id, text; other columns are not read), as a table in the shared folder. A null text has no terms."""
    from pyspark import TaskContext
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    p = p or Params()
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    sizes = own.select(F.regexp_count("text", F.lit(TERM)).cast("long").alias("n"), F.length("text").cast("long").alias("chars"))
    seen = sizes.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.sum("n").alias("terms"), F.sum("chars").alias("chars")).first()
    n_docs, n_terms = seen["docs"], seen["terms"] or 0
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"shard string, term binary, block int, first int, last int, n int, top long, payload binary, ids array<{kind}>, m array<long>"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def shard(name: str, rows: list[tuple[object, str]]) -> pa.RecordBatch:
        rows.sort(key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0))
        columns, m = posting_blocks([t.encode("utf-8", "surrogatepass") for _, t in rows], n_docs, n_terms, p)
        n = len(columns["term"])
        nothing = {"ids": pa.nulls(n, arrow.field("ids").type), "m": pa.nulls(n, arrow.field("m").type), "shard": pa.array([name] * n)}
        last = {"shard": [name], "term": [b""], "ids": [[i for i, _ in rows]], "m": [m.tolist()]}
        return pa.concat_tables([pa.table({f.name: (columns | nothing)[f.name].cast(f.type) for f in arrow}), pa.table({f.name: pa.array(last.get(f.name, [None]), type=f.type) for f in arrow})]).combine_chunks().to_batches()[0]

    def build(batches):
        held, chars, done = [], 0, 0
        for batch in batches:
            for row in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                held.append(row)
                chars += len(row[1])
                if chars >= p.shard_chars:
                    yield shard(f"{TaskContext.get().partitionId()}-{done}", held)
                    held, chars, done = [], 0, done + 1
        if held:
            yield shard(f"{TaskContext.get().partitionId()}-{done}", held)

    if not n_terms:
        return Index(spark.createDataFrame([], schema), 0, 0)
    # small partitions go together, so that shards don't get smaller than they have to
    tasks = max(-(-seen["chars"] // p.shard_chars), spark.sparkContext.defaultParallelism)
    return Index(materialize(own.coalesce(int(tasks)).mapInArrow(build, schema), "posting-blocks"), n_docs, n_terms)


class Shard:
    """The blocks of some terms in one shard; those that were decompressed stay so."""

    def __init__(self, rows: pa.Table):
        terms = rows.column("term").to_pylist()
        of_docs = terms.index(b"")
        self.ids = rows.column("ids")[of_docs].values
        self.m = rows.column("m")[of_docs].values.to_numpy()
        blocks = rows.filter(pa.array([t != b"" for t in terms])).sort_by([("term", "ascending"), ("block", "ascending")])
        self.first, self.last, self.n, self.top = (blocks.column(c).to_numpy().astype(np.int64) for c in ("first", "last", "n", "top"))
        self.payload = blocks.column("payload").to_pylist()
        self.at = np.concatenate(([0], np.cumsum(self.n)))
        self.doc, self.impact = np.zeros(self.at[-1], dtype=np.int64), np.zeros(self.at[-1], dtype=np.int64)
        self.open = np.zeros(len(self.n), dtype=bool)
        self.of: dict[bytes, tuple[int, int]] = {}
        for i, t in enumerate(blocks.column("term").to_pylist()):
            self.of[t] = (self.of.get(t, (i, i))[0], i + 1)

    def places(self, blocks: np.ndarray) -> np.ndarray:
        """Where the postings of these blocks stand."""
        n = self.n[blocks]
        return np.arange(n.sum()) + np.repeat(self.at[blocks] - np.concatenate(([0], np.cumsum(n)[:-1])), n)

    def decompress(self, blocks: np.ndarray) -> None:
        shut = blocks[~self.open[blocks]]
        if not len(shut):
            return
        values = unpacked(np.frombuffer(b"".join([self.payload[b] for b in shut.tolist()]), dtype=np.uint8))
        n = self.n[shut]
        steps, start = np.cumsum(values[0::2]), np.concatenate(([0], np.cumsum(n)[:-1]))
        doc = steps + np.repeat(self.first[shut] - steps[start], n)
        at = self.places(shut)
        self.doc[at], self.impact[at] = doc, impact(values[1::2], self.m[doc])
        self.open[shut] = True

    def search(self, query: dict[bytes, int], p: Params) -> tuple[np.ndarray, np.ndarray]:
        """Documents (by place in the shard) and scores of the k best, none of them 0. query: weights by term."""
        known = [(self.of[t], w) for t, w in query.items() if w and t in self.of]
        none = np.zeros(0, dtype=np.int64)
        if not known:
            return none, none
        blocks = np.concatenate([np.arange(a, b) for (a, b), _ in known])
        weight = np.repeat([w for _, w in known], [b - a for (a, b), _ in known])
        edges = np.unique(np.concatenate((self.first[blocks], self.last[blocks] + 1)))
        enter, leave = np.searchsorted(edges, self.first[blocks]), np.searchsorted(edges, self.last[blocks] + 1)
        change = np.zeros(len(edges), dtype=np.int64)
        np.add.at(change, enter, weight * self.top[blocks])
        np.add.at(change, leave, -weight * self.top[blocks])
        bound = np.cumsum(change)
        docs, scores, threshold, step = none, none, 1, p.step
        left = np.flatnonzero(bound >= threshold)
        first = np.argsort(-bound[left], kind="stable")[:step]
        turn, left = left[first], np.delete(left, first)
        while len(turn):
            mine = np.zeros(len(edges) + 1, dtype=np.int64)
            mine[turn + 1] = 1
            upto = np.cumsum(mine)
            need = np.flatnonzero(upto[leave] > upto[enter])
            self.decompress(blocks[need])
            at = self.places(blocks[need])
            doc, gain = self.doc[at], self.impact[at] * np.repeat(weight[need], self.n[blocks[need]])
            here = mine[np.searchsorted(edges, doc, side="right")] == 1
            found, inverse = np.unique(doc[here], return_inverse=True)
            got = np.zeros(len(found), dtype=np.int64)
            np.add.at(got, inverse, gain[here])
            docs, scores = np.concatenate((docs, found)), np.concatenate((scores, got))
            keep = np.lexsort((docs, -scores))[: p.k]
            docs, scores = docs[keep], scores[keep]
            threshold = max(1, int(scores[-1])) if len(docs) == p.k else 1
            left = left[bound[left] >= threshold]  # an equal score may still come first by its doc_id
            turn, left, step = left[:step], left[step:], 2 * step
        return docs[scores > 0], scores[scores > 0]


def finding(queries: list[dict[bytes, int]], p: Params):
    def find(rows: pa.Table) -> pa.Table:
        shard = Shard(rows)
        found = [(q, *shard.search(query, p)) for q, query in enumerate(queries)]
        at = pa.array(np.concatenate([d for _, d, _ in found]))
        q = np.repeat([q for q, _, _ in found], [len(d) for _, d, _ in found]).astype(np.int32)
        return pa.table({"q": pa.array(q), "doc_id": shard.ids.take(at), "score": pa.array(np.concatenate([s for _, _, s in found]))})

    return find


def search(index: Index, items: DataFrame, p: Params | None = None) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each row of items (item_id, text).

    Documents are rows: rows that share a doc_id rank each for itself, next to each other by ties; null ids come last among
    equal scores. Rows of items that share an item_id are a query each, with ranks of their own. Null and empty queries,
    and terms that no document has, find nothing; empty tables give an empty result.
    """
    p = p or Params()
    spark = items.sparkSession
    kinds = dict(items.dtypes)["item_id"], index.blocks.schema["ids"].dataType.elementType.simpleString()
    out = spark.createDataFrame([], f"item_id {kinds[0]}, rank int, doc_id {kinds[1]}, score long")
    own = items.where(F.col("text").isNotNull()).select("item_id", "text")
    chars = own.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = -(-chars // p.query_chars) if index.n_terms else 0
    for k in range(passes):
        rows = own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).collect()  # about query_chars characters
        names, code, owner = terms_in([r["text"].encode("utf-8", "surrogatepass") for r in rows])
        terms = names.to_pylist()
        if not terms:
            continue
        asked = F.broadcast(spark.createDataFrame([(bytearray(t),) for t in [b"", *terms]], "term binary"))
        blocks = index.blocks.join(asked, "term", "left_semi")
        df = {bytes(r["term"]): r["df"] for r in blocks.where(F.col("payload").isNotNull()).groupBy("term").agg(F.sum("n").alias("df")).collect()}
        weight = {t: math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * df[t] + 1))) for t in terms if t in df}
        queries: list[dict[bytes, int]] = [{} for _ in rows]
        for c, o in zip(code.tolist(), owner.tolist(), strict=True):
            if terms[c] in weight:
                queries[o][terms[c]] = queries[o].get(terms[c], 0) + weight[terms[c]]

        best = blocks.groupBy("shard").applyInArrow(finding(queries, p), f"q int, doc_id {kinds[1]}, score long")
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        best = best.withColumn("rank", rank).where(F.col("rank") <= p.k)
        ids = F.broadcast(spark.createDataFrame([(q, r["item_id"]) for q, r in enumerate(rows)], f"q int, item_id {kinds[0]}"))
        out = out.unionByName(best.join(ids, "q").select("item_id", "rank", "doc_id", "score"))
    return out


def oracle(p: Params | None = None, docs: str = "documents", items: str = "benchmark") -> str:
    """DuckDB SQL for item_id, rank, doc_id, score; ids are unique."""
    p = p or Params()
    terms = f"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')"
    return f"""
WITH d AS (SELECT doc_id, {terms} AS t FROM {docs} WHERE text IS NOT NULL),
g AS (SELECT count(*)::BIGINT AS nn, sum(len(t))::BIGINT AS ll FROM d WHERE len(t) > 0),
f AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, len(t)::BIGINT AS n, unnest(t) AS term FROM d) GROUP BY ALL),
q AS (SELECT item_id, term, count(*)::BIGINT AS qf FROM (SELECT item_id, unnest({terms}) AS term FROM {items}) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*)::BIGINT AS df FROM f GROUP BY term), g),
s AS (SELECT item_id, doc_id, sum(qf * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * nn) // ll)))))::BIGINT AS score FROM f JOIN q USING (term) JOIN w USING (term), g GROUP BY ALL),
r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= {p.k}"""
