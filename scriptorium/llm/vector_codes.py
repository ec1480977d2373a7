"""Vector code compression: vectors cut into parts, each part written as the number of the nearest entry of its position's codebook.

Components become integers, so everything is exact. Equal parts of a position are one row with a weight before anything is
computed: weighted Lloyd rounds run over these distinct rows, and their codes and errors are joined back to the vectors at
the end. What the driver holds is the codebooks, `entries` numbers for each dimension.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm._common import materialize

#: Integers are cut off here, so that squares and their sums fit into 64 bits.
LARGEST = 1 << 26


@dataclass(frozen=True)
class Params:
    parts: int = 16
    entries: int = 64
    rounds: int = 2
    scale: int = 256
    task_rows: int = 200_000


@dataclass(frozen=True)
class Fitted:
    """kept: vec_id, label, row (64 bits of the vector), v (integers); distinct: pos, part, weight; books: by position, entries by components."""

    kept: DataFrame
    distinct: DataFrame
    books: list[np.ndarray]


def kept_rows(vectors: DataFrame, p: Params) -> DataFrame:
    """Rows whose vector is finite and of the commonest length that `parts` divides (the greater of equally common ones), in integers."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = vectors.select("vec_id", "label", "embedding").where(F.col("embedding").isNotNull() & sound & (F.size("embedding") > 0) & (F.size("embedding") % p.parts == 0))
    common = own.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if common is None:
        return own.select("vec_id", "label", F.lit(0).cast("long").alias("row"), F.lit(None).cast("array<long>").alias("v"))
    cut = lambda x: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(x.cast("double") * p.scale)))
    v = F.transform("embedding", lambda x: cut(x).cast("long"))
    return own.where(F.size("embedding") == common["d"]).select("vec_id", "label", v.alias("v")).select("vec_id", "label", F.xxhash64("v").alias("row"), "v")


def first_books(kept: DataFrame, p: Params) -> list[np.ndarray]:
    """The parts of the vectors with the least vec_ids (null is the greatest; of several vectors of one id the least), ascending."""
    ids = kept.select("vec_id").distinct().orderBy(F.asc_nulls_last("vec_id")).limit(p.entries).withColumnRenamed("vec_id", "id")
    rows = kept.join(F.broadcast(ids), F.col("vec_id").eqNullSafe(F.col("id"))).groupBy("vec_id").agg(F.min("v").alias("v")).orderBy(F.asc_nulls_last("vec_id")).collect()
    if not rows:
        return []
    return [np.ascontiguousarray(b) for b in np.split(np.array([r["v"] for r in rows], dtype=np.int64), p.parts, axis=1)]


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry (the first of equally near ones) and its squared distance."""
    code, error = np.zeros(len(parts), dtype=np.int32), np.full(len(parts), np.iinfo(np.int64).max)
    for k, entry in enumerate(book):
        d = ((parts - entry) ** 2).sum(axis=1)
        better = d < error
        code[better], error[better] = k, d[better]
    return code, error


def assigned(distinct: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """distinct with code and error."""

    def assign(batches):
        for batch in batches:
            pos, part = batch.column("pos").to_numpy(), batch.column("part")
            values = part.flatten().to_numpy().reshape(len(pos), -1)
            code, error = np.zeros(len(pos), dtype=np.int32), np.zeros(len(pos), dtype=np.int64)
            for k in np.unique(pos):
                mine = np.flatnonzero(pos == k)
                code[mine], error[mine] = nearest(values[mine], books[k])
            yield pa.record_batch([*batch.columns, pa.array(code), pa.array(error)], names=[*batch.schema.names, "code", "error"])

    return distinct.mapInArrow(assign, "pos int, part array<long>, weight long, code int, error long")


def moved(distinct: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one weighted round: floored means; entries that nothing chose stay."""
    width = books[0].shape[1]
    sums = [F.sum(F.col("part")[j].cast("decimal(20,0)") * F.col("weight")).alias(f"s{j}") for j in range(width)]
    out = [b.copy() for b in books]
    for r in assigned(distinct, books).groupBy("pos", "code").agg(F.sum("weight").alias("n"), *sums).collect():  # a row an entry
        out[r["pos"]][r["code"]] = [int(r[f"s{j}"]) // r["n"] for j in range(width)]
    return out


def _spread(v: Column, p: Params) -> Column:
    """pos and part of each part of a vector."""
    width = (F.size(v) / p.parts).cast("int")
    return F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(p.parts - 1)), lambda k: F.slice(v, k * width + 1, width))).alias("pos", "part")


def fit(vectors: DataFrame, p: Params | None = None) -> Fitted:
    """vectors: vec_id, embedding, label; other columns are not read."""
    p = p or Params()
    kept = materialize(kept_rows(vectors, p), "integer-vectors")
    books = first_books(kept, p)
    distinct = kept.select(_spread(F.col("v"), p)).groupBy("pos", "part").agg(F.count("*").alias("weight"))
    if books:
        distinct = materialize(distinct, "distinct-parts")
        for _ in range(p.rounds):
            books = moved(distinct, books)
    return Fitted(kept, distinct, books)


def encode(fitted: Fitted, p: Params | None = None) -> DataFrame:
    """vec_id, label, codes (array<int> by position), error for each kept row; repeated rows are repeated."""
    p = p or Params()
    if not fitted.books:
        return fitted.kept.select("vec_id", "label", F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error"))
    found = assigned(fitted.distinct, fitted.books).select("pos", "part", "code", "error")
    # equal rows are one group whose size says how many they are
    met = fitted.kept.select("vec_id", "label", "row", _spread(F.col("v"), p)).join(found.hint("merge"), ["pos", "part"])
    one = met.groupBy("vec_id", "label", "row").agg(F.array_sort(F.collect_set(F.struct("pos", "code", "error"))).alias("x"), (F.count("*") / p.parts).cast("int").alias("n"))
    codes, error = F.transform("x", lambda c: c["code"]), F.aggregate("x", F.lit(0).cast("long"), lambda s, c: s + c["error"])
    return one.select("vec_id", "label", codes.alias("codes"), error.alias("error"), F.explode(F.sequence(F.lit(1), F.col("n")))).drop("col")


def decode(codes: list[int], books: list[np.ndarray], p: Params | None = None) -> np.ndarray:
    """The vector that a code stands for: the middle of each integer's range."""
    p = p or Params()
    return (np.concatenate([books[k][c] for k, c in enumerate(codes)]) + 0.5) / p.scale


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, p: Params | None = None) -> DataFrame:
    """vec_id, label, code (two hex digits a part), error, label_error (summed over equal labels, nulls together), codebooks_sha256.

    Vectors that are null, empty or hold null or non-finite components take no part, nor those whose length differs from
    the commonest one that the number of parts divides. Integers beyond 2**26 in size count as that. Repeated rows each get
    their row; an id with several vectors has a row for each, and its least vector stands in the first codebook. A null
    vec_id counts as an id after all others. An empty table gives an empty result; with fewer ids than entries the
    codebooks are as many entries long.
    """
    p = p or Params()
    fitted = fit(vectors, p)
    rows = materialize(encode(fitted, p), "vector-codes")
    by_label = rows.groupBy(F.col("label").alias("__label")).agg(F.sum("error").cast("long").alias("label_error"))
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c.cast("long"))), 2, "0")), "")
    out = rows.join(by_label, F.col("label").eqNullSafe(F.col("__label")))
    return out.select("vec_id", "label", code.alias("code"), "error", "label_error", F.lit(digest(fitted.books)).alias("codebooks_sha256"))


def oracle(p: Params | None = None, vectors: str = "embeddings") -> str:
    """DuckDB SQL for vec_id, code, error, label_error, codebooks_sha256; vec_ids are unique and of one length."""
    p = p or Params()
    steps, floor = [], "((s - ((s % n) + n) % n) // n)::BIGINT"
    for k in range(p.rounds + 1):
        steps.append(f"a{k} AS (SELECT vec_id, pos, min(d * {p.entries} + entry) AS m FROM (SELECT vec_id, pos, entry, sum((x.v - e{k}.v) * (x.v - e{k}.v))::BIGINT AS d FROM x JOIN e{k} USING (pos, j) GROUP BY ALL) GROUP BY ALL)")
        if k < p.rounds:
            steps.append(f"s{k} AS (SELECT pos, m % {p.entries} AS entry, j, sum(v) AS s, count(*) AS n FROM a{k} JOIN x USING (vec_id, pos) GROUP BY ALL)")
            steps.append(f"e{k + 1} AS (SELECT pos, entry, j, CASE WHEN s.n IS NULL THEN e{k}.v ELSE {floor} END AS v FROM e{k} LEFT JOIN s{k} s USING (pos, entry, j))")
    last, n = p.rounds, p.entries
    return f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda c: floor({p.scale} * c::DOUBLE)::BIGINT) AS v FROM {vectors}
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
x AS (SELECT vec_id, (i - 1) // (d // {p.parts}) AS pos, (i - 1) % (d // {p.parts}) AS j, v FROM (SELECT vec_id, len(v) AS d, unnest(v) AS v, generate_subscripts(v, 1) AS i FROM k)),
e0 AS (SELECT pos, entry, j, v FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k ORDER BY vec_id LIMIT {n}) USING (vec_id)),
{", ".join(steps)},
c AS (SELECT vec_id, string_agg(lpad(format('{{:x}}', m % {n}), 2, '0'), '' ORDER BY pos) AS code, sum(m // {n})::BIGINT AS error FROM a{last} GROUP BY vec_id),
h AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY pos, entry, j)) AS h FROM e{last})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256 FROM c JOIN k USING (vec_id), h"""
