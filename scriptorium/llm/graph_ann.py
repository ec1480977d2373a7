"""Approximate nearest neighbours: a robust-pruned directed graph in each shard, searched by beams.

Vectors are dealt to cells by their nearest centroid (fitted on a bounded sample), and a cell is split by hash into shards
of about `shard_rows`. In a shard each vector, in batches, is searched for greedily in the graph so far; the vectors that
the search visited are its candidates, and relaxed pruning keeps those edges that no shorter kept edge makes needless:
candidate c goes if alpha * d(kept, c) <= d(vector, c). Reverse edges are added and pruned alike. Graphs are built once
and written as a table. Inner products become distances by one more component, sqrt(M^2 - |x|^2), M the largest norm of all.

Beam search takes a query through the graph of each shard from its entry points; `probes` sends it to the shards of so many
nearest cells only, which pays where vectors form clusters (on vectors without any, 4 of 13 cells left a recall of 0.59). A
task holds one shard and at most about `query_rows` queries. The nearest of all shards are kept. Scores are inner
products of the original vectors in double precision.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm._common import materialize


@dataclass(frozen=True)
class Params:
    """degree, beam, alpha, passes: of the graph; search_beam: of the queries, k at least; entries: where searches begin; shard_rows: vectors of a shard, about; query_rows: queries that one task takes along; probes: cells that a query is searched in, None: all; max_cells and sample_rows bound the centroids and the sample that they are fitted on."""

    k: int = 20
    degree: int = 32
    beam: int = 48
    alpha: float = 1.2
    passes: int = 1
    search_beam: int = 112
    entries: int = 32
    shard_rows: int = 8192
    query_rows: int = 1024
    probes: int | None = None
    max_cells: int = 4096
    sample_rows: int = 65_536
    batch: int = 256
    seed: int = 3


def gathered(vectors: np.ndarray, queries: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Squared distances of each query (b x d) to its ids (b x m)."""
    diff = vectors[ids] - queries[:, None, :]
    return np.einsum("bmd,bmd->bm", diff, diff)


def beam_search(vectors: np.ndarray, graph: np.ndarray, entries: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the beam: ids (-1: none) and squared distances, nearest first. graph: n x degree, -1 where there is no edge."""
    b, rows = len(queries), np.arange(len(queries))
    ids = np.full((b, beam), -1, dtype=np.int64)
    dist = np.full((b, beam), np.inf, dtype=np.float32)
    done = np.zeros((b, beam), dtype=bool)
    seen = np.zeros((b, len(vectors)), dtype=bool)
    entries = entries[:beam]
    ids[:, : len(entries)], seen[:, entries] = entries, True
    dist[:, : len(entries)] = gathered(vectors, queries, np.broadcast_to(entries, (b, len(entries))))
    active = rows
    while len(active):
        open_at = np.where(done[active] | (ids[active] < 0), np.inf, dist[active])
        # a few open places at once, to save passes
        at = np.argpartition(open_at, min(3, beam - 1), axis=1)[:, :4] if beam > 4 else np.argsort(open_at, axis=1)
        usable = np.isfinite(np.take_along_axis(open_at, at, axis=1))
        more = usable.any(axis=1)
        active, at, usable = active[more], at[more], usable[more]
        if not len(active):
            break
        chosen = ids[active[:, None], at]
        done[active[:, None], at] |= usable
        next_ids = np.where(usable[:, :, None], graph[np.maximum(chosen, 0)], -1).reshape(len(active), -1)
        new = (next_ids >= 0) & ~seen[active[:, None], np.maximum(next_ids, 0)]
        # the same id from two places: the first counts
        order = np.argsort(next_ids, axis=1, kind="stable")
        sorted_ids = np.take_along_axis(next_ids, order, axis=1)
        twice = np.zeros_like(new)
        np.put_along_axis(twice, order[:, 1:], sorted_ids[:, 1:] == sorted_ids[:, :-1], axis=1)
        new &= ~twice
        r, c = np.nonzero(new)
        seen[active[r], next_ids[r, c]] = True
        d = np.full(next_ids.shape, np.inf, dtype=np.float32)
        diff = vectors[next_ids[r, c]] - queries[active[r]]
        d[r, c] = np.einsum("nd,nd->n", diff, diff)
        all_ids = np.concatenate((ids[active], np.where(new, next_ids, -1)), axis=1)
        all_dist = np.concatenate((dist[active], d), axis=1)
        all_done = np.concatenate((done[active], np.zeros_like(new)), axis=1)
        keep = np.argpartition(all_dist, beam - 1, axis=1)[:, :beam]
        ids[active] = np.take_along_axis(all_ids, keep, axis=1)
        dist[active] = np.take_along_axis(all_dist, keep, axis=1)
        done[active] = np.take_along_axis(all_done, keep, axis=1)
    order = np.argsort(dist, axis=1, kind="stable")
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(dist, order, axis=1)


def pruned(vectors: np.ndarray, owners: np.ndarray, cands: np.ndarray, p: Params) -> np.ndarray:
    """Edges (b x degree, -1: none) of the owners out of their candidates (b x m, -1: none)."""
    b, m = cands.shape
    order = np.argsort(cands, axis=1, kind="stable")
    cands = np.take_along_axis(cands, order, axis=1)
    cands[:, 1:][cands[:, 1:] == cands[:, :-1]] = -1
    cands[cands == owners[:, None]] = -1
    dist = np.where(cands >= 0, gathered(vectors, vectors[owners], np.maximum(cands, 0)), np.inf)
    order = np.argsort(dist, axis=1, kind="stable")
    cands, dist = np.take_along_axis(cands, order, axis=1), np.take_along_axis(dist, order, axis=1)
    alive = cands >= 0
    out, filled = np.full((b, p.degree), -1, dtype=np.int64), np.zeros(b, dtype=np.int64)
    points = vectors[np.maximum(cands, 0)]
    squares = np.einsum("bmd,bmd->bm", points, points)
    for j in range(m):
        take = np.flatnonzero(alive[:, j] & (filled < p.degree))
        if not len(take):
            continue
        out[take, filled[take]] = cands[take, j]
        filled[take] += 1
        here = points[take, j]
        apart = squares[take] + squares[take, j][:, None] - 2 * np.einsum("bmd,bd->bm", points[take], here)
        alive[take] &= ~(p.alpha**2 * apart <= dist[take])
    return out


def built(vectors: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """The graph over vectors (float32), and its entry points: the vector nearest to the mean, and some that lie far from each other."""
    n = len(vectors)
    random = np.random.default_rng(p.seed)
    graph = np.full((n, p.degree), -1, dtype=np.int64)
    for k in range(min(4, n - 1)):  # a random start, so that all can be reached
        graph[:, k] = (np.arange(n) + random.integers(1, n, n)) % n
    diff = vectors - vectors.mean(axis=0)
    entries = [int(np.einsum("nd,nd->n", diff, diff).argmin())]
    far = np.full(n, np.inf)
    while len(entries) < min(p.entries, n):
        diff = vectors - vectors[entries[-1]]
        far = np.minimum(far, np.einsum("nd,nd->n", diff, diff))
        entries.append(int(far.argmax()))
    entry = np.unique(entries)
    for _ in range(p.passes):
        order = random.permutation(n)
        for k in range(0, n, p.batch):
            batch = order[k : k + p.batch]
            found, _ = beam_search(vectors, graph, entry, vectors[batch], p.beam)
            graph[batch] = pruned(vectors, batch, np.concatenate((found, graph[batch]), axis=1), p)
            src, at = np.nonzero(graph[batch] >= 0)
            to, src = graph[batch][src, at], batch[src]
            by = np.argsort(to, kind="stable")
            to, src = to[by], src[by]
            targets, first, count = np.unique(to, return_index=True, return_counts=True)
            back = np.full((len(targets), int(count.max()) if len(count) else 0), -1, dtype=np.int64)
            place = np.arange(len(to)) - np.repeat(first, count)
            back[np.repeat(np.arange(len(targets)), count), place] = src
            for s in range(0, len(targets), 512):
                t = targets[s : s + 512]
                graph[t] = pruned(vectors, t, np.concatenate((graph[t], back[s : s + 512]), axis=1), p)
    return graph, entry


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0)


def centroids(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """k-means over the sample from evenly spaced rows of it; an empty cell keeps its place."""
    centre = sample[np.linspace(0, len(sample) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        own = np.concatenate([to_cells(sample[k : k + 4096], centre, 1)[:, 0] for k in range(0, len(sample), 4096)])
        total, n = np.zeros_like(centre), np.bincount(own, minlength=cells)
        np.add.at(total, own, sample)
        centre[n > 0] = total[n > 0] / n[n > 0, None]
    return centre


def to_cells(x: np.ndarray, centre: np.ndarray, most: int) -> np.ndarray:
    """The nearest cells of each row, nearest first."""
    far = (centre * centre).sum(axis=1) - 2 * (x @ centre.T)
    return np.argsort(far, axis=1, kind="stable")[:, :most]


def matrix(col: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(col), width))
    for i, x in enumerate(col):
        out[i, : len(x)] = x
    return out


def lifted(x: np.ndarray, norm: float) -> np.ndarray:
    """Vectors with the component that makes the largest inner product the least distance."""
    return np.concatenate((x, np.sqrt(np.maximum(0, norm - np.einsum("nd,nd->n", x, x)))[:, None]), axis=1).astype(np.float32)


def nearest(vectors: DataFrame, queries: Column, vec_id: str = "vec_id", embedding: str = "embedding", p: Params | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row for which `queries` holds, its own row left out.

    Nearness is the largest inner product; equal ones are ordered by the smaller vec_id. Vectors that are null, zero or hold
    null or non-finite components take no part on either side; of unequal lengths the shorter is filled with zeros. Rows
    with a null vec_id take no part. Equal vectors share one node of the graph, which keeps the k + 1 least ids, as no
    query can need more; rows of one vec_id and one vector count once. An empty table gives an empty result. With `probes`,
    a query whose cells hold fewer than k candidates gets those.
    """
    p = p or Params()
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.transform(embedding, lambda x: x.cast("double")).alias("v"), queries.alias("q"))
    rows = rows.where(usable(F.col("v")) & F.col("id").isNotNull())
    ranked = F.row_number().over(Window.partitionBy("v").orderBy("id"))  # trimmed before the shuffle
    least = rows.select("id", "v").distinct().withColumn("r", ranked).where(F.col("r") <= p.k + 1)
    nodes = materialize(least.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")), "ann-nodes")
    facts = nodes.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("norm"), F.max(F.size("v")).alias("d")).first()
    norm, width, k = float(facts["norm"] or 0), int(facts["d"] or 1), p.k
    cells = min(p.max_cells, max(1, round(facts["n"] / p.shard_rows)))
    sample = nodes.orderBy(F.xxhash64("v"), "v").limit(max(cells, min(p.sample_rows, 64 * cells))).select("v").toPandas()
    centre = centroids(lifted(matrix(sample["v"], width), norm), cells) if len(sample) else np.zeros((1, width + 1), np.float32)

    def celled(most: int, query: bool, keep: list[str]):
        def run(frames):
            for f in frames:
                x = matrix(f["v"], width)
                x = np.concatenate((x, np.zeros((len(x), 1))), axis=1).astype(np.float32) if query else lifted(x, norm)
                own = to_cells(x, centre, most)
                yield f[keep].assign(cell=[c.astype(np.int32) for c in own])

        return run

    held = nodes.mapInPandas(celled(1, False, ["ids", "v"]), "ids array<long>, v array<double>, cell array<int>").withColumn("cell", F.col("cell")[0])
    sizes = F.broadcast(nodes.mapInPandas(celled(1, False, []), "cell array<int>").groupBy(F.col("cell")[0].alias("cell")).agg(F.ceil(F.count("*") / (2 * p.shard_rows)).cast("int").alias("subs")))  # max_cells rows
    held = held.join(sizes, "cell").withColumn("shard", F.pmod(F.xxhash64("v"), F.col("subs")).cast("int"))

    def build(f: pd.DataFrame) -> pd.DataFrame:
        f = f.assign(o=f["ids"].map(lambda x: x[0])).sort_values("o")
        flat = lifted(matrix(f["v"], width), norm)
        graph, entry = built(flat, p) if len(flat) > 1 else (np.full((1, p.degree), -1, dtype=np.int64), np.zeros(1, dtype=np.int64))
        first = np.zeros(len(f), dtype=bool)
        first[entry] = True
        return pd.DataFrame({"cell": f["cell"], "shard": f["shard"], "place": np.arange(len(f)), "ids": f["ids"], "v": f["v"], "edges": list(graph.astype(np.int32)), "entry": first})

    made = "cell int, shard int, place int, ids array<long>, v array<double>, edges array<int>, entry boolean"
    graphs = materialize(held.select("cell", "shard", "ids", "v").groupBy("cell", "shard").applyInPandas(build, made), "ann-graphs")
    asked = rows.where("q").select("id", "v").distinct()
    probes = cells if p.probes is None else min(cells, p.probes)
    asked = asked.mapInPandas(celled(probes, True, ["id", "v"]), "id long, v array<double>, cell array<int>")
    asked = materialize(asked.select("id", "v", F.explode("cell").alias("cell")).join(sizes, "cell"), "ann-queries")
    parts = asked.groupBy("cell").agg(F.ceil(F.count("*") / p.query_rows).cast("int").alias("parts"))  # max_cells rows
    ask = asked.join(F.broadcast(parts), "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "id", "v", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("shard"))
    data = graphs.join(F.broadcast(parts), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        left, right = left.sort_values("place"), right.sort_values("id")
        x, owners = matrix(left["v"], width), left["ids"].tolist()
        flat, graph, entry = lifted(x, norm), np.stack(left["edges"].tolist()).astype(np.int64), np.flatnonzero(left["entry"])
        qid, q = right["id"].to_numpy(), matrix(right["v"], width)
        out = []
        for s in range(0, len(q), p.batch):
            part = np.concatenate((q[s : s + p.batch], np.zeros((len(q[s : s + p.batch]), 1))), axis=1).astype(np.float32)
            found, _ = beam_search(flat, graph, entry, part, max(p.search_beam, k + 1))
            for i, ids in enumerate(found):
                ids = ids[ids >= 0]
                score = (x[ids] * q[s + i]).sum(axis=1)
                rows = []
                for j in np.argsort(-score, kind="stable").tolist():  # whole nodes, until k rows are there and no tie is open
                    if len(rows) >= k + 1 and score[j] < rows[-1][2]:
                        break
                    rows += [(qid[s + i], v, score[j]) for v in owners[ids[j]] if v != qid[s + i]]
                rows.sort(key=lambda r: (-r[2], r[1]))
                out += rows[:k]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = data.groupBy("cell", "shard", "part").cogroup(ask.groupBy("cell", "shard", "part")).applyInPandas(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
