"""A stored vector index of inverted lists: vectors lie in lists by their nearest centre, and a search reads the lists that can matter.

The table is partitioned by list; within a list, rows lie by source, so that a filter on sources reads few row groups. Vectors are
stored at unit length, for which the order by cosine is the order by distance. Each list knows its radius: by the triangle
inequality no vector of a list is nearer to a query than the query's distance to the centre less the radius. A search takes
the `probes` nearest lists of each query first; the k-th of what they hold bounds the rest, and only lists that can hold
something nearer are read after that. So results are exact; `exact=False` stops after the probes.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.operators.nearest import nearest
from scriptorium.session import stored


@dataclass(frozen=True)
class VectorIndex:
    """path: of the table, whose columns are schema; centres: lists by dimensions; radius: of each list. Centres are a bounded number, `lists` of build()."""

    path: str
    schema: str
    centres: np.ndarray
    radius: np.ndarray

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(f"{self.path}/lists")


def unit(vector: Column) -> Column:
    """The vector at length 1 in doubles; null for null, empty, zero and non-finite ones."""
    v = F.transform(vector, lambda x: x.cast("double"))
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when((n > 0) & (n < float("inf")), F.transform(v, lambda x: x / n))


def centres_of(units: DataFrame, lists: int, sample: int, rounds: int, seed: int) -> np.ndarray:
    """k-means over a sample of at most `sample` distinct vectors, those with the least hash. Empty lists keep their centre."""
    rows = units.select("unit").distinct().orderBy(F.xxhash64(F.lit(seed), "unit")).limit(sample).toArrow()
    x = np.array([v.as_py() for v in rows.column("unit")], dtype=np.float64)
    if not len(x):
        return np.zeros((0, 0))
    centres = x[:lists].copy()
    for _ in range(rounds):
        nearest = np.argmax(x @ centres.T - 0.5 * (centres**2).sum(axis=1), axis=1)
        n = np.bincount(nearest, minlength=len(centres))
        for d in range(x.shape[1]):
            total = np.bincount(nearest, weights=x[:, d], minlength=len(centres))
            centres[n > 0, d] = total[n > 0] / n[n > 0]
    return centres


def build(vectors: DataFrame, path: str, lists: int = 64, sample: int = 20_000, rounds: int = 8, seed: int = 3, part_rows: int = 100_000) -> VectorIndex:
    """Write the index of vectors (id, source, embedding) at path. Vectors without a direction (null, zero, non-finite) take no part.

    The centres are fitted to a sample; every row is indexed. A list of more than `part_rows` rows is written by several tasks.
    """
    units = vectors.select("id", "source", unit(F.col("embedding")).alias("unit")).where("unit IS NOT NULL")
    centres = centres_of(units, lists, sample, rounds, seed)
    kind = {c: units.schema[c].dataType.simpleString() for c in ("id", "source")}
    schema = f"id {kind['id']}, source {kind['source']}, unit array<double>, distance double, list int"

    def assign(batches):
        for batch in batches:
            x = batch.column("unit").flatten().to_numpy().reshape(batch.num_rows, -1)
            d = np.maximum(0.0, (x**2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres**2).sum(axis=1))
            near = np.argmin(d, axis=1)
            yield pa.record_batch([*batch.columns, pa.array(np.sqrt(d[np.arange(len(near)), near])), pa.array(near.astype(np.int32))], names=[*batch.schema.names, "distance", "list"])

    placed = stored(units.mapInArrow(assign, schema))
    many = placed.groupBy("list").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("parts"))
    dealt = placed.join(F.broadcast(many), "list").withColumn("part", F.pmod(F.xxhash64("source", "id"), F.col("parts")))
    dealt.repartition("list", "part").sortWithinPartitions("list", "source").select("id", "source", "unit", "distance", "list").write.mode("overwrite").partitionBy("list").parquet(f"{path}/lists")
    radius = np.zeros(len(centres))
    for r in placed.groupBy("list").agg(F.max("distance").alias("r")).collect():  # a row a list
        radius[r["list"]] = r["r"]
    index = VectorIndex(path, schema, centres, radius)
    spark = vectors.sparkSession
    head = json.dumps({"schema": schema, "centres": centres.tolist(), "radius": radius.tolist()})
    spark.createDataFrame([(head,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/head")
    return index


def load(spark: SparkSession, path: str) -> VectorIndex:
    head = json.loads(spark.read.text(f"{path}/head", wholetext=True).first()["value"])
    return VectorIndex(path, head["schema"], np.array(head["centres"]), np.array(head["radius"]))


def _lists_of(asked: DataFrame, index: VectorIndex) -> DataFrame:
    """query_id, list, low, place: for each query and list the least distance that one of its vectors can have, and the place of its centre by distance."""
    centres, radius = index.centres, index.radius

    def near(batches):
        for batch in batches:
            q = batch.column("q").flatten().to_numpy().reshape(batch.num_rows, -1)
            d = np.sqrt(np.maximum(0.0, (q**2).sum(axis=1)[:, None] - 2 * q @ centres.T + (centres**2).sum(axis=1)))
            order = np.argsort(np.argsort(d, axis=1, kind="stable"), axis=1)
            low = np.maximum(0.0, d - radius - 1e-9)
            lists = np.tile(np.arange(len(centres), dtype=np.int32), len(q))
            rows = pa.array(np.repeat(np.arange(len(q)), len(centres)))
            yield pa.record_batch([batch.column("query_id").take(rows), pa.array(lists), pa.array(low.ravel()), pa.array(order.ravel().astype(np.int32))], names=["query_id", "list", "low", "place"])

    kind = asked.schema["query_id"].dataType.simpleString()
    return asked.mapInArrow(near, f"query_id {kind}, list int, low double, place int")


def search(spark: SparkSession, index: VectorIndex, queries: DataFrame, k: int = 6, probes: int = 4, payload: Column | None = None, exact: bool = True) -> DataFrame:
    """query_id, rank, id, score: the k nearest of each query by cosine, ties to the smaller id. queries: query_id (unique), query.

    payload: a condition on id and source, checked as lists are read. Queries meet lists by equality of the list's number, in blocks
    of rows and queries that are multiplied as matrices. Queries without a direction find nothing.
    """
    asked = stored(queries.select("query_id", unit(F.col("query")).alias("q")).where("q IS NOT NULL"))
    if not len(index.centres):
        kinds = queries.schema["query_id"].dataType.simpleString(), index.schema.split(",")[0]
        return spark.createDataFrame([], f"query_id {kinds[0]}, rank int, {kinds[1]}, score double")
    reach = stored(_lists_of(asked, index))
    rows = index.rows(spark)
    rows = rows if payload is None else rows.where(payload)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))

    def met(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select("list").distinct()
        near = rows.join(F.broadcast(wanted), "list", "left_semi")  # as few lists as there are centres; prunes partitions
        near = near.select("list", "id", F.col("unit").alias("v"), F.lit(1.0).alias("n"))
        found = nearest(near, pairs.join(asked.withColumn("qn", F.lit(1.0)), "query_id"), "list", k)
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    first = stored(met(reach.where(F.col("place") < probes).select("query_id", "list")))
    if not exact:
        return first.select("query_id", "rank", "id", "score")
    # the distance of the k-th so far, if there are k: sqrt(2 - 2 cos)
    bound = first.where(F.col("rank") == k).select("query_id", F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("score"))).alias("bound"))
    more = reach.where(F.col("place") >= probes).join(bound, "query_id", "left").where(F.col("bound").isNull() | (F.col("low") <= F.col("bound") + 1e-9))
    best = first.drop("rank").unionByName(met(more.select("query_id", "list")).drop("rank"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
