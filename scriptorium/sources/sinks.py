"""Sinks: chunk and document stores, vector index, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.sources.merge_store import Merge, MergeStore


def replacing(key: list[str]) -> Merge:
    """The rule by which new rows take the place of all stored rows of their keys."""

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)

    return merge


def replace_chunks(chunks: DataFrame, path: str, buckets: int = 64) -> None:
    """Replace the stored chunks of the documents in `chunks`; others stay, and buckets without such documents aren't touched."""
    MergeStore(chunks.sparkSession, path, "doc_id", buckets).merge(chunks, replacing(["doc_id"]))


def upsert_documents(spark: SparkSession, new: DataFrame, path: str, key: str = "file_name", buckets: int = 64) -> None:
    """Stored documents without those of `new`, and new."""
    MergeStore(spark, path, key, buckets).merge(new, replacing([key]))


def delete_document(spark: SparkSession, paths: dict[str, str], name: str) -> None:
    """Delete a document from every table of the store. paths: path by key column."""
    for key, path in paths.items():
        MergeStore(spark, path, key).delete(spark.createDataFrame([(name,)], f"{key} string"))


def latest(history: DataFrame, run: DataFrame, key: str = "file_name", time: str = "updated_at") -> DataFrame:
    """One row a key, the newest."""
    both = history.unionByName(run, allowMissingColumns=True)
    cols = [c for c in both.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*cols), time).alias("r")).select(key, "r.*")


def write_index(vectors: DataFrame, table: str, buckets: int = 64, by: str = "source") -> None:
    """Drop and rebuild the vector index, bucketed by source so that filters on it read few files."""
    vectors.write.mode("overwrite").format("parquet").bucketBy(buckets, by).sortBy(by).saveAsTable(table)


def write_texts(docs: DataFrame, column: str, path: str) -> None:
    docs.select(column).where(F.col(column).isNotNull()).write.mode("overwrite").text(path)
