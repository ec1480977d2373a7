"""A table that batches are merged into: rows lie in buckets by a hash of their key, and a batch rewrites only the buckets it touches.

    PATH/data/RUN/bucket=N/...   Parquet files of one bucket, written once by one run and never changed
    PATH/versions/000...N.json   a version: which folder each bucket has, and the last batch of each stream

A version is made by renaming a finished file to a name that must not exist, so readers see the old version or the new
one, whole, and of two writers one fails and tries again on the other's version. A batch whose id the version already names
for its stream is not merged a second time. Folders that no kept version names are deleted by vacuum.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Merge = Callable[[DataFrame, DataFrame], DataFrame]


class VersionExists(Exception):
    """Another writer was first."""


@dataclass(frozen=True)
class Version:
    """number; key and buckets of the store; schema as JSON; folders by bucket; ledger: the last batch id by stream."""

    number: int
    key: list[str]
    buckets: int
    schema: str
    folders: dict[str, str] = field(default_factory=dict)
    ledger: dict[str, int] = field(default_factory=dict)


class MergeStore:
    """key: columns that rows are told apart by; buckets: fixed when the store is made, so that one holds what a few tasks can rewrite."""

    def __init__(self, spark: SparkSession, path: str, key: list[str] | str = "doc_id", buckets: int = 64, keep: int = 2):
        self.spark, self.path, self.buckets, self.keep = spark, path.rstrip("/"), buckets, keep
        self.key = [key] if isinstance(key, str) else list(key)
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        root = self._path(self.path)
        conf = spark._jsc.hadoopConfiguration()
        self._fs = root.getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.makeQualified(root).toUri(), conf)

    def version(self) -> Version | None:
        """The newest version, None before the first batch."""
        numbers = self._numbers()
        return self._read(numbers[-1]) if numbers else None

    def _numbers(self) -> list[int]:
        folder = self._path(f"{self.path}/versions")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _read(self, number: int) -> Version:
        stream = self._fs.open(self._path(f"{self.path}/versions/{number:020d}.json"))
        try:
            return Version(**json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def _commit(self, v: Version) -> None:
        draft = self._path(f"{self.path}/versions/.{v.number}.{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(asdict(v)).encode()))
        finally:
            out.close()
        options = self.spark._sc._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._context.rename(draft, self._path(f"{self.path}/versions/{v.number:020d}.json"), options)
        except Exception as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise VersionExists(v.number) from e
            raise

    def _rows(self, v: Version, buckets: list[str] | None = None) -> DataFrame:
        folders = [f for b, f in sorted(v.folders.items()) if buckets is None or b in buckets]
        schema = StructType.fromJson(json.loads(v.schema))
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def read(self, number: int | None = None) -> DataFrame:
        """All rows of the newest version, or of an older one that is kept."""
        v = self.version() if number is None else self._read(number)
        if v is None:
            raise FileNotFoundError(self.path)
        return self._rows(v)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys; only their buckets are read."""
        v = self.version()
        if v is None:
            raise FileNotFoundError(self.path)
        touched = [str(r[0]) for r in keys.select(self._bucket(v)).distinct().collect()]  # at most as many as there are buckets
        return self._rows(v, touched).join(keys.select(*v.key).distinct(), v.key, "left_semi")

    @staticmethod
    def _bucket(v: Version):
        return F.pmod(F.xxhash64(*v.key), F.lit(v.buckets)).alias("bucket")

    def merge(self, batch: DataFrame, merge: Merge, batch_id: int | None = None, stream: str = "", tries: int = 5) -> bool:
        """The store's rows of the touched buckets become merge(stored, batch), which keeps the rows of other keys; False if the batch was merged before.

        A run that fails leaves files that nothing names, and the old version. Columns that only the batch has are added,
        null in older rows; columns that only the store has become null in new rows.
        """
        if batch_id is not None and (now := self.version()) is not None and batch_id <= now.ledger.get(stream, -1):
            return False
        batch = batch.persist()  # read for its buckets and then merged
        try:
            return self._merge(batch, merge, batch_id, stream, tries)
        finally:
            batch.unpersist()

    def _merge(self, batch: DataFrame, merge: Merge, batch_id: int | None, stream: str, tries: int) -> bool:
        for turn in range(tries):
            now = self.version()
            if now is not None and batch_id is not None and batch_id <= now.ledger.get(stream, -1):
                return False
            v = now or Version(0, self.key, self.buckets, batch.schema.json())
            new = batch.withColumn("bucket", self._bucket(v))
            touched = sorted(str(r[0]) for r in new.select("bucket").distinct().collect())
            old = self._rows(v, touched)
            missing = [f for f in batch.schema.fields if f.name not in old.columns]
            old = old.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing])
            lacking = [f for f in old.schema.fields if f.name not in batch.columns]
            own = batch.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in lacking]).select(*old.columns)
            merged = merge(old, own).select(*old.columns)
            run = f"data/{uuid.uuid4().hex}"
            if touched:
                # rows of a bucket meet in one task, or in several if they are many
                merged.withColumn("bucket", self._bucket(v)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{run}")
            there = {b for b in touched if self._fs.exists(self._path(f"{self.path}/{run}/bucket={b}"))}
            folders = {b: f for b, f in v.folders.items() if b not in touched} | {b: f"{run}/bucket={b}" for b in there}
            ledger = v.ledger | ({stream: batch_id} if batch_id is not None else {})
            try:
                self._commit(Version(v.number + 1, v.key, v.buckets, old.schema.json(), folders, ledger))
                self.vacuum()
                return True
            except VersionExists:
                time.sleep(0.1 * 2**turn)
        raise VersionExists(f"{self.path}: {tries} tries")

    def delete(self, keys: DataFrame) -> None:
        """Rows of these keys go."""
        self.merge(keys.select(*self.key).distinct(), lambda old, gone: old.join(gone.select(*self.key), self.key, "left_anti"))

    def vacuum(self) -> None:
        """Delete versions but the last `keep`, and what only they name."""
        numbers = self._numbers()
        gone, left = numbers[: -self.keep], numbers[-self.keep :]
        if not gone:
            return
        named = {f for n in left for f in self._read(n).folders.values()}
        for n in gone:
            for f in set(self._read(n).folders.values()) - named:
                self._fs.delete(self._path(f"{self.path}/{f}"), True)
            self._fs.delete(self._path(f"{self.path}/versions/{n:020d}.json"), False)


def newest(key: list[str], version: str) -> Merge:
    """The rule by which the row of the greatest version counts, of stored and new ones alike."""

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        both = old.unionByName(new)
        rest = [c for c in both.columns if c not in key]
        return both.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(version, *[c for c in rest if c != version])).alias("r")).select(*key, "r.*")

    return merge
