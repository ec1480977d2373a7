"""What the operators of this subpackage share: scratch tables, text in numpy arrays, folds."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows and bytes of text that one Arrow batch carries to a Python worker, and characters that one numpy pass handles.
BATCH_ROWS, BATCH_BYTES, PASS_CHARS = 2000, 8 << 20, 1 << 20


_own: dict[str, str] = {}
_written: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it. Where none is named: a temporary one in local mode, else one in the warehouse, which is shared."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        local = spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")
        _own[app] = f"file://{tempfile.mkdtemp(prefix='scratch-')}" if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch-{app}"
    return _own[app]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: the lineage ends here, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> int:
    """Number of scratch tables so far; a mark for clear_scratch."""
    return len(_written)


def clear_scratch(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete the scratch tables that this driver wrote after the mark, but the last `keep`; nothing lazy may still read them."""
    gone, _written[since:] = _written[since : len(_written) - keep], _written[len(_written) - keep :]
    for name in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_key(text: Column) -> Column:
    """Tells rows that share a doc_id apart by their text; null is as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once; long texts would else make batches of gigabytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo folds; null keys count as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_fields(df: DataFrame, ddl: str) -> StructType:
    """The schema of df and further fields."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


def passes(lengths: np.ndarray, limit: int = PASS_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts whose lengths add up to the limit at most, or of one text."""
    start, held = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield start, len(lengths)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each text between two zeros, and where each text begins."""
    joined = "\0" + "\0".join(texts) + "\0"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    return codes, np.concatenate(([0], np.cumsum(lengths + 1)))[:-1] + 1


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser over 64-bit hashes, so that low bits depend on all."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gram_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """A 32-bit hash of the n codes from each position on."""
    m = len(codes) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint32)
    h = np.full(m, n, dtype=np.uint32)
    for k in range(n):
        h *= np.uint32(0x01000193)
        h ^= codes[k : k + m]
        h *= np.uint32(0x9E3779B1)
    return h ^ (h >> np.uint32(15))


POWER = 0x9E3779B97F4A7C15
POWER_INVERSE = pow(POWER, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    held = _powers.get(base)
    if held is None or len(held) < n:
        size = max(n, 1 << 16)
        held = np.full(size, base, dtype=np.uint64)
        held[0] = 1
        held = _powers[base] = np.multiply.accumulate(held)
    return held[:n]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words in bytes; white space is \\x20 and \\x09-\\x0D, a zero byte parts words as well."""
    space = (data == 32) | ((data >= 9) & (data <= 13)) | (data == 0)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(POWER, len(data)))))
    h = (total[ends] - total[starts]) * powers(POWER_INVERSE, len(data) + 1)[starts]
    return starts, ends, mixed(h + (ends - starts).astype(np.uint64))


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, nothing else."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def byte_texts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the texts, A-Z lower-cased, with a zero byte after each, and the offset at which each begins; zeros within a text become \\x01."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    raw = [r.replace(b"\0", b"\1") if b"\0" in r else r for r in raw]
    offsets = np.concatenate(([0], np.cumsum(np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)) + 1)))
    return lowered(np.frombuffer(b"\0".join(raw) + b"\0", dtype=np.uint8)) if raw else np.zeros(0, np.uint8), offsets


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held_out: int, folds: int, most: int, chars: int) -> DataFrame:
    """At most `most` labelled documents outside the held-out fold, those with the least hash of doc_id, whose texts have `chars` characters or fewer in all.

    Documents are taken in that order; one whose text no longer fits is passed over, and the next ones are still tried, so no
    single text can end the sample. Of several texts of one doc_id the one with the least hash counts, so there are as many
    rows as ids at most. A label above 0 counts as 1, any other as 0; of several labels for one document the largest
    counts; null labels and ids are dropped. Columns: k (a hash that orders the rows), text, y.
    """
    spark = docs.sparkSession
    ids = (
        labels.select(F.col("doc_id").alias("id"), (F.col(label) > 0).cast("int").alias("y"))
        .where(F.col("id").isNotNull() & F.col("y").isNotNull() & (fold(F.col("id"), folds) != held_out))
        .groupBy("id")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(most)
    )
    own = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    sample = own.join(F.broadcast(ids), "id").groupBy("id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.max("y").alias("y"))
    sample = materialize(sample, "labelled-sample")
    taken, left = [], chars
    for r in sample.select("id", F.length("text").alias("n")).orderBy(F.xxhash64("id"), "id").collect():  # `most` rows at most
        if r["n"] <= left:
            taken.append((r["id"],))
            left -= r["n"]
    within = spark.createDataFrame(taken, sample.select("id").schema)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # else the few rows would be one task's
    return sample.join(F.broadcast(within), "id").select(F.xxhash64("id", "text").alias("k"), "text", "y").repartition(tasks, "k")
