"""A session with the settings that the operators expect; on a cluster, the cluster's own settings win."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
}


def session(name: str = "scriptorium", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for k, v in (DEFAULTS | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir, or where that is unset a temporary folder in local mode, else one in the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        local = master.startswith("local") and not master.startswith("local-cluster")
        found = f"file://{tempfile.mkdtemp(prefix='shared-')}" if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/shared"
    return f"{found.rstrip('/')}/{uuid.uuid4().hex}"


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by key over all cores, for operators whose cost is in the expressions: adaptive execution, which goes by bytes, would leave small tables to a task or two."""
    spark = df.sparkSession
    return df.repartition(max(df.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), *keys)


def stored(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: what several branches read is computed once, and a lost executor costs no recomputation."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
