import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.driver.memory", "3g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('scratch')}")
        .config("spark.sql.warehouse.dir", f"{tmp_path_factory.mktemp('warehouse')}")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def value(spark):
    """The value of a column expression over one row of string columns."""
    from pyspark.sql import functions as F

    def run(make, *args):
        df = spark.createDataFrame([tuple(args) or ("",)], [f"c{i}" for i in range(max(1, len(args)))]) if all(a is not None for a in args) else spark.range(1).select(*[F.lit(a).cast("string").alias(f"c{i}") for i, a in enumerate(args)])
        return df.select(make(*[F.col(f"c{i}") for i in range(len(args))]).alias("x")).first()["x"]

    return run
