"""Working tables of the iterative operators.

Each round of an iteration is written as a Parquet table in the folder named by
``spark.checkpoint.dir``.  That cuts the lineage, survives the loss of
executors, and lets the next round read only the columns it needs.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SETTING = "spark.checkpoint.dir"
_local_roots: dict[str, str] = {}  # by application, for local sessions without the setting


def checkpoint_root(spark: SparkSession) -> str:
    root = spark.conf.get(_SETTING, None)
    if root:
        return root.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError(f"set {_SETTING} to a folder that all executors share")
    app = spark.conf.get("spark.app.id", "local")
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="conceptloom-")
    return _local_roots[app]


class Scratch:
    """One operator run's folder below the checkpoint folder."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str, most: int = 0) -> DataFrame:
        """Write ``df``, at most ``most`` rows a file if given, and return it read back from the written table."""
        path = f"{self.path}/{name}"
        df.write.mode("overwrite").option("maxRecordsPerFile", most).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def save_by(self, df: DataFrame, name: str, column: str) -> DataFrame:
        """The same, with a folder for each value of ``column``, so that a reader of one value opens only its files."""
        path = f"{self.path}/{name}"
        df.write.mode("overwrite").partitionBy(column).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Remove a table of this run that nothing reads any more."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def read(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")


def side_by_side(parts: list[DataFrame]) -> DataFrame:
    """One-row tables as one row, without a join."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return every.agg(*[F.max(c).alias(c) for c in every.columns])
