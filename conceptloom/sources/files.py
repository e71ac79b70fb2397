"""Finding files through Spark's own file sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def listing(spark: SparkSession, root: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """``path``, ``modified``, ``length`` of the files below ``root``; no content is read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    return reader.load(root).select("path", F.col("modificationTime").alias("modified"), "length")


def datasets(spark: SparkSession, root: str) -> DataFrame:
    """All context files below ``root`` in path order, named by their base name."""
    name = F.regexp_extract("path", r"([^/]+)\.csv$", 1)
    return listing(spark, root, "*.csv").select(name.alias("dataset_id"), "path").orderBy("path")


def latest(spark: SparkSession, root: str, pattern: str) -> str | None:
    """Path of the newest file that matches, or None."""
    row = listing(spark, root, pattern).agg(F.max_by("path", F.struct("modified", "path")).alias("p")).first()
    return row.p
