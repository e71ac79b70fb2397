"""Configuration and run records as JSON tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

STAGES = ("execution", "normalize", "compare", "report")

# The fields of the file formats, in their documented order.
ALGORITHM = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("csv_path_template", T.StringType()),
    T.StructField("command_template", T.StringType()),
    T.StructField("dot_glob_template", T.StringType()),
    T.StructField("timeout_seconds", T.LongType()),
])
DATASET = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
])
RUN = T.StructType([
    T.StructField("selected_algorithms", T.ArrayType(T.StringType())),
    T.StructField("selected_datasets", T.ArrayType(T.StringType())),
    T.StructField("stages", T.ArrayType(T.StringType())),
    T.StructField("timeout_seconds", T.LongType()),
    T.StructField("continue_on_error", T.BooleanType()),
])
EXECUTION = T.StructType([
    T.StructField("algorithm_id", T.StringType()),
    T.StructField("dataset_id", T.StringType()),
    T.StructField("command", T.ArrayType(T.StringType())),
    T.StructField("status", T.StringType()),
    T.StructField("returncode", T.IntegerType()),
    T.StructField("timed_out", T.BooleanType()),
    T.StructField("elapsed_seconds", T.DoubleType()),
    T.StructField("started_at", T.StringType()),
    T.StructField("finished_at", T.StringType()),
    T.StructField("peak_rss_bytes", T.LongType()),
    T.StructField("peak_disk_bytes", T.LongType()),
    T.StructField("peak_written_live_bytes", T.LongType()),
    T.StructField("peak_io_read_bytes", T.LongType()),
    T.StructField("peak_io_write_bytes", T.LongType()),
    T.StructField("peak_io_rchar_bytes", T.LongType()),
    T.StructField("peak_io_wchar_bytes", T.LongType()),
    T.StructField("total_written_bytes", T.LongType()),
    T.StructField("monitor_sample_count", T.LongType()),
    T.StructField("raw_dot_source", T.StringType()),
    T.StructField("raw_dot_copy", T.StringType()),
    T.StructField("stdout_log", T.StringType()),
])


class ConfigError(ValueError):
    """A configuration file is not valid."""


def read_records(spark: SparkSession, path: str, schema: T.StructType, field: str | None = None) -> DataFrame:
    """Records of a JSON document, or of the array ``field`` in it; a missing file
    has none."""
    outer = schema if field is None else T.StructType([T.StructField(field, T.ArrayType(schema))])
    try:
        df = spark.read.schema(outer).json(path, multiLine=True, mode="FAILFAST")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise
    return df if field is None else df.select(F.inline(field))


def write_records(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def config_problems(algorithms: DataFrame, datasets: DataFrame, run: DataFrame) -> DataFrame:
    """Everything wrong with a configuration, one ``problem`` per row."""
    def blank(c):
        return F.col(c).isNull() | (F.trim(F.col(c)) == "")

    def told(df, text):
        return df.select(F.concat_ws(" ", F.lit(text), F.col("x").cast("string")).alias("problem"))

    out = []
    for what, df, required in (
        ("algorithm", algorithms, ALGORITHM.names[:5]), ("dataset", datasets, ["id", "label"])
    ):
        for c in required:
            out.append(told(df.where(blank(c)).select(F.coalesce("id", F.lit("?")).alias("x")), f"{what} without {c}:"))
        twice = df.groupBy("id").count().where("count > 1").select(F.col("id").alias("x"))
        out.append(told(twice, f"{what} defined twice:"))
    for what, df in (("algorithm", algorithms), ("run", run)):
        bad = df.where(F.col("timeout_seconds").isNull() | (F.col("timeout_seconds") <= 0))
        out.append(told(bad.select(F.col("timeout_seconds").alias("x")), f"{what} timeout must be positive:"))
    for column, known in (("selected_algorithms", algorithms), ("selected_datasets", datasets)):
        chosen = run.select(F.explode(column).alias("id"))
        out.append(told(chosen.join(known, "id", "left_anti").select(F.col("id").alias("x")), f"unknown entry of {column}:"))
    stages = run.select(F.explode("stages").alias("x"))
    out.append(told(stages.where(~F.col("x").isin(*STAGES)), "unknown stage:"))
    from functools import reduce

    return reduce(DataFrame.unionByName, out)


def load_config(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, dict]:
    """The selected algorithms and datasets and the run settings; refuses errors.

    Nothing selected means everything.
    """
    algorithms = read_records(spark, os.path.join(folder, "algorithms.json"), ALGORITHM, "algorithms")
    datasets = read_records(spark, os.path.join(folder, "datasets.json"), DATASET, "datasets")
    run = read_records(spark, os.path.join(folder, "run.json"), RUN)
    problems = [r.problem for r in config_problems(algorithms, datasets, run).limit(20).collect()]
    if problems:
        raise ConfigError("; ".join(problems))
    settings = run.first()
    if settings is None:
        raise ConfigError("run.json is missing or empty")
    settings = settings.asDict()
    for key, table in (("selected_algorithms", "a"), ("selected_datasets", "d")):
        if settings[key]:
            keep = F.col("id").isin(settings[key])
            if table == "a":
                algorithms = algorithms.where(keep)
            else:
                datasets = datasets.where(keep)
    return algorithms, datasets, settings
