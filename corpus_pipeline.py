"""From documents to a training mix: toxic texts, exact and near copies and benchmark leaks go, sources are mixed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
Null and empty texts pass the filters like any other text: they are equal to each other, so one of them stays.  Rows
with a null id are kept, as long as no filter rejects their text.  An empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from conceptloom.llm import decontamination, exact_dedup, mixing, simhash_dedup, toxicity
from conceptloom.llm.common import table
from conceptloom.scratch import Scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: the classifier learns from ``labels``; documents that it rejects go."""
    return toxicity.accepted(spark, docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: of equal texts, the row with the largest id stays."""
    return exact_dedup.survivors(spark, docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: of each component of near copies, the document with the least id stays."""
    return simhash_dedup.survivors(spark, docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that hold a benchmark item go."""
    return decontamination.clean(spark, docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: the documents of the mix with their repeats and training positions."""
    return mixing.mix(docs).where("taken > 0")


STAGES = [
    ("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark), ("mixing", mix_sources),
]

ORACLE_SQL = None  # SQL can express neither the classifier nor the windows of stages 1 and 4


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again by the next."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
