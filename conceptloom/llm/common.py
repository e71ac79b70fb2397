"""Helpers shared by the operators of this subpackage.

All take null texts as empty texts and null ids as ids like any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A key with more than this share of the rows is joined by broadcast, so at most HEAVY such keys exist.
HEAVY = 4096


#: Bytes of rows that a Python worker is sent at once within ``small_batches``.
BATCH_BYTES = 4 << 20


@contextmanager
def small_batches(spark: SparkSession, size: int = BATCH_BYTES) -> Iterator[None]:
    """Tables written within send whole texts to Python in batches of bounded bytes, not only of bounded rows."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spare(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    while name in df.columns:
        name += "_"
    return name


def whole_text(column: str = "text") -> Column:
    """The text, null as the empty one."""
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def id_remainder(modulus: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``modulus``; -1 for a null id."""
    crc = F.crc32(F.col(column).cast("string").cast("binary"))
    return F.coalesce(F.pmod(crc, F.lit(modulus)), F.lit(-1)).cast("int")


def lookup(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, spread: Column) -> DataFrame:
    """``left`` with the columns of ``right`` (one row per key, ``weight`` rows of ``left`` have it) or nulls.

    Keys with over 1 / HEAVY of all ``total`` rows are at most HEAVY rows, whatever the size of the tables, and
    are broadcast; rows that they serve are dealt out by ``spread`` in the join of the others.
    """
    values = [c for c in right.columns if c not in (key, weight)]
    packed = lambda df, name: df.select(key, F.struct(*values).alias(name))
    is_heavy = F.col(weight) * F.lit(HEAVY) > F.lit(total)
    heavy, light = packed(right.where(is_heavy), "_h"), packed(right.where(~is_heavy), "_l")
    dealt = left.join(F.broadcast(heavy), key, "left").withColumn(
        "_salt", F.when(F.col("_h").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(spread), F.lit(1 << 20)))
    )
    both = dealt.join(light.withColumn("_salt", F.lit(0).cast("bigint")), [key, "_salt"], "left")
    return both.select(*left.columns, *[F.coalesce(f"_h.{v}", f"_l.{v}").alias(v) for v in values])
