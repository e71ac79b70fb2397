"""Dense numbering in a total order without a single-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from conceptloom.scratch import Scratch

# Up to this many rows one window task is cheaper than a range sort.
SMALL = 100_000


def number_rows(
    df: DataFrame, order: Sequence, id_col: str = "id", rows: int | None = None
) -> DataFrame:
    """Add ``id_col`` = 0, 1, 2, ... in ``order`` (which must be total).

    Tables of more than ``SMALL`` rows are range-partitioned and sorted, written,
    and numbered by the row counts of the partitions before each row's own:
    only one count per partition is ever brought together.
    """
    if rows is None:
        rows = df.limit(SMALL + 1).count()
    if rows <= SMALL:
        at = F.row_number().over(Window.orderBy(*order)).cast("bigint") - 1
        return df.withColumn(id_col, at)
    mono = F.col("_mono")
    ranged = df.orderBy(*order).withColumn("_mono", F.monotonically_increasing_id())
    saved = Scratch(df.sparkSession, "number").save(ranged, "sorted")
    part = F.shiftright(mono, 33)
    counts = saved.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = mono.bitwiseAND(F.lit((1 << 33) - 1))
    return (
        saved.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")  # one row per sort partition
        .withColumn(id_col, F.col("_start") + inside)
        .drop("_part", "_start", "_mono")
    )
