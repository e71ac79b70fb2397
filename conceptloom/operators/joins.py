"""Equi-joins whose hot keys must not land in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A side is broadcast only up to this many (estimated) bytes.
BROADCAST_BYTES = 32 << 20
# Beyond it, every key of the large side is spread over this many tasks and the
# small side is sent to each of them.
SPREAD = 16


def spread_join(
    large: DataFrame, small: DataFrame, on: Sequence[str], spread_by: Sequence[Column],
    small_rows: int, row_bytes: int,
) -> DataFrame:
    """Inner join of a large side, of which one key may hold any share, with a
    smaller one of ``small_rows`` rows of about ``row_bytes`` bytes."""
    on = list(on)
    if small_rows * row_bytes <= BROADCAST_BYTES:
        return large.join(F.broadcast(small), on)
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(SPREAD)).cast("int")
    copies = small.withColumn("_salt", F.explode(F.lit(list(range(SPREAD)))))
    return large.withColumn("_salt", salt).join(copies, [*on, "_salt"]).drop("_salt")
