"""The context by columns: extents of attributes as chunked bit sets.

Distinct rows are numbered; row r is bit r % 63 of chunk r // 63.  ``columns`` has a row for each attribute and chunk
that isn't empty.  The extent of an attribute set is the AND of its attributes' bits, chunk by chunk, and an attribute
belongs to the set's closure if the extent lies within its column.  No query ever scans the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conceptloom.functions import masks as M
from conceptloom.operators.context import Context
from conceptloom.scratch import Scratch


@dataclass(frozen=True)
class Columns:
    context: Context
    columns: DataFrame  # attr_id, chunk, bits
    chunks: DataFrame  # chunk, bits (of all rows), weights: objects of each row, by bit


def vertical(context: Context) -> Columns:
    context, scratch = context.with_rows(), Scratch(context.spark, "columns")
    rows = scratch.save(context.rows.withColumn("_at", F.monotonically_increasing_id()), "rows").select(
        *context.words(), "n", F.expr(f"_at div {M.WORD_BITS}").alias("chunk"), (F.col("_at") % M.WORD_BITS).cast("int").alias("bit")
    )
    bits = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit"))).alias("bits")
    columns = M.each_member(rows, context.words(), context.n_attributes, "attr_id").groupBy("attr_id", "chunk").agg(bits)
    weights = F.map_from_entries(F.collect_list(F.struct("bit", "n"))).alias("weights")  # at most 63 entries
    return Columns(context, scratch.save(columns, "columns"), scratch.save(rows.groupBy("chunk").agg(bits, weights), "chunks"))


def extents_by_columns(held: Columns, queries: DataFrame) -> DataFrame:
    """``q*``, ``chunk``, ``bits`` of the chunks in which the extent of a distinct set ``q*`` isn't empty."""
    k, n = held.context.k, held.context.n_attributes
    q = M.names("q", k)
    wanted = M.each_member(queries.select(*q), M.cols("q", k), n, "attr_id")
    met = wanted.join(held.columns, "attr_id").groupBy(*q, "chunk").agg(F.bit_and("bits").alias("bits"), F.count(F.lit(1)).alias("_have"))
    met = met.where((F.col("_have") == M.size(M.cols("q", k))) & (F.col("bits") != 0)).select(*q, "chunk", "bits")
    nothing = M.literal(0, k)
    if not queries.where(M.equal(M.cols("q", k), nothing)).limit(1).count():
        return met
    return met.unionByName(held.chunks.select(*M.rename(nothing, "q"), "chunk", "bits"))  # the empty set's extent is all


def closures_by_columns(held: Columns, queries: DataFrame) -> DataFrame:
    """Closures of the sets ``q*``: adds ``d*`` and ``n_extent``, as ``derive.closures``."""
    k = held.context.k
    q = M.names("q", k)
    scratch = Scratch(held.context.spark, "by-columns")
    sets = scratch.save(queries.select(*q).distinct(), "sets")
    extents = scratch.save(extents_by_columns(held, sets), "extents")
    weight = F.aggregate(
        F.map_entries("weights"), F.lit(0).cast("bigint"),
        lambda acc, x: acc + F.when(F.getbit("bits", x["key"]) == 1, x["value"]).otherwise(0),
    )
    sizes = extents.join(held.chunks.select("chunk", "weights"), "chunk").groupBy(*q).agg(
        F.sum(weight).alias("n_extent"), F.count(F.lit(1)).alias("_chunks")
    )
    inside = extents.join(held.columns.withColumnRenamed("bits", "_column"), "chunk").where(
        F.col("bits").bitwiseAND(F.col("_column")) == F.col("bits")
    )
    covered = inside.groupBy(*q, "attr_id").agg(F.count(F.lit(1)).alias("_in"))
    closed = covered.join(sizes.select(*q, "_chunks"), q).where("_in = _chunks").groupBy(*q).agg(
        *M.rename(M.union_of(F.col("attr_id"), k), "d"))
    whole, zero = M.literal(held.context.full, k), F.lit(0).cast("bigint")
    found = sets.join(sizes, q, "left").join(closed, q, "left").select(
        *q, F.coalesce("n_extent", F.lit(0)).cast("bigint").alias("n_extent"),
        *[F.when(F.col("n_extent").isNull(), f).otherwise(F.coalesce(d, zero)).alias(f"d{i}")
          for i, (d, f) in enumerate(zip(M.cols("d", k), whole, strict=True))],
    )
    return queries.join(found, q).select(*queries.columns, *M.names("d", k), "n_extent")
