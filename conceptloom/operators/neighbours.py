"""Covers and completeness of a given concept table, whoever computed it.

A table of intents that is closed under intersection determines its own closures: the closure of a set is the meet of
all intents that contain it.  For every intent and every attribute outside it, that closure is found by one containment
join (inverted index on each set's rarest attribute) and one mergeable aggregate; a closure D of intent B is a neighbour
of B if as many attributes lead to it as D has more.  The rows that generate the table can stand for its intents, which
shortens the join: object rows, or those of ``generating_rows``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conceptloom.functions import masks as M
from conceptloom.operators.context import Context
from conceptloom.operators.derive import rows_containing
from conceptloom.operators.graph import Graph
from conceptloom.scratch import Scratch


def table_context(rows: DataFrame, n_attributes: int) -> Context:
    """Sets ``m*`` as the rows of a context with numbered attributes."""
    k = M.word_count(n_attributes)
    distinct = rows.select(*M.cols("m", k), *(["n"] if "n" in rows.columns else [F.lit(1).cast("bigint").alias("n")]))
    stored = Scratch(rows.sparkSession, "rows").save(distinct.groupBy(*M.names("m", k)).agg(F.sum("n").alias("n")), "rows")
    names = tuple(str(j) for j in range(n_attributes))
    return Context(stored.select(F.monotonically_increasing_id().alias("obj_id"), F.lit("").alias("name"), *M.cols("m", k)), names, stored)


def generating_rows(intents: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """``m*``, ``n``: the row of every object, from ``intents`` (id, ``i*``) and ``members`` (id, item), which hold full
    extents, own objects or anything between: an object's row is the largest intent among its nodes."""
    row = F.struct(M.size(M.cols("i", k)).alias("size"), *M.cols("i", k))
    best = members.join(intents, "id").groupBy("item").agg(F.max(row).alias("_r"))
    return best.groupBy(*[c.alias(f"m{i}") for i, c in enumerate(M.fields(F.col("_r"), "i", k))]).agg(F.count(F.lit(1)).alias("n"))


def transitions(concepts: DataFrame, rows: Context) -> DataFrame:
    """``i*``, ``j``, ``d*``: the closure of each intent with each attribute ``j`` outside it."""
    k, n = rows.k, rows.n_attributes
    intent, row, j = M.cols("q", k), M.cols("m", k), F.col("j")
    q, full, zero = M.names("q", k), M.literal(rows.full, k), F.lit(0).cast("bigint")
    sets = Scratch(rows.spark, "sets").save(concepts.select(*M.rename(M.cols("i", k), "q")).distinct(), "sets")
    met = M.each_member(rows_containing(rows, sets), M.difference(row, intent), n, "j").groupBy(*q, "j").agg(*M.rename(M.meet(row), "d"))
    met = Scratch(rows.spark, "met").save(met, "met")
    # Attributes that no containing row has lead to the set of all attributes.
    seen = met.groupBy(*q).agg(*M.rename(M.union_of(j, k), "s"))
    left = M.difference(M.difference(full, intent), [F.coalesce(s, zero) for s in M.cols("s", k)])
    rest = sets.join(seen, q, "left").select(*intent, *M.rename(left, "s"))
    rest = M.each_member(rest, M.cols("s", k), n, "j").select(*intent, "j", *M.rename(full, "d"))
    return met.select(*intent, "j", *M.cols("d", k)).unionByName(rest).select(*M.rename(intent, "i"), "j", *M.cols("d", k))


def steps_of(concepts: DataFrame, rows: Context) -> DataFrame:
    """``i*``, ``d*``, ``ways``: the closures of each intent with one attribute more, and how many attributes lead there."""
    keys = [*M.names("i", rows.k), *M.names("d", rows.k)]
    return transitions(concepts, rows).groupBy(*keys).agg(F.count(F.lit(1)).alias("ways"))


def covers_of_concepts(concepts: DataFrame, n_attributes: int, rows: DataFrame | None = None) -> DataFrame:
    """``child*``, ``parent*``: the cover relation of the intents ``i*`` of a closed table."""
    k = M.word_count(n_attributes)
    given = rows if rows is not None else concepts.select(*M.rename(M.cols("i", k), "m"))
    steps = steps_of(concepts, table_context(given, n_attributes))
    near = steps.where(F.col("ways") == M.size(M.cols("d", k)) - M.size(M.cols("i", k)))
    return near.select(*M.rename(M.cols("d", k), "child"), *M.rename(M.cols("i", k), "parent"))


def missing_concepts(concepts: DataFrame, context: Context) -> DataFrame:
    """``i*``: closures of a given intent and one attribute more, and of nothing, that the table lacks.

    Every concept is reached from the top by such steps, so a table without missing ones is complete.
    """
    k = context.k
    context = context.with_rows()
    top = context.rows.agg(*M.rename(
        [F.coalesce(w, f) for w, f in zip(M.meet(M.cols("m", k)), M.literal(context.full, k), strict=True)], "i"))
    reached = steps_of(concepts, context).select(*M.rename(M.cols("d", k), "i")).unionByName(top).distinct()
    return reached.join(concepts.select(*M.names("i", k)).distinct(), M.names("i", k), "left_anti")


def concepts_of_graph(graph: Graph, attributes: list[str]) -> tuple[DataFrame, DataFrame]:
    """(``id``, ``i*``, ``n_extent``) of a graph with full labels, and its generating rows."""
    k, spark = M.word_count(len(attributes)), graph.nodes.sparkSession
    numbers = spark.createDataFrame(list(enumerate(attributes)), "attr_id int, item string")  # the context's attributes
    own = graph.nodes.select("id", F.explode("attrs").alias("item")).join(F.broadcast(numbers), "item")
    sets = own.groupBy("id").agg(*M.rename(M.union_of(F.col("attr_id"), k), "i"))
    zero = F.lit(0).cast("bigint")
    intents = Scratch(spark, "intents").save(graph.nodes.select("id", "n_extent").join(sets, "id", "left").select(
        "id", *[F.coalesce(w, zero).alias(f"i{i}") for i, w in enumerate(M.cols("i", k))], "n_extent"), "intents")
    return intents, generating_rows(intents.drop("n_extent"), graph.nodes.select("id", F.explode("objs").alias("item")), k)
