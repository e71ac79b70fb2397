"""Derivations and closures.

``X'`` of an attribute set X: the objects that have all of X.
``Y'`` of an object set Y: the attributes all of Y have.
The derivation of the empty set is everything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conceptloom.functions import masks as M
from conceptloom.operators.context import Context
from conceptloom.operators.joins import spread_join
from conceptloom.scratch import Scratch


def objects_having(context: Context, attributes) -> DataFrame:
    """``X'``: the objects that have all the named attributes."""
    x = M.from_names(attributes, context.attributes)
    return context.objects.where(M.is_subset(M.literal(x, context.k), context.words()))


def common_attributes(context: Context, objects: DataFrame) -> DataFrame:
    """``Y'``: one row, the words ``m*`` shared by all rows of ``objects``.

    ``objects`` is any subset of ``context.objects``; none gives all attributes.
    """
    whole = M.literal(context.full, context.k)
    return objects.agg(*M.rename(
        [F.coalesce(w, f) for w, f in zip(M.meet(context.words()), whole)], "m"
    ))


def closure(context: Context, attributes) -> DataFrame:
    """``X''`` of one attribute set with its extent size: ``m*``, ``n_extent``."""
    x = M.from_names(attributes, context.attributes)
    rows = context.rows.where(M.is_subset(M.literal(x, context.k), context.words()))
    whole = M.literal(context.full, context.k)
    return rows.agg(
        *M.rename([F.coalesce(w, f) for w, f in zip(M.meet(context.words()), whole)], "m"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_extent"),
    )


def rows_containing(context: Context, queries: DataFrame) -> DataFrame:
    """All pairs (query, distinct row) with the query's set inside the row.

    ``queries`` has the distinct sets ``q*``; the result adds ``m*`` and ``n``.
    A containment join as an equi-join: every set is looked up under its rarest
    attribute only, so a row meets just the queries that pivot on one of its
    attributes.  The queries of one pivot are spread over many tasks.
    """
    k, n = context.k, context.n_attributes
    context = context.with_rows()
    rows = context.rows
    q, m = M.cols("q", k), M.cols("m", k)
    nothing = M.equal(q, M.literal(0, k))
    counts = [r.n_objects for r in context.support().orderBy("attr_id").collect()]  # |M| rows
    rarity = F.transform(
        M.members(q, n), lambda j: F.struct(F.element_at(F.lit(counts), j + 1).alias("s"), j.alias("j"))
    )
    pivot = F.array_min(rarity).getField("j") if n else F.lit(None)
    keyed = queries.where(~nothing).withColumn("pivot", pivot.cast("int"))
    entries = rows.select(*M.names("m", k), "n", M.each_attribute(n).alias("pivot")).where(
        M.contains(m, F.col("pivot"))
    )
    keyed = keyed.repartition(*M.names("q", k))
    hits = spread_join(keyed, entries, ["pivot"], q, rows.count() * n, 8 * k + 12).where(M.is_subset(q, m))
    # the empty set lies in every row; it occurs at most once among distinct queries
    empty = queries.where(nothing).first()
    out = [*queries.columns, *M.names("m", k), "n"]
    if empty is None:
        return hits.select(*out)
    everywhere = rows.select(
        *[F.lit(empty[c]).cast(queries.schema[c].dataType).alias(c) for c in queries.columns],
        *M.names("m", k), "n",
    )
    return hits.select(*out).unionByName(everywhere)


def closures(context: Context, queries: DataFrame) -> DataFrame:
    """Closures of many attribute sets ``q*``: adds ``d*`` and ``n_extent``."""
    k = context.k
    keys = M.names("q", k)
    distinct = Scratch(context.spark, "queries").save(queries.select(*keys).distinct(), "sets")
    found = rows_containing(context, distinct).groupBy(*keys).agg(
        *M.rename(M.meet(M.cols("m", k)), "d"), F.sum("n").alias("n_extent")
    )
    whole = M.literal(context.full, k)
    return queries.join(found, keys, "left").select(
        *queries.columns,
        *M.rename([F.coalesce(w, f) for w, f in zip(M.cols("d", k), whole)], "d"),
        F.coalesce("n_extent", F.lit(0)).cast("bigint").alias("n_extent"),
    )


def next_closed(context: Context, queries: DataFrame) -> DataFrame:
    """The lectic successor of each set ``q*``, closed or not: adds ``d*``, ``n_extent`` and ``added``, the attribute
    that gives it.  The set of all attributes has none and isn't returned.

    For each attribute j outside a set, what the set has below j is closed with j; of the closures that add nothing
    else below j, that of the largest j comes next.  All candidates of all sets are closed at once.
    """
    k, n = context.k, context.n_attributes
    q, d, j = M.cols("q", k), M.cols("d", k), F.col("added")
    scratch = Scratch(context.spark, "lectic")
    sets = scratch.save(queries.select(*M.names("q", k)).distinct().select(*M.rename(q, "s")), "sets")
    s, full = M.cols("s", k), M.literal(context.full, k)
    tried = M.each_member(sets, M.difference(full, s), n, "added")
    tried = tried.select(*s, "added", *M.rename(M.union(M.intersect(s, M.below(j, k)), M.singleton(j, k)), "q"))
    tried = scratch.save(tried, "tried")
    closed = closures(context, tried.select(*M.names("q", k)).distinct())
    later = tried.join(closed, M.names("q", k)).where(M.agree_below(s, d, j)).groupBy(*M.names("s", k)).agg(
        F.max_by(F.struct(*d, "n_extent", "added"), "added").alias("_next")
    )
    return queries.join(later.select(*M.rename(s, "q"), "_next.*"), M.names("q", k))


def pair_closures(context: Context) -> DataFrame:
    """Closures of all two-attribute sets ``a < b``: ``a``, ``b``, ``d*``, ``n_extent``.

    Pairs that no object has close to all attributes.
    """
    k, n = context.k, context.n_attributes
    whole = M.literal(context.full, k)
    m = M.cols("m", k)
    pairs = context.spark.range(n).select(
        F.col("id").cast("int").alias("a"), M.each_attribute(n).alias("b")
    ).where(F.col("a") < F.col("b"))
    # a distinct row meets each of its own attribute pairs; combined before the shuffle
    found = (
        context.rows.select(*m, "n", M.each_attribute(n).alias("a")).where(M.contains(m, F.col("a")))
        .select(*m, "n", "a", M.each_attribute(n).alias("b"))
        .where((F.col("a") < F.col("b")) & M.contains(m, F.col("b")))
        .groupBy("a", "b").agg(*M.rename(M.meet(m), "d"), F.sum("n").alias("n_extent"))
    )
    return pairs.join(found, ["a", "b"], "left").select(
        "a", "b",
        *M.rename([F.coalesce(w, f) for w, f in zip(M.cols("d", k), whole)], "d"),
        F.coalesce("n_extent", F.lit(0)).cast("bigint").alias("n_extent"),
    )


def attribute_concepts(context: Context) -> DataFrame:
    """The concept of every attribute: ``attr_id``, ``name``, ``i*``, ``n_extent``."""
    k, n = context.k, context.n_attributes
    m = context.words()
    whole = M.literal(context.full, k)
    found = (
        context.rows.select(*m, "n", M.each_attribute(n).alias("attr_id"))
        .where(M.contains(m, F.col("attr_id")))
        .groupBy("attr_id").agg(*M.rename(M.meet(m), "d"), F.sum("n").alias("n_extent"))
    )
    return context.attributes_df().join(found, "attr_id", "left").select(
        "attr_id", "name",
        *M.rename([F.coalesce(w, f) for w, f in zip(M.cols("d", k), whole)], "i"),
        F.coalesce("n_extent", F.lit(0)).cast("bigint").alias("n_extent"),
    )


def object_concepts(context: Context) -> DataFrame:
    """The concept of every object: an object's own row is always closed."""
    return context.objects.select("obj_id", "name", *M.rename(context.words(), "i"))


def with_attributes(context: Context, attributes) -> DataFrame:
    """Relational division on the long form: objects with all named attributes.

    The same answer as ``objects_having``, from (object, attribute) pairs.
    """
    wanted = [j for j, a in enumerate(context.attributes) if a in set(attributes)]
    return (
        context.incidence().where(F.col("attr_id").isin(wanted))
        .groupBy("obj_id").agg(F.count_distinct("attr_id").alias("n"))
        .where(F.col("n") == len(wanted)).select("obj_id")
    )
