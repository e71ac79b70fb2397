"""Reduced and full labels of a lattice's concepts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conceptloom.functions import masks as M
from conceptloom.operators.derive import attribute_concepts, rows_containing
from conceptloom.operators.joins import spread_join
from conceptloom.operators.lattice import Lattice
from conceptloom.scratch import Scratch


def own_attributes(lattice: Lattice) -> DataFrame:
    """Attributes labelling each concept: ``i*``, ``attr_id``, ``name``."""
    return attribute_concepts(lattice.context).select(
        *M.names("i", lattice.k), "attr_id", "name"
    )


def own_attributes_by_difference(lattice: Lattice) -> DataFrame:
    """The same labels by definition: intent minus the parents' intents."""
    k = lattice.k
    above = lattice.covers().groupBy(*M.names("child", k)).agg(
        *M.rename([F.bit_or(w) for w in M.cols("parent", k)], "u")
    )
    intent, child, union = lattice.intent(), M.cols("child", k), M.cols("u", k)
    zero = F.lit(0).cast("bigint")
    own = M.difference(intent, [F.coalesce(u, zero) for u in union])
    return lattice.concepts().join(above, M.equal(intent, child), "left").select(
        *intent, M.to_names(own, lattice.context.attributes).alias("own_attrs")
    )


def own_objects(lattice: Lattice) -> DataFrame:
    """Objects labelling each concept, one row each: ``i*``, ``obj_id``, ``name``.

    An object belongs to the concept whose intent is exactly the object's row.
    """
    return lattice.context.objects.select(
        *M.rename(lattice.context.words(), "i"), "obj_id", "name"
    )


def own_object_counts(lattice: Lattice) -> DataFrame:
    """``i*``, ``n_own``: objects whose row is exactly the intent."""
    k = lattice.k
    rows = lattice.context.rows.select(*M.rename(lattice.context.words(), "i"), F.col("n").alias("n_own"))
    return lattice.concepts().join(rows, M.names("i", k), "left").select(
        *M.names("i", k), F.coalesce("n_own", F.lit(0)).cast("bigint").alias("n_own")
    )


def color(n: Column) -> Column:
    """Fill colour by number of objects: none, exactly one (NULL), several."""
    return F.when(n == 0, F.lit("lightblue")).when(n > 1, F.lit("orange"))


def labelled_concepts(lattice: Lattice, ids: DataFrame, color_by: str = "own") -> DataFrame:
    """``ids`` plus ``own_attrs``, ``n_own`` and ``color``.

    ``color_by``: ``own`` counts a concept's own objects, ``extent`` all of them.
    """
    k = lattice.k
    keys = M.names("i", k)
    attrs = own_attributes(lattice).groupBy(*keys).agg(  # at most |M| names in all
        F.array_sort(F.collect_list(F.struct("attr_id", "name"))).alias("a")
    ).select(*keys, F.col("a.name").alias("own_attrs"))
    rows = lattice.context.rows.select(
        *M.rename(lattice.context.words(), "i"), F.col("n").alias("n_own")
    )
    n_own = F.coalesce("n_own", F.lit(0)).cast("bigint")
    shown = {"own": n_own, "extent": F.col("n_extent")}[color_by]
    return (
        ids.join(attrs, keys, "left").join(rows, keys, "left")
        .select(
            *ids.columns,
            F.coalesce("own_attrs", F.array().cast("array<string>")).alias("own_attrs"),
            n_own.alias("n_own"),
            color(shown).alias("color"),
        )
    )


def extents(lattice: Lattice, ids: DataFrame) -> DataFrame:
    """Full extents in long form: ``id``, ``obj_id``, ``name``."""
    k = lattice.k
    context = lattice.context
    sets = ids.select("id", *M.rename(lattice.intent(), "q"))
    pairs = Scratch(context.spark, "extents").save(
        rows_containing(context, sets).select("id", *M.names("m", k)), "pairs"
    )
    # many objects may share one row
    return spread_join(
        context.objects, pairs, M.names("m", k), [F.col("obj_id")], pairs.count(), 8 * k + 8
    ).select("id", "obj_id", "name")


def own_objects_with_ids(lattice: Lattice, ids: DataFrame) -> DataFrame:
    """Objects labelling each numbered concept: ``id``, ``obj_id``, ``name``."""
    k = lattice.k
    keys = ids.select("id", *lattice.intent())
    return spread_join(
        own_objects(lattice), keys, M.names("i", k), [F.col("obj_id")], lattice.n_concepts, 8 * k + 8
    ).select("id", "obj_id", "name")
