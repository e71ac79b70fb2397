"""Checks that a set of concepts is the lattice of its context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conceptloom.functions import masks as M
from conceptloom.operators.derive import closures
from conceptloom.operators.lattice import Lattice
from conceptloom.operators.neighbours import missing_concepts
from conceptloom.scratch import side_by_side


def lattice_violations(lattice: Lattice) -> DataFrame:
    """One row of counts, all zero for a correct lattice: intents that occur twice,
    are not closed, or have another extent size; edges that don't lead to a more
    general concept, or that lead past one in between; concepts without a parent, but the top; concepts that the
    others lead to and that are missing."""
    k = lattice.k
    concepts = lattice.concepts()
    intent, closed = lattice.intent(), M.cols("d", k)
    repeated = concepts.groupBy(*M.names("i", k)).count().where("count > 1")
    checked = closures(
        lattice.context,
        concepts.select(*M.rename(intent, "q"), F.col("n_extent").alias("told")),
    ).agg(
        F.count_if(~M.equal(M.cols("q", k), closed)).alias("not_closed"),
        F.count_if(F.col("n_extent") != F.col("told")).alias("wrong_extent"),
    )
    child, parent = M.cols("child", k), M.cols("parent", k)
    covers = lattice.covers().agg(
        F.count_if(~M.is_strict_subset(parent, child)).alias("wrong_direction")
    )
    # nothing lies between a cover's ends if each attribute that only the child has closes the parent to the child
    edges = lattice.covers().distinct()
    steps = M.each_member(edges, M.difference(child, parent), lattice.context.n_attributes, "attr_id").select(
        *child, *parent, *M.rename(M.union(parent, M.singleton(F.col("attr_id"), k)), "q")
    )
    closed_steps = closures(lattice.context, steps.select(*M.names("q", k)).distinct()).select(*M.names("q", k), *closed)
    skipped = steps.join(closed_steps, M.names("q", k)).where(~M.equal(closed, child)).select(*child, *parent).distinct().agg(
        F.count(F.lit(1)).alias("skipped_level")
    )
    # every concept but the top lies below another one
    tops = concepts.join(
        lattice.covers().select(*M.rename(child, "i")), M.names("i", k), "left_anti"
    ).agg(F.count(F.lit(1)).alias("n"))
    return side_by_side([
        repeated.agg(F.count(F.lit(1)).alias("repeated")),
        checked,
        covers,
        skipped,
        tops.select((F.col("n") - 1).alias("extra_tops")),
        missing_concepts(concepts, lattice.context).agg(F.count(F.lit(1)).alias("missing")),
    ])
