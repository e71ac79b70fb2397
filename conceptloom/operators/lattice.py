"""The lattice of a context: all concepts and their lower neighbours.

A concept is kept as its intent, the words ``i0, i1, ...``, with ``n_extent``
objects.  ``lower`` lists the intents of its lower neighbours: at most one per
attribute outside the intent, so the array is bounded by the context's width.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conceptloom.functions import masks as M
from conceptloom.operators.context import Context
from conceptloom.operators.ordering import number_rows


@dataclass(frozen=True)
class Lattice:
    context: Context
    nodes: DataFrame  # i*, n_extent, lower
    n_concepts: int

    @property
    def k(self) -> int:
        return self.context.k

    def intent(self, prefix: str = "i"):
        return M.cols(prefix, self.k)

    def concepts(self) -> DataFrame:
        """``i*``, ``n_intent``, ``n_extent``; one row per concept."""
        return self.nodes.select(
            *self.intent(), M.size(self.intent()).alias("n_intent"), "n_extent"
        )

    def covers(self, **of_parent: Column) -> DataFrame:
        """Hasse diagram: ``child*`` (specific) -> ``parent*`` (general).

        ``of_parent`` adds columns over the parent's node, worked out once for all its children.
        """
        return self.nodes.select(
            *M.rename(self.intent(), "parent"), *[c.alias(n) for n, c in of_parent.items()], F.explode("lower").alias("_child")
        ).select(
            *M.rename(M.fields(F.col("_child"), "i", self.k), "child"), *M.names("parent", self.k), *of_parent
        )

    def intent_names(self, prefix: str = "i"):
        """Column: attribute names of the intent, in attribute order."""
        return M.to_names(self.intent(prefix), self.context.attributes)

    def order(self, by: str = "intent"):
        """Sort keys that give concepts their ids.

        ``intent``: fewer attributes first, then the sets as numbers;
        ``intent_desc``: more attributes first, then their hexadecimal text;
        ``members``: more attributes first, then the sorted attribute numbers;
        ``names``: fewer attributes first, then the sorted attribute names;
        ``lectic``: lectic order of the intents.
        """
        size = M.size(self.intent())
        numbers = M.members(self.intent(), self.context.n_attributes)
        if by == "intent":
            return [size, *reversed(self.intent())]
        if by == "intent_desc":
            return [size.desc(), M.to_hex(self.intent())]
        if by == "members":
            return [size.desc(), numbers]
        if by == "names":
            return [size, F.array_sort(self.intent_names())]
        if by == "lectic":
            # the smallest attribute weighs most: compare bit texts from attribute 0 up
            return [F.reverse(F.lpad(F.bin(w), M.WORD_BITS, "0")) for w in self.intent()]
        raise ValueError(f"unknown concept order {by!r}")

    def with_ids(self, by: str = "intent") -> DataFrame:
        """Concepts with dense ids 0..n-1."""
        return number_rows(self.concepts(), self.order(by), rows=self.n_concepts)

    def cover_ids(self, ids: DataFrame) -> DataFrame:
        """Cover edges as ``child_id``, ``parent_id``; ``ids`` is ``with_ids()``."""
        def side(s):
            return ids.select(
                *M.rename(self.intent(), s), F.col("id").alias(f"{s}_id")
            )

        return (
            self.covers()
            .join(side("child"), M.names("child", self.k))
            .join(side("parent"), M.names("parent", self.k))
            .select("child_id", "parent_id")
        )

    def memberships(self, ids: DataFrame) -> DataFrame:
        """Long form of the intents: ``id``, ``attr_id``."""
        n = self.context.n_attributes
        return ids.select("id", *self.intent(), M.each_attribute(n).alias("attr_id")).where(
            M.contains(self.intent(), F.col("attr_id"))
        ).select("id", "attr_id")

    def having(self, ids: DataFrame, attributes) -> DataFrame:
        """Concepts whose intent has all named attributes, by relational division."""
        wanted = [j for j, a in enumerate(self.context.attributes) if a in set(attributes)]
        found = (
            self.memberships(ids).where(F.col("attr_id").isin(wanted)).groupBy("id")
            .agg(F.count_distinct("attr_id").alias("n")).where(F.col("n") == len(wanted))
        )
        return ids.join(found.select("id"), "id", "left_semi")

    def write_edges(self, ids: DataFrame, path: str) -> None:
        """Cover edges as JSON lines ``{"src", "dst"}``, specific to general."""
        edges = self.cover_ids(ids).select(F.col("child_id").alias("src"), F.col("parent_id").alias("dst"))
        edges.write.mode("errorifexists").json(path)

    def level_histogram(self) -> DataFrame:
        """Concepts and cumulated concepts per intent size."""
        levels = self.concepts().groupBy("n_intent").agg(F.count(F.lit(1)).alias("n_concepts"))
        upto = Window.orderBy("n_intent").rowsBetween(Window.unboundedPreceding, 0)
        return levels.withColumn("n_upto", F.sum("n_concepts").over(upto))

    def extremes(self) -> DataFrame:
        """Top and bottom concept."""
        size = M.size(self.intent())
        at = F.struct(size.alias("n_intent"), *self.intent(), "n_extent")
        ends = self.nodes.agg(F.min(at).alias("top"), F.max(at).alias("bottom"))
        pick = F.array(*[
            F.struct(F.lit(e).alias("which"), F.col(e).alias("c")) for e in ("top", "bottom")
        ])
        return ends.select(F.inline(pick)).select("which", "c.*")


def node_type(k: int) -> T.StructType:
    word = [T.StructField(n, T.LongType()) for n in M.names("i", k)]
    return T.StructType(
        [*word, T.StructField("n_extent", T.LongType()),
         T.StructField("lower", T.ArrayType(T.StructType(word)))]
    )
