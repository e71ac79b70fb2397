"""Connected components of an edge table, as joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conceptloom.scratch import Scratch


def components(scratch: Scratch, edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, label): the least node that can be reached from each node of ``edges`` (a, b).

    Each round takes the least label among the neighbours, then the label of that label, so chains shorten by more
    than half.  Every round is a written table; nothing but the number of changes reaches the driver.
    """
    edges = edges.select("a", "b")
    either = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # Each node is its own neighbour, so one join gives the least label around it and its own one.
    both = scratch.save(either.unionByName(either.select("a", F.col("a").alias("b")).distinct()), f"{name}-edges")
    labels = scratch.save(both.groupBy("a").agg(F.min("b").alias("label")).select(F.col("a").alias("node"), "label"), f"{name}-0")
    turn = 0
    while True:
        turn += 1
        stepped = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("_l")), "b").groupBy("a").agg(
            F.min("_l").alias("label"), F.max(F.when(F.col("a") == F.col("b"), F.col("_l"))).alias("_was")
        )
        # Only labels that are not their own label can lead further.
        onward = labels.where("node <> label").select(F.col("node").alias("label"), F.col("label").alias("_next"))
        moved = scratch.save(
            stepped.join(onward, "label", "left").select(
                F.col("a").alias("node"), F.least("label", F.coalesce("_next", "label")).alias("label"), "_was"
            ), f"{name}-{turn}",
        )
        changed = moved.where("label <> _was").limit(1).count()
        scratch.drop(f"{name}-{turn - 1}")
        labels = moved.select("node", "label")
        if not changed:
            scratch.drop(f"{name}-edges")
            return labels
