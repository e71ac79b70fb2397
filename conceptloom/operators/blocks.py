"""Lattices of row blocks and their merge.

The concepts of all rows are the intersections A & B of an intent A of one block and B of the other, but most pairs give
an intent that others give too.  Each intent C has one canonical pair, the closures of C in both blocks, and a child of
C in the canonical tree has the pair (closure of A + {j}, closure of B + {j}).  So a block is kept as its intents and its
transitions (intent, j -> closure), and the merge walks pairs from the tops down, level by level: two look-ups of
transitions by equi-joins, one AND, and the canonicity test.  No pair is tried that isn't canonical, nothing is made
twice, no rows are read, and the walk leaves the transitions of the merged block, for the next merge.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conceptloom.functions import masks as M
from conceptloom.operators.context import Context
from conceptloom.operators.enumerate import build_lattice
from conceptloom.operators.neighbours import transitions
from conceptloom.scratch import Scratch


@dataclass(frozen=True)
class Block:
    n_attributes: int
    concepts: DataFrame  # i*, n_extent
    transitions: DataFrame  # i*, j, d*

    @property
    def k(self) -> int:
        return M.word_count(self.n_attributes)


def block_of(context: Context) -> Block:
    """The block of a context's rows; also of none, whose only intent is the set of all attributes."""
    context = context.with_rows()
    scratch = Scratch(context.spark, "block")
    concepts = scratch.save(build_lattice(context).concepts().select(*M.names("i", context.k), "n_extent"), "concepts")
    return Block(context.n_attributes, concepts, scratch.save(transitions(concepts, context), "transitions"))


def merge(left: Block, right: Block) -> Block:
    """The block of the rows of both."""
    k, n = left.k, left.n_attributes
    scratch = Scratch(left.concepts.sparkSession, "merge")
    a, b, c, j = M.cols("a", k), M.cols("b", k), M.cols("c", k), F.col("j")
    na, nb, nc = (M.names(x, k) for x in "abc")
    full = M.literal((1 << n) - 1, k)
    d, e = M.cols("d", k), M.cols("e", k)

    def top(block: Block, to: str) -> DataFrame:
        # the top is the one intent inside all others
        least = F.min(F.struct(M.size(M.cols("i", k)).alias("size"), *M.cols("i", k))).alias("_t")
        return block.concepts.agg(least).select(F.lit(0).alias("one"), *M.rename(M.fields(F.col("_t"), "i", k), to))

    frontier = top(left, "a").join(top(right, "b"), "one").select(*a, *b, *M.rename(M.intersect(a, b), "c"), F.lit(0).alias("y"))
    frontier = scratch.save(frontier, "pairs/level=0")  # one row
    moves = [
        (block.transitions.select(*M.rename(M.cols("i", k), s), "j", *M.rename(M.cols("d", k), t)), M.names(s, k), words, t)
        for block, s, words, t in ((left, "a", a, "d"), (right, "b", b, "e"))
    ]
    level = 0
    while True:
        tried = M.each_member(frontier, M.difference(full, c), n, "j")
        for steps, keys, words, to in moves:
            # an attribute that the block's own intent has leaves it as it is
            found = tried.join(steps, [*keys, "j"], "left")
            tried = found.select(*tried.columns, *[F.coalesce(x, w).alias(f"{to}{i}") for i, (x, w) in enumerate(zip(M.cols(to, k), words, strict=True))])
        tried = tried.select(*nc, "y", "j", *M.rename(d, "a"), *M.rename(e, "b"), *M.rename(M.intersect(d, e), "d"))
        tried = scratch.save(tried.withColumn("child", (j >= F.col("y")) & M.agree_below(c, d, j)), f"steps/level={level}")
        level += 1
        frontier = scratch.save(tried.where("child").select(*a, *b, *M.rename(d, "c"), (j + 1).cast("int").alias("y")), f"pairs/level={level}")
        if not frontier.limit(1).count():
            break
    levelled = lambda t: T.StructType([*t.fields, T.StructField("level", T.IntegerType())])
    pairs = scratch.read("pairs", levelled(frontier.schema)).select(*na, *nb, *nc)
    sized = pairs
    for block, to, size in ((left, "a", "_l"), (right, "b", "_r")):
        sized = sized.join(block.concepts.select(*M.rename(M.cols("i", k), to), F.col("n_extent").alias(size)), M.names(to, k))
    concepts = sized.select(*M.rename(c, "i"), (F.col("_l") + F.col("_r")).alias("n_extent"))
    steps = scratch.read("steps", levelled(tried.schema)).select(*M.rename(c, "i"), "j", *d)
    return replace(left, concepts=scratch.save(concepts, "concepts"), transitions=steps)


def concepts_by_blocks(context: Context, blocks: int) -> Block:
    """The lattice of a context from ``blocks`` blocks of its distinct rows, merged two at a time."""
    context = context.with_rows()
    of = F.pmod(F.xxhash64(*context.words()), F.lit(blocks))
    made = [
        block_of(Context(context.objects, context.attributes, Scratch(context.spark, "part").save(context.rows.where(of == b), "rows")))
        for b in range(blocks)
    ]
    while len(made) > 1:
        made = [merge(*made[i : i + 2]) if i + 1 < len(made) else made[i] for i in range(0, len(made), 2)]
    return made[0]
