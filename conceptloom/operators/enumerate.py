"""All concepts of a context, with their lower neighbours.

The search walks the canonical ("close by one") tree.  A concept with intent B
is extended by every attribute j outside B: closing B + {j} gives

* a child in the tree if j is large enough and the closure adds nothing below j;
  each concept is the child of exactly one other, so nothing is produced twice
  and no de-duplication is needed;
* a lower neighbour D of B if as many j lead to D as D has more attributes.

Ways to run it, same result:

``frontier`` The default (``operators/frontier.py``): large extents are expanded by
             Spark, small ones walked in groups with just their own rows.
``join``     Breadth first, one pair of jobs per level.  A table holds the
             (concept, row) memberships of the level.  Closures are one mergeable
             aggregate over it, the next level's memberships an equi-join on the
             concept.  Nothing depends on the number of distinct rows.
``subtree``  If the distinct rows are few (their size is checked), every task
             gets them all and walks the subtrees of its share of the frontier.
             A task stops after a fixed number of concepts and hands the rest of
             its frontier back, to be spread over all tasks in the next round.
"""

from __future__ import annotations

import logging
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conceptloom.functions import masks as M
from conceptloom.operators.context import Context
from conceptloom.operators.frontier import enumerate_frontier
from conceptloom.operators.joins import spread_join
from conceptloom.operators.lattice import Lattice, node_type
from conceptloom.scratch import Scratch

# The distinct rows (as sets and as a bit matrix) are sent to the tasks only up
# to this size; wider or longer tables take the join way.
SUBTREE_BYTES = 32 << 20
SUBTREE_ATTRIBUTES = 256
CHUNK_CELLS = 1 << 20  # numbers a task holds at once while it expands concepts
FIRST_SHARE = 4096  # concepts walked before the frontier is spread the first time
SHARE = 20_000  # concepts walked by one task before it hands its frontier back
# ... and fewer of them the more cells the rows have: cells looked at by one task
FIRST_WORK = 64_000_000
WORK = 2_000_000_000


log = logging.getLogger("conceptloom")


class LatticeTooLarge(ValueError):
    """The lattice has more concepts than the caller allowed."""


def build_lattice(
    context: Context,
    method: str = "frontier",
    max_concepts: int | None = None,
    rows: DataFrame | None = None,
) -> Lattice:
    """Enumerate all concepts.

    ``max_concepts`` makes the run fail, never truncate, when there are more.
    ``rows`` replaces the context's distinct rows by ones with a column ``fresh``:
    then only concepts whose extent has a fresh row are visited, which are those
    that an appended batch of objects can change.
    """
    scratch = Scratch(context.spark, "lattice")
    fresh = rows is not None
    if fresh:
        rows = scratch.save(rows, "rows")
    else:
        context = context.with_rows()
        rows = context.rows
    words = context.words()
    head = rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n"),
        *M.rename(M.meet(words), "top"),
        F.coalesce(
            F.bool_or(M.equal(words, M.literal(context.full, context.k))), F.lit(False)
        ).alias("has_full"),
    ).first()
    if head.rows == 0:
        top = context.full
    else:
        top = M.join_int(head[f"top{i}"] for i in range(context.k))
    guard = _Guard(max_concepts)
    if top == context.full:
        # every object has every attribute (or there are none): a single concept
        guard.add(1)
        return Lattice(context, _literal_node(context, top, head.n), guard.count)
    size = head.rows * (8 * context.k + 5 * context.n_attributes + 16)
    fits = size <= SUBTREE_BYTES and context.n_attributes <= SUBTREE_ATTRIBUTES
    if method == "auto":
        method = "frontier"
    if method == "subtree" and not fits:
        raise ValueError(f"{head.rows} rows of {context.n_attributes} attributes are too large for every task; use method='join'")
    walk = {"frontier": enumerate_frontier, "subtree": _by_subtree, "join": _by_join}[method]
    nodes = walk(context, rows, scratch, top, head.n, guard, fresh)
    if not head.has_full:
        # no object has every attribute: the bottom concept has an empty extent
        guard.add(1)
        nodes = nodes.unionByName(_literal_node(context, context.full, 0))
    return Lattice(context, nodes, guard.count)


class _Guard:
    def __init__(self, limit: int | None):
        self.limit = limit
        self.count = 0

    def add(self, n: int) -> None:
        self.count += n
        log.info("%d concepts so far, %d new", self.count, n)
        if self.limit is not None and self.count > self.limit:
            raise LatticeTooLarge(f"more than {self.limit} concepts")


def _literal_node(context: Context, intent: int, n_extent: int) -> DataFrame:
    row = (*M.split_int(intent, context.k), n_extent, [])
    return context.spark.createDataFrame([row], node_type(context.k))


# -- join ------------------------------------------------------------------------


def _by_join(context, rows, scratch, top, total, guard, fresh):
    k, n = context.k, context.n_attributes
    intent, row, closure = M.cols("i", k), M.cols("m", k), M.cols("d", k)
    flag = F.col("fresh") if fresh else F.lit(True)
    guard.add(1)
    # Rows equal to the intent cannot reach any further concept; they are dropped.
    members = rows.select(
        *M.rename(M.literal(top, k), "i"), F.lit(0).alias("y"),
        *row, "n", flag.alias("fresh"),
    ).where(~M.equal(intent, row))
    members = scratch.save(members, "members/level=0")
    level, steps = 0, []
    while n:
        j = F.col("j")
        steps_now = (
            members.select(*M.names("i", k), "y", *row, "n", "fresh", M.each_attribute(n).alias("j"))
            .where(M.contains(row, j) & ~M.contains(intent, j))
            .groupBy(*M.names("i", k), "y", "j")
            .agg(*M.rename(M.meet(row), "d"), F.sum("n").alias("n_extent"),
                 F.bool_or("fresh").alias("fresh"))
            .withColumn("child", (j >= F.col("y")) & M.agree_below(intent, closure, j) & F.col("fresh"))
        )
        # all extensions of the level's concepts, at most one per attribute each
        steps_now = scratch.save(steps_now, f"steps/level={level}")
        steps.append(level)
        children = steps_now.where("child")
        found = children.count()
        if not found:
            break
        guard.add(found)
        kids = children.select(*M.names("i", k), *M.names("d", k), (j + 1).cast("int").alias("next"))
        # early levels: few concepts with large extents, so no shuffle of the extents;
        # later ones: many concepts, none of them in one task only
        members = (
            spread_join(members.drop("y"), kids, M.names("i", k), row, found, 16 * k + 4)
            .where(M.is_strict_subset(closure, row))
            .select(*M.rename(closure, "i"), F.col("next").alias("y"), *row, "n", "fresh")
        )
        level += 1
        members = scratch.save(members, f"members/level={level}")
        scratch.drop(f"members/level={level - 1}")
    top_node = context.spark.createDataFrame(
        [(*M.split_int(top, k), total)], ", ".join(f"i{i} bigint" for i in range(k)) + ", n_extent bigint"
    )
    if not steps:
        return top_node.withColumn("lower", _no_neighbours(k)).select(*node_type(k).names)
    step_type = T.StructType(list(steps_now.schema.fields) + [T.StructField("level", T.IntegerType())])
    every = scratch.read("steps", step_type)
    concepts = top_node.unionByName(
        every.where("child").select(*M.rename(closure, "i"), "n_extent")
    )
    neighbours = (
        every.groupBy(*M.names("i", k), *M.names("d", k)).agg(F.count(F.lit(1)).alias("ways"))
        .where(F.col("ways") == M.size(closure) - M.size(intent))
        .groupBy(*M.names("i", k))
        .agg(F.collect_list(F.struct(*M.rename(closure, "i"))).alias("lower"))  # <= |M| entries
    )
    bottom = F.array(F.struct(*M.rename(M.literal(context.full, k), "i")))
    nodes = concepts.join(neighbours, M.names("i", k), "left").select(
        *M.names("i", k), "n_extent",
        F.when(F.col("lower").isNotNull(), F.col("lower"))
        .when(M.equal(intent, M.literal(context.full, k)), _no_neighbours(k))
        .otherwise(bottom).alias("lower"),
    )
    return scratch.save(nodes, "nodes")


def _no_neighbours(k: int):
    item = ",".join(f"i{i}:bigint" for i in range(k))
    return F.array().cast(f"array<struct<{item}>>")


# -- subtree -----------------------------------------------------------------------


def _by_subtree(context, rows, scratch, top, total, guard, fresh):
    k, n, spark = context.k, context.n_attributes, context.spark
    held = rows.toPandas()  # build_lattice has checked the size
    sets = held[M.names("m", k)].to_numpy("int64").reshape(len(held), k)
    newer = held["fresh"].to_numpy(bool) if fresh else np.ones(len(held), bool)
    shared = spark.sparkContext.broadcast((sets, held["n"].to_numpy("float64"), newer))
    out_type = T.StructType(
        list(node_type(k).fields)
        + [T.StructField("y", T.IntegerType()), T.StructField("open", T.BooleanType())]
    )
    in_cols = [*M.names("i", k), "n_extent", "y"]
    frontier = spark.createDataFrame(
        [(*M.split_int(top, k), total, 0)],
        ", ".join(f"i{i} bigint" for i in range(k)) + ", n_extent bigint, y int",
    )
    cells = max(1, len(held) * n)
    later = min(SHARE, max(64, WORK // cells))
    turn, share = 0, min(FIRST_SHARE, max(32, FIRST_WORK // cells))
    place = np.divmod(np.arange(n), M.WORD_BITS)
    full = np.array(M.split_int(context.full, k), "int64")
    while True:
        def run(batches, share=share, wide=turn == 0):
            return _walk(batches, shared.value, place, full, share, wide)

        done = scratch.save(frontier.mapInArrow(run, out_type), f"walk/turn={turn}")
        tally = done.groupBy("open").count().collect()  # two rows at most
        guard.add(sum(t["count"] for t in tally if not t["open"]))
        pending = sum(t["count"] for t in tally if t["open"])
        if not pending:
            break
        tasks = max(1, min(pending, 4 * spark.sparkContext.defaultParallelism))
        frontier = done.where("open").select(*in_cols).repartition(tasks)
        turn, share = turn + 1, later
    shared.unpersist()
    with_turn = T.StructType([*out_type.fields, T.StructField("turn", T.IntegerType())])
    return scratch.read("walk", with_turn).where("not open").select(*node_type(k).names)


def _walk(
    batches: Iterator[pa.RecordBatch], shared, place, full, share: int, wide: bool
) -> Iterator[pa.RecordBatch]:
    """Expand up to ``share`` concepts of the given frontier; pass on the rest.

    Attribute j is bit ``place[1][j]`` of word ``place[0][j]``.
    """
    sets, weight, newer = shared
    at_word, at_bit = place
    n, k = len(at_word), len(full)
    bits = ((sets[:, at_word] >> at_bit) & 1).astype("float32")
    power = np.zeros((n, k), "int64")
    power[np.arange(n), at_word] = np.left_shift(np.int64(1), at_bit)
    # pairs of attributes each row has; only while that table is small
    both = None
    if bits.shape[0] * n * n <= CHUNK_CELLS:
        both = (bits[:, :, None] * bits[:, None, :]).reshape(-1, n * n)
    chunk = max(1, CHUNK_CELLS // max(1, n * n, len(sets) * k))
    todo: deque[tuple[np.ndarray, np.ndarray, np.ndarray]] = deque()
    for batch in batches:
        cols = [np.asarray(c) for c in batch.columns]
        todo.append((np.stack(cols[:k], axis=1), cols[k], cols[k + 1]))
    while todo and share > 0:
        intents, extents, y = todo.popleft() if wide else todo.pop()
        take = min(chunk, share)
        if len(y) > take:
            rest = (intents[take:], extents[take:], y[take:])
            (todo.appendleft if wide else todo.append)(rest)
            intents, extents, y = intents[:take], extents[:take], y[:take]
        share -= len(y)
        inside = ((sets[None] & intents[:, None]) == intents[:, None]).all(axis=2)
        have = inside.astype("float32")
        # together[c, i, j]: rows in the extent of concept c with attributes i and j
        if both is not None:
            together = (have @ both).reshape(-1, n, n)
        else:
            together = np.stack([bits[x].T @ bits[x] for x in inside])
        support = np.einsum("cjj->cj", together)
        has = ((intents[:, at_word] >> at_bit) & 1).astype(bool)
        outside = ~has & (support > 0)
        closed = together == support[:, :, None]
        # the closure of intent + {j} adds j first: canonical, and first of all
        # attributes that lead to the same closure
        leads = outside & ((closed & ~has[:, None, :]).argmax(axis=2) == np.arange(n))
        # ... and an attribute it adds has a larger extent: something lies between
        between = (closed & outside[:, None, :] & (support[:, None, :] > support[:, :, None])).any(axis=2)
        alive = (have * newer) @ bits > 0
        child = leads & alive & (np.arange(n) >= y[:, None])
        at, j = np.nonzero(child)
        if len(at):
            count = ((inside * weight) @ bits)[at, j].astype("int64")
            todo.append((closed[at, j] @ power, count, (j + 1).astype("int32")))
        at, j = np.nonzero(leads & ~between)
        lower = closed[at, j] @ power
        last = np.flatnonzero(~outside.any(axis=1) & (intents != full).any(axis=1))
        at = np.concatenate([at, last])
        lower = np.concatenate([lower, np.repeat(full[None, :], len(last), axis=0)])
        lower = lower[np.argsort(at, kind="stable")]
        yield _to_batch(intents, extents, y, lower, np.bincount(at, minlength=len(y)), False)
    for intents, extents, y in todo:
        yield _to_batch(intents, extents, y, intents[:0], np.zeros(len(y), int), True)


def _to_batch(intents, extents, y, lower, n_lower, is_open) -> pa.RecordBatch:
    names = [f"i{i}" for i in range(intents.shape[1])]
    items = pa.StructArray.from_arrays([pa.array(c) for c in lower.T], names)
    offsets = pa.array(np.concatenate([[0], np.cumsum(n_lower)]).astype("int32"))
    arrays = [
        *[pa.array(c) for c in intents.T],
        pa.array(extents, pa.int64()),
        pa.ListArray.from_arrays(offsets, items),
        pa.array(y, pa.int32()),
        pa.array(np.full(len(y), is_open)),
    ]
    return pa.RecordBatch.from_arrays(arrays, [*names, "n_extent", "lower", "y", "open"])
