"""The one way all concepts are enumerated by default, at any number of rows.

A frontier of concepts is worked off from the top down.  Each open concept has the distinct rows of its extent with it:

* An open concept with a large extent is expanded by Spark: its (concept, row) pairs, each with the attributes the
  row has beyond the intent, are one mergeable aggregate to all closures, and the next level's pairs an equi-join.
* One with a small extent (at most ``LOCAL_CELLS`` cells, counting only attributes that still occur below it) is the
  root of a unit: its rows and its part of the frontier go to one group, and its subtree is walked there.  A unit stops
  after a share of concepts and hands its frontier back; the next round cuts each root's open concepts into as many
  chunks as their number asks for, and only the root's few rows are copied.
* Within a unit, a concept (B, y) whose subtree has few free attributes (from y on, not in B) but is expected to have many
  concepts isn't walked: a table over all sets of free attributes gets the closure of each by and-ing, one attribute after
  the other, and the concepts of the subtree are the sets that are their own closure.

The top is always expanded by Spark, so the first walk has a unit for each of its subtrees.  The decision is made
concept by concept; no table of rows ever reaches the driver or every task.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conceptloom.functions import masks as M
from conceptloom.operators.context import Context
from conceptloom.operators.joins import spread_join
from conceptloom.operators.lattice import node_type
from conceptloom.scratch import Scratch

# Rows x attributes of a root's extent that one task may hold; attributes of it.
LOCAL_CELLS, LOCAL_ATTRIBUTES = 1 << 20, 512
# Numbers a task holds at once while it expands concepts.
CHUNK_CELLS = 1 << 20
# Concepts that a unit walks before it hands its frontier back: at first, and later.
FIRST_SHARE, SHARE = 1024, 20_000
# Free attributes of a subtree that is closed as a table, at first (in larger ones the frontier is handed back) and later;
# concepts that a unit finds in such tables before it hands its frontier back; cells that such a table costs in any case.
FIRST_TABLE, TABLE, TABLE_SHARE, TABLE_START = 10, 16, 1 << 19, 200_000
# Cells that a unit looks at before it hands its frontier back.
WORK = 1_000_000_000
# Concepts of a file, as a file of any size may be one row group, which one task reads.
FILE = 100_000
# Chunks of open concepts for each core and round, and open concepts of a chunk.
CHUNKS, LEAST_CHUNK = 3, 16


# _UP_TO[n, d]: sets of at most d of n attributes.
_UP_TO = np.cumsum([[comb(n, d) for d in range(32)] for n in range(32)], axis=1)


def enumerate_frontier(context: Context, rows: DataFrame, scratch: Scratch, top: int, total: int, guard, fresh: bool) -> DataFrame:
    """Nodes (``node_type``) of all concepts but a bottom with an empty extent."""
    k, n = context.k, context.n_attributes
    intent, row, closure, union = M.cols("i", k), M.cols("m", k), M.cols("d", k), M.cols("u", k)
    i_names, m_names, d_names = M.names("i", k), M.names("m", k), M.names("d", k)
    guard.add(1)
    # Rows equal to an intent reach no further concept.
    members = rows.select(
        *M.rename(M.literal(top, k), "i"), F.lit(0).alias("y"), *row, "n", (F.col("fresh") if fresh else F.lit(True)).alias("fresh")
    ).where(~M.equal(intent, row))
    level, units = 0, False
    j = F.col("j")
    while True:
        steps = (
            M.each_member(members, M.difference(row, intent), n, "j")
            .groupBy(*i_names, "y", "j")
            .agg(*M.rename(M.meet(row), "d"), *M.rename([F.bit_or(w) for w in row], "u"), F.sum("n").alias("n_extent"),
                 F.count("*").alias("n_rows"), F.bool_or("fresh").alias("fresh"))
            .withColumn("child", (j >= F.col("y")) & M.agree_below(intent, closure, j) & F.col("fresh"))
            .withColumn("active", M.size(M.difference(union, closure)))
            .withColumn("local", (F.col("active") * F.col("n_rows") <= LOCAL_CELLS) & (F.col("active") <= LOCAL_ATTRIBUTES))
            .drop(*M.names("u", k))
        )
        # at most one step for each concept and attribute
        steps = scratch.save(steps, f"steps/level={level}")
        found = steps.where("child").agg(F.count("*").alias("all"), F.count_if("local").alias("local")).first()
        wide = found.all - found.local
        guard.add(wide)
        if not found.all:
            break
        kids = steps.where("child").select(*i_names, *d_names, (j + 1).cast("int").alias("next"), "n_extent", "local")
        following = (
            spread_join(members.drop("y"), kids, i_names, row, found.all, 16 * k + 13)
            .where(M.is_subset(closure, row) & (F.col("local") | ~M.equal(closure, row)))
            .select(*M.rename(closure, "i"), F.col("next").alias("y"), *row, "n", "fresh", "local")
        )
        members = scratch.save(following, f"members/level={level + 1}")
        level, units = level + 1, units or found.local > 0
        if not wide:
            break
        members = members.where("not local").drop("local")
    word = ", ".join(f"{c} bigint" for c in i_names)
    top_node = context.spark.createDataFrame([(*M.split_int(top, k), total)], f"{word}, n_extent bigint")
    step_type = T.StructType([*steps.schema.fields, T.StructField("level", T.IntegerType())])
    every = scratch.read("steps", step_type)
    nodes = scratch.save(_expanded(context, every, top_node), "nodes")
    if not units:
        return nodes
    member_type = T.StructType([T.StructField(c, T.LongType()) for c in i_names] + [T.StructField("y", T.IntegerType())]
                               + [T.StructField(c, T.LongType()) for c in [*m_names, "n"]]
                               + [T.StructField(c, T.BooleanType()) for c in ("fresh", "local")])
    held = scratch.read("members", member_type).where("local")
    roots = every.where("child and local").select(
        *M.rename(closure, "r"), *M.rename(closure, "i"), "n_extent", (j + 1).cast("int").alias("y")
    )
    return nodes.unionByName(_walked(context, scratch, roots, held.select(*M.rename(intent, "r"), *m_names, "n", "fresh"), guard))


def _expanded(context: Context, steps: DataFrame, top_node: DataFrame) -> DataFrame:
    """Nodes of the concepts that Spark expanded."""
    k = context.k
    intent, closure, i_names = M.cols("i", k), M.cols("d", k), M.names("i", k)
    concepts = top_node.unionByName(steps.where("child and not local").select(*M.rename(closure, "i"), "n_extent"))
    neighbours = (
        steps.groupBy(*i_names, *M.names("d", k)).agg(F.count("*").alias("ways"))
        .where(F.col("ways") == M.size(closure) - M.size(intent))
        .groupBy(*i_names).agg(F.collect_list(F.struct(*M.rename(closure, "i"))).alias("lower"))  # <= |M| entries
    )
    none = F.array().cast(node_type(k)["lower"].dataType)
    bottom = F.array(F.struct(*M.rename(M.literal(context.full, k), "i")))
    return concepts.join(neighbours, i_names, "left").select(
        *i_names, "n_extent",
        F.coalesce("lower", F.when(M.equal(intent, M.literal(context.full, k)), none).otherwise(bottom)).alias("lower"),
    )


def _walked(context: Context, scratch: Scratch, roots: DataFrame, held: DataFrame, guard) -> DataFrame:
    k = context.k
    r_names, i_names = M.names("r", k), M.names("i", k)
    unit = [*r_names, "chunk"]
    out_type = T.StructType([
        *[T.StructField(c, T.LongType()) for c in r_names], *node_type(k).fields,
        T.StructField("y", T.IntegerType()), T.StructField("open", T.BooleanType()),
    ])
    cores = context.spark.sparkContext.defaultParallelism
    # Units are few and small in bytes, but not in work: their partitions aren't to be merged by size.
    tasks = max(int(context.spark.conf.get("spark.sql.shuffle.partitions")), 4 * cores)
    frontier, rows, turn = roots.withColumn("chunk", F.lit(0)), held.withColumn("chunk", F.lit(0)), 0
    while True:
        walk = _walk_unit(context.n_attributes, k, context.full, FIRST_SHARE if turn == 0 else SHARE, turn == 0)
        done = scratch.save(
            frontier.repartition(tasks, *unit).groupBy(*unit).cogroup(rows.repartition(tasks, *unit).groupBy(*unit))
            .applyInArrow(walk, out_type), f"walk/turn={turn}", FILE
        )
        tally = done.agg(F.count_if(~F.col("open")).alias("closed"), F.count_if("open").alias("open")).first()
        guard.add(tally.closed)
        if not tally.open:
            break
        each = max(LEAST_CHUNK, -(-tally.open // (CHUNKS * cores)))
        opened = done.where("open").select(*r_names, *i_names, "n_extent", "y")
        chunks = opened.groupBy(*r_names).agg(F.ceil(F.count("*") / each).cast("int").alias("chunks"))
        frontier = spread_join(opened, chunks, r_names, M.cols("i", k), tally.open, 8 * k + 4).withColumn(
            "chunk", F.pmod(F.xxhash64(*i_names), F.col("chunks")).cast("int")).drop("chunks")
        rows = held.join(chunks, r_names).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
        turn += 1
    with_turn = T.StructType([*out_type.fields, T.StructField("turn", T.IntegerType())])
    return scratch.read("walk", with_turn).where("not open").select(*node_type(k).names)


def _columns(table: pa.Table, names: list[str]) -> np.ndarray:
    return np.stack([table[c].to_numpy() for c in names], axis=1) if names else np.zeros((len(table), 0), np.int64)


def _walk_unit(n: int, k: int, full: int, share: int, wide: bool) -> Callable:
    """Walks the subtrees of a unit's open concepts over the rows of its root."""
    place = np.divmod(np.arange(n), M.WORD_BITS)
    full_words = np.array(M.split_int(full, k), np.int64)

    def bits(words: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (words[:, place[0][at]] >> place[1][at]) & 1 == 1

    def walk(frontier: pa.Table, rows: pa.Table) -> pa.Table:
        root = _columns(frontier, M.names("r", k))[0] if len(frontier) else None
        if root is None:
            return _table(k, np.zeros((0, k), np.int64), [], [], [])
        sets = _columns(rows, M.names("m", k))
        some = np.bitwise_or.reduce(sets, axis=0, keepdims=True) & ~root
        active = np.flatnonzero(bits(some, np.arange(n))[0])  # attributes that still occur below the root
        power = np.zeros((len(active), k), np.int64)
        power[np.arange(len(active)), place[0][active]] = np.left_shift(np.int64(1), place[1][active])
        walker = _Walker(bits(sets, active), rows["n"].to_numpy().astype(float), rows["fresh"].to_numpy(zero_copy_only=False))
        y = np.searchsorted(active, frontier["y"].to_numpy())
        limit = min(share, max(16, WORK // max(1, walker.cells)))
        closed, opened = walker.run(bits(_columns(frontier, M.names("i", k)), active), frontier["n_extent"].to_numpy(), y, limit, wide)
        y_of = np.append(active, n)
        out = []
        for sets_of, extent, lower, counts in walker.tabled:
            words, below = _unpacked(sets_of, power) | root, _unpacked(lower, power) | root
            last = (counts == 0) & (words != full_words).any(axis=1)
            at = np.cumsum(counts) + np.cumsum(last) - 1
            filled = np.repeat(full_words[None], len(lower) + last.sum(), axis=0)
            if last.any():
                filled[np.delete(np.arange(len(filled)), at[last])] = below
            else:
                filled = below
            out.append(_table(k, root, words, extent, np.zeros(len(counts), int), filled, counts + last))
        for found, is_open in ((closed, False), (opened, True)):
            for has, extent, low, lower, counts in found:
                words = has @ power | root
                below = lower @ power | root
                last = (counts == 0) & (words != full_words).any(axis=1) & (not is_open)
                at = np.sort(np.concatenate([np.repeat(np.arange(len(counts)), counts), np.flatnonzero(last)]))
                filled = np.repeat(full_words[None], len(at), axis=0)
                filled[~last[at]] = below
                out.append(_table(k, root, words, extent, y_of[low], filled, counts + last, is_open))
        return pa.concat_tables(out)

    return walk


def _unpacked(sets: np.ndarray, power: np.ndarray) -> np.ndarray:
    """Words of sets packed as one number each, bit j for the attribute of ``power[j]``."""
    out = np.zeros((len(sets), power.shape[1]), np.int64)
    for byte in range(-(-len(power) // 8)):
        part = power[8 * byte:8 * byte + 8]
        every = np.zeros((1, power.shape[1]), np.int64)
        for one in part:
            every = np.concatenate([every, every | one])
        out |= every[(sets >> (8 * byte)) & (len(every) - 1)]
    return out


def _table(k, root, words, extent, y, lower=None, counts=None, is_open=False) -> pa.Table:
    if lower is None:
        words, lower, counts, extent, y, root = np.zeros((0, k), np.int64), np.zeros((0, k), np.int64), np.zeros(0, int), [], [], np.zeros(k, np.int64)
    names = M.names("i", k)
    items = pa.StructArray.from_arrays([pa.array(c) for c in lower.T], names)
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    return pa.table([
        *[pa.array(np.full(len(words), r)) for r in root], *[pa.array(c) for c in words.T], pa.array(extent, pa.int64()),
        pa.ListArray.from_arrays(offsets, items), pa.array(y, pa.int32()), pa.array(np.full(len(words), is_open)),
    ], names=[*M.names("r", k), *names, "n_extent", "lower", "y", "open"])


class _Walker:
    """The canonical tree over one set of rows, as matrices of the rows' active attributes."""

    def __init__(self, rows: np.ndarray, weight: np.ndarray, newer: np.ndarray):
        self.rows, self.weight, self.newer = rows.astype(np.float32), weight, newer
        r, a = rows.shape
        self.cells = r * max(1, a)
        self.lacks = np.ascontiguousarray((1 - self.rows).T)
        # pairs of attributes each row has; only while that table is small
        self.both = (self.rows[:, :, None] * self.rows[:, None, :]).reshape(r, a * a) if r * a * a <= CHUNK_CELLS else None
        self.chunk = max(1, CHUNK_CELLS // max(1, a * a, r))
        # rows as numbers, for subtrees that are closed as tables
        self.packed = rows @ (np.int64(1) << np.arange(a)) if a < M.WORD_BITS else None
        self.tabled: list[tuple] = []  # (sets, extents, lower neighbours, how many of each), sets as numbers

    def run(self, has, extent, y, share: int, wide: bool):
        """(closed, open): lists of (intents, extents, y, lower neighbours, how many of each)."""
        todo, closed, kept, room = deque([(has, extent, y)]), [], [], TABLE_SHARE
        while todo and share > 0 and room > 0:
            has, extent, y = todo.popleft() if wide else todo.pop()
            take = min(self.chunk, share)
            if len(y) > take:
                (todo.appendleft if wide else todo.append)((has[take:], extent[take:], y[take:]))
                has, extent, y = has[:take], extent[:take], y[:take]
            inside = (has.astype(np.float32) @ self.lacks) == 0
            size = self.table_sizes(has, y, inside)
            for c in np.flatnonzero(size >= 0):
                if size[c] > (FIRST_TABLE if wide else TABLE) or room <= 0:
                    kept.append((has[c:c + 1], extent[c:c + 1], y[c:c + 1]))
                else:
                    room -= self.close_table(has[c], int(y[c]), np.flatnonzero(inside[c]))
            rest = size < 0
            has, extent, y, inside = has[rest], extent[rest], y[rest], inside[rest]
            share -= len(y)
            if not len(y):
                continue
            lower, counts, child = self.expand(has, y, inside)
            closed.append((has, extent, y, lower, counts))
            if len(child[1]):
                todo.append(child)
        none = np.zeros((0, self.rows.shape[1]), bool)
        return closed, [(h, e, y, none, np.zeros(len(y), int)) for h, e, y in [*todo, *kept]]

    def table_sizes(self, has: np.ndarray, y: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """Free attributes of each concept's subtree if a table closes it for less than the walk would, else -1.

        The walk's cost is guessed from the sets of free attributes that rows would share if attributes were independent;
        a wrong guess costs time only.
        """
        a = self.rows.shape[1]
        if self.packed is None:
            return np.full(len(y), -1)
        support = inside.astype(np.float32) @ self.rows
        n_rows = inside.sum(axis=1)
        outside = ~has & (support > 0)
        free = outside & (np.arange(a) >= y[:, None])
        f, low = free.sum(axis=1), (outside & ~free).sum(axis=1)
        share = np.log(np.where(free, support / np.maximum(n_rows, 1)[:, None], 1)).sum(axis=1) / np.maximum(f, 1)
        depth = np.where(share < 0, np.log(np.maximum(n_rows, 1)) / np.maximum(-share, 1e-9), f)
        small = np.minimum(f, TABLE)
        likely = _UP_TO[small, np.minimum(depth, small).astype(int)]
        cost = TABLE_START + (low + 2) * f * np.exp2(small)
        return np.where((f <= TABLE) & (cost <= likely * (self.cells * a / 8 + 1000)), f, -1)

    def close_table(self, has: np.ndarray, y: int, at: np.ndarray) -> int:
        """Closes the whole subtree of a concept at the rows ``at`` of its extent; returns how many concepts it has."""
        rows, sets, one = self.rows[at] > 0, self.packed[at], np.int64(1)
        outside = np.flatnonzero(rows.any(axis=0) & ~has)
        low, free = outside[outside < y], outside[outside >= y]
        f = len(free)
        place = rows[:, free] @ (one << np.arange(f))
        # shut[0][t]: what all rows with the free attributes t share, all bits if there is none; shut[1 + i]: of those with low[i]
        shut = np.full((1 + len(low), 1 << f), -1, np.int64)
        np.bitwise_and.at(shut[0], place, sets)
        for i, j in enumerate(low):
            some = rows[:, j]
            np.bitwise_and.at(shut[1 + i], place[some], sets[some])
        extent = np.bincount(place, self.weight[at], 1 << f)
        newer = self.newer[at]
        fresh = None if newer.all() else np.bincount(place, newer, 1 << f)
        for b in range(f):
            halves = shut.reshape(1 + len(low), -1, 2, 1 << b)
            halves[:, :, 0] &= halves[:, :, 1]
            for sums in (extent, fresh):
                if sums is not None:
                    halves = sums.reshape(-1, 2, 1 << b)
                    halves[:, 0] += halves[:, 1]
        every = np.zeros(1, np.int64)
        for j in free:
            every = np.concatenate([every, every | (one << j)])
        others = np.bitwise_or.reduce(one << outside.astype(np.int64), initial=0)
        # a concept of the subtree: no attribute but its free ones, and those of the subtree's root, is shared
        good = (shut[0] != -1) & ((shut[0] & others) == every)
        if fresh is not None:
            good &= fresh > 0
        t = np.flatnonzero(good)
        intent = shut[0][t]
        # reach[x]: closures of the intents with outside[x]
        reach = np.concatenate([shut[1:, t], shut[0][t[None] | (1 << np.arange(f))[:, None]]])
        bit = (one << outside.astype(np.int64))[:, None]
        valid = (reach != -1) & ((intent & bit) == 0)
        added = reach & ~(intent | bit)
        lower = valid & (added == 0)
        # an attribute that adds others: the first that leads to its closure, and none of the others leads to a smaller set
        x, c = np.nonzero(valid & (added != 0) & ((added & (bit - 1)) == 0))
        got, more = reach[x, c], added[x, c]
        least = np.ones(len(x), bool)
        for i, j in enumerate(outside):
            least &= ((more >> j) & 1 == 0) | (reach[i, c] == got)
        lower[x[least], c[least]] = True
        self.tabled.append((intent, extent[t].astype(np.int64), reach.T[lower.T], lower.sum(axis=0)))
        return len(t)

    def expand(self, has: np.ndarray, y: np.ndarray, inside: np.ndarray):
        a = self.rows.shape[1]
        have = inside.astype(np.float32)
        # together[c, i, j]: rows in the extent of concept c with attributes i and j
        if self.both is not None:
            together = (have @ self.both).reshape(len(has), a, a)
        else:
            together = np.stack([self.rows[x].T @ self.rows[x] for x in inside])
        support = np.einsum("cjj->cj", together)
        outside = ~has & (support > 0)
        shut = together == support[:, :, None]
        # The closure of intent + {j} adds j first: canonical, and first of the attributes that lead to it.
        leads = outside & ((shut & ~has[:, None, :]).argmax(axis=2) == np.arange(a)) if a else outside
        # An attribute it adds has a larger extent: something lies between.
        between = (shut & outside[:, None, :] & (support[:, None, :] > support[:, :, None])).any(axis=2)
        alive = (have * self.newer) @ self.rows > 0
        at, j = np.nonzero(leads & alive & (np.arange(a) >= y[:, None]))
        children = (shut[at, j], ((inside * self.weight) @ self.rows)[at, j].astype(np.int64), j + 1)
        at, j = np.nonzero(leads & ~between)
        return shut[at, j], np.bincount(at, minlength=len(y)), children
