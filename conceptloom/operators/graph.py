"""Labelled lattice graphs: checks, orientation, reduced to full labels."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conceptloom.functions import masks as M
from conceptloom.scratch import Scratch, side_by_side

SPECIFIC_TO_GENERAL = "specific_to_general"
GENERAL_TO_SPECIFIC = "general_to_specific"


class GraphError(ValueError):
    """The graph is not a labelled lattice."""


@dataclass(frozen=True)
class Graph:
    """``nodes``: ``id``, ``label_id``, ``n_intent``, ``n_extent``, ``attrs``,
    ``objs`` (arrays), ``color`` and, if read from a file, ``options``, the other
    node attributes as a map.  ``edges``: ``src``, ``dst``.  ``more`` is None unless the reader was asked for it."""

    nodes: DataFrame
    edges: DataFrame
    stored: bool = False  # both are written tables
    more: DataFrame | None = None  # id, item: objects of long labels that aren't in objs

    def saved(self, label: str = "graph") -> "Graph":
        if self.stored:
            return self
        scratch = Scratch(self.nodes.sparkSession, label)
        return Graph(scratch.save(self.nodes, "nodes"), scratch.save(self.edges, "edges"), True)


def unknown_endpoints(graph: Graph) -> DataFrame:
    """Edge ends without a node."""
    ends = graph.edges.select("src", "dst", F.explode(F.array("src", "dst")).alias("id"))
    return ends.join(graph.nodes.select("id"), "id", "left_anti").select("src", "dst", F.col("id").alias("missing"))


def _edge_counts(graph: Graph) -> DataFrame:
    """One row over all edges: unknown ends, steps by intent size, direction votes."""
    def side(s):
        return graph.nodes.select(
            F.col("id").alias(s), F.lit(True).alias(f"{s}_known"),
            F.col("n_intent").alias(f"{s}_i"), F.col("n_extent").alias(f"{s}_e"),
        )

    e = graph.edges.join(side("src"), "src", "left").join(side("dst"), "dst", "left")
    forward = (F.col("src_i") >= F.col("dst_i")) & (F.col("src_e") <= F.col("dst_e"))
    backward = (F.col("src_i") <= F.col("dst_i")) & (F.col("src_e") >= F.col("dst_e"))
    return e.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("src_known").isNull() | F.col("dst_known").isNull()).alias("unknown"),
        F.count_if(F.col("src_i") > F.col("dst_i")).alias("down"),
        F.count_if(F.col("src_i") < F.col("dst_i")).alias("up"),
        F.count_if(forward).alias("forward"), F.count_if(backward).alias("backward"),
    ).withColumn(
        "orientation",
        F.when(F.col("forward") >= F.col("backward"), SPECIFIC_TO_GENERAL).otherwise(GENERAL_TO_SPECIFIC),
    )


def edge_profile(graph: Graph):
    return _edge_counts(graph).first()


def orientation_votes(graph: Graph) -> DataFrame:
    """One row: edges that fit each direction, by the sizes in the headers."""
    return _edge_counts(graph).select("forward", "backward", "orientation")


# Steps taken per written round: fewer, larger jobs.
STEPS = 4


def topological_layers(graph: Graph) -> DataFrame:
    """``id``, ``layer``: the longest path that ends in each node; refuses cycles.

    Step r keeps the nodes that end a path of r edges.  Without a cycle every
    step keeps fewer nodes, with one some step keeps them all.
    """
    scratch = Scratch(graph.nodes.sparkSession, "layers")
    edges = graph.edges.select("src", "dst")
    saved = scratch.save(graph.nodes.select("id", F.lit(0).alias("layer")), "round=0")
    left, rounds, at = saved.count(), 0, 0
    while left:
        rounds += 1
        now, steps = saved.where(F.col("layer") == at).select("id"), []
        for step in range(at + 1, at + STEPS + 1):
            now = edges.join(now, edges.src == now.id, "left_semi").select(F.col("dst").alias("id")).distinct()
            steps.append(now.withColumn("layer", F.lit(step)))
        saved = scratch.save(reduce(DataFrame.unionByName, steps), f"round={rounds}")
        counts = {r.layer: r["count"] for r in saved.groupBy("layer").count().collect()}  # STEPS rows
        for step in range(at + 1, at + STEPS + 1):
            if counts.get(step, 0) == left and left:
                raise GraphError("the graph has a cycle")
            left = counts.get(step, 0)
        at += STEPS
    schema = T.StructType([*saved.schema.fields, T.StructField("round", T.IntegerType())])
    every = scratch.spark.read.schema(schema).parquet(scratch.path)
    return every.groupBy("id").agg(F.max("layer").alias("layer"))


def upward(graph: Graph, orientation: str) -> DataFrame:
    """Edges from specific to general whatever the graph's orientation."""
    if orientation == SPECIFIC_TO_GENERAL:
        return graph.edges.select("src", "dst")
    return graph.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


@dataclass(frozen=True)
class FullLabels:
    graph: Graph
    orientation: str
    intents: DataFrame  # id, item
    extents: DataFrame  # id, item


# More different intent sizes than this are not taken as layers.
MAX_LAYERS = 16_385


def _layers(graph: Graph, profile) -> tuple[DataFrame, int]:
    """(``id``, ``layer``) with every edge from a lower to a higher layer, and the number of layers.

    Intent sizes do if every edge strictly changes them the same way; else longest paths, which refuse cycles.
    """
    if profile.n in (profile.down, profile.up):
        sizes = [r.n_intent for r in graph.nodes.select("n_intent").distinct().limit(MAX_LAYERS + 1).collect()]
        if len(sizes) <= MAX_LAYERS:
            order = sorted(sizes, key=lambda i: -1 if i is None else i, reverse=profile.n == profile.down)
            ranks = graph.nodes.sparkSession.createDataFrame(
                [(i, at) for at, i in enumerate(order)], T.StructType([graph.nodes.schema["n_intent"], T.StructField("layer", T.IntegerType())])
            )
            same = graph.nodes["n_intent"].eqNullSafe(ranks["n_intent"])
            return graph.nodes.join(F.broadcast(ranks), same).select("id", "layer"), len(order)  # at most MAX_LAYERS rows
    layers = Scratch(graph.nodes.sparkSession, "layered").save(topological_layers(graph), "layers")
    return layers, (layers.agg(F.max("layer")).first()[0] or 0) + 1


def expand(graph: Graph) -> FullLabels:
    """Reduced to full labels.

    A full intent is a node's own attributes and those of everything above it, a full extent its own objects and those
    of everything below.  Items become bits of numbered chunks; layer by layer, a node's chunks are its own ones or-ed
    with those of its neighbours in the layers before, so every edge is used once and no pair of a node and a far
    ancestor is ever formed.
    """
    graph = graph.saved("expand")
    profile = edge_profile(graph)
    if profile.unknown:
        raise GraphError("an edge names an unknown node")
    layers, depth = _layers(graph, profile)
    scratch = Scratch(graph.nodes.sparkSession, "expand")
    along = profile.orientation == SPECIFIC_TO_GENERAL  # extents flow along the edges, intents against them
    flows = {"objs": along, "attrs": not along}
    places = {True: F.col("layer"), False: F.lit(depth - 1) - F.col("layer")}

    def each(of):
        return reduce(DataFrame.unionByName, [of(k).withColumn("kind", F.lit(k)) for k in flows])

    items = scratch.save(
        each(lambda k: graph.nodes.select(F.explode(k).alias("item"))).distinct()
        .select("kind", "item", F.monotonically_increasing_id().alias("number")), "items",
    )
    items = items.select("kind", "item", F.expr(f"number div {M.WORD_BITS}").alias("chunk"), (F.col("number") % M.WORD_BITS).cast("int").alias("bit"))
    # What each step needs, apart: own chunks, and edges into the nodes of the step's layer.
    own = each(lambda k: graph.nodes.where(F.size(k) > 0).join(layers, "id").select("id", places[flows[k]].alias("step"), F.explode(k).alias("item")))
    bit = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit"))).alias("bits")
    own = scratch.save_by(own.join(items, ["kind", "item"]).groupBy("step", "kind", "id", "chunk").agg(bit), "own", "step")

    def into(k):
        a, b = ("src", "dst") if flows[k] else ("dst", "src")
        ends = graph.edges.select(F.col(a).alias("from"), F.col(b).alias("id")).distinct()
        return ends.join(layers, "id").select("from", "id", places[flows[k]].alias("step"))

    edges = scratch.save_by(each(into), "into", "step")
    key = ["kind", "id", "chunk"]
    done_type = T.StructType([own.schema[c] for c in [*key, "bits"]] + [T.StructField("step", T.IntegerType())])
    for step in range(depth):
        parts = own.where(F.col("step") == step).select(*key, "bits")
        if step:
            done = scratch.read("done", done_type).select("kind", F.col("id").alias("from"), "chunk", "bits")
            parts = parts.unionByName(edges.where(F.col("step") == step).join(done, ["kind", "from"]).select(*key, "bits"))
        scratch.save(parts.groupBy(*key).agg(F.bit_or("bits").alias("bits")), f"done/step={step}")
    done = scratch.read("done", done_type)
    spread = M.each_member(done.select(*key, "bits"), [F.col("bits")], M.WORD_BITS, "bit").join(items, ["kind", "chunk", "bit"])
    spread = scratch.save(spread.select("kind", "id", "item"), "labels")
    return FullLabels(
        graph, profile.orientation,
        spread.where("kind = 'attrs'").select("id", "item"),
        spread.where("kind = 'objs'").select("id", "item"),
    )


def violations(full: FullLabels) -> DataFrame:
    """One row of counts; a correct full labelling has zero everywhere but for the
    one source and the one sink."""
    graph = full.graph
    up = upward(graph, full.orientation)

    def sizes(items, name):
        return items.groupBy("id").agg(F.count(F.lit(1)).alias(name))

    sized = (
        graph.nodes.select("id", "label_id", "n_intent", "n_extent")
        .join(sizes(full.intents, "got_i"), "id", "left")
        .join(sizes(full.extents, "got_e"), "id", "left")
    )
    per_node = sized.agg(
        F.count_if(F.col("label_id") != F.col("id")).alias("bad_ids"),
        F.count_if(F.col("n_intent") != F.coalesce("got_i", F.lit(0))).alias("bad_intents"),
        F.count_if(F.col("n_extent") != F.coalesce("got_e", F.lit(0))).alias("bad_extents"),
    )

    def lost(items, edges, name):
        # items of an edge's start that its end does not have
        carried = edges.join(items, edges.src == items.id).select(F.col("dst").alias("id"), "item")
        return carried.join(items, ["id", "item"], "left_anti").agg(F.count(F.lit(1)).alias(name))

    down = up.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    ids = graph.nodes.select("id")
    sources = ids.join(up.select(F.col("dst").alias("id")), "id", "left_anti").agg(F.count(F.lit(1)).alias("sources"))
    sinks = ids.join(up.select(F.col("src").alias("id")), "id", "left_anti").agg(F.count(F.lit(1)).alias("sinks"))
    repeated = ids.groupBy("id").count().agg(F.count_if(F.col("count") > 1).alias("repeated_ids"))
    parts = [
        per_node,
        lost(full.intents, down, "lost_attributes"),
        lost(full.extents, up, "lost_objects"),
        repeated, sources, sinks,
    ]
    return side_by_side(parts)


def validate(full: FullLabels) -> None:
    row = violations(full).first().asDict()
    wrong = {k: v for k, v in row.items() if v != (1 if k in ("sources", "sinks") else 0)}
    if wrong:
        raise GraphError(f"not a fully labelled lattice: {wrong}")


# A label array is one value of one row; longer ones stay in long form.
MAX_LABEL_ITEMS = 5_000_000


def full_graph(full: FullLabels, max_items: int = MAX_LABEL_ITEMS) -> Graph:
    """The graph with full label arrays.

    Refuses extents beyond ``max_items``; those are in ``full.extents`` and can be
    written without ever forming an array (``sources.dot.expanded_lines``).
    """
    if full.graph.nodes.where(F.greatest("n_intent", "n_extent") > max_items).limit(1).count():
        raise GraphError(f"a label has more than {max_items} items; use the long form")

    def listed(items, name):
        return items.groupBy("id").agg(F.array_sort(F.collect_list("item")).alias(name))

    empty = F.array().cast("array<string>")
    nodes = (
        full.graph.nodes.drop("attrs", "objs")
        .join(listed(full.intents, "attrs"), "id", "left")
        .join(listed(full.extents, "objs"), "id", "left")
        .withColumn("attrs", F.coalesce("attrs", empty))
        .withColumn("objs", F.coalesce("objs", empty))
    )
    return Graph(nodes.select(*full.graph.nodes.columns), full.graph.edges)
