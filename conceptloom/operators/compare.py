"""Are two labelled lattices the same up to the numbering of their nodes?

A node is known by its signature: intent size, extent size, set of attributes, set of objects.  Joins and groups use a
digest of it, 128 bits for each set: the XOR of two hashes of every different item, which needs no order.  The items
themselves are compared only between nodes of one digest; they are never a key of a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conceptloom.operators.graph import Graph, GraphError, edge_profile
from conceptloom.operators.ordering import number_rows
from conceptloom.scratch import Scratch, side_by_side

DIGEST = ["i", "e", "a0", "a1", "o0", "o1"]
LONG_SET = "struct<n:bigint,o0:bigint,o1:bigint>"


def _folded(items: Column, seed: int) -> Column:
    return F.aggregate(items, F.lit(0).cast("bigint"), lambda acc, x: acc.bitwiseXOR(F.xxhash64(F.lit(seed), x)))


def long_sets(graph: Graph) -> DataFrame:
    """``id``, ``long``: size and digest of the objects of nodes that have some in ``graph.more``."""
    more = graph.more.select("id", "item")
    listed = graph.nodes.join(more.select("id").distinct(), "id", "left_semi").select("id", F.explode("objs").alias("item"))
    every = more.unionByName(listed).distinct().groupBy("id").agg(
        F.count("*").alias("n"), *[F.bit_xor(F.xxhash64(F.lit(seed), "item")).alias(f"o{seed - 1}") for seed in (1, 2)]
    )
    return every.select("id", F.struct("n", "o0", "o1").alias("long"))


def digests(nodes: DataFrame, *keys: str) -> DataFrame:
    """``keys``, ``id``, ``sig`` (the digest); the sizes in a label must match its items.

    A column ``long`` that isn't null (``long_sets``) stands for ``objs``.
    """
    attrs, objs = F.array_distinct("attrs"), F.array_distinct("objs")
    i, e = F.col("n_intent").cast("bigint"), F.col("n_extent").cast("bigint")
    n_objs, folded = F.size(objs).cast("bigint"), [_folded(x, seed) for x in (attrs, objs) for seed in (1, 2)]
    if "long" in nodes.columns:
        n_objs = F.coalesce("long.n", n_objs)
        folded[2:] = [F.coalesce(f"long.{c}", x) for c, x in zip(("o0", "o1"), folded[2:], strict=True)]
    fits = (F.size(attrs) == i) & (n_objs == e)
    values = [i, e, *folded]
    sig = F.struct(*[v.alias(c) for v, c in zip(values, DIGEST, strict=True)])
    problem = F.raise_error(F.concat(F.lit("label sizes do not match the items of node "), F.col("id")))
    kind = f"struct<{','.join(c + ':bigint' for c in DIGEST)}>"
    return nodes.select(*keys, "id", F.when(fits, sig).otherwise(problem.cast(kind)).alias("sig"))


def _items() -> Column:
    """A node's signature in full."""
    attrs, objs = F.array_sort(F.array_distinct("attrs")), F.array_sort(F.array_distinct("objs"))
    return F.struct(F.col("n_intent").cast("bigint").alias("i"), F.col("n_extent").cast("bigint").alias("e"),
                    attrs.alias("attrs"), objs.alias("objs"))


@dataclass(frozen=True)
class Comparison:
    """Differences of a left and a right graph as tables, and the verdict.

    ``matched`` has one row per digest: how many nodes of each side have it (``ln``, ``rn``, NULL for none) and the id
    of one of them.
    """

    matched: DataFrame  # sig, ln, left_id, rn, right_id
    left: DataFrame  # id, sig
    right: DataFrame
    left_edges: DataFrame
    right_edges: DataFrame
    left_nodes: DataFrame
    right_nodes: DataFrame

    def _named(self, rows: DataFrame, nodes: DataFrame, one: str) -> DataFrame:
        """``rows`` with the full signature of node ``one`` as ``sig``."""
        return rows.drop("sig").join(nodes.select(F.col("id").alias(one), _items().alias("sig")), one)

    def only_left(self) -> DataFrame:
        return self._named(self.matched.where("rn is null"), self.left_nodes, "left_id").select("sig")

    def only_right(self) -> DataFrame:
        return self._named(self.matched.where("ln is null"), self.right_nodes, "right_id").select("sig")

    def ambiguous(self) -> DataFrame:
        """Signatures that several nodes of one side share: ``side``, ``sig``, ``id``."""
        def rows(name, side, nodes, n):
            many = self.matched.where(F.col(n) > 1).select("sig")
            found = side.join(many, "sig", "left_semi")
            return self._named(found, nodes, "id").select(F.lit(name).alias("side"), "sig", "id")

        return rows("left", self.left, self.left_nodes, "ln").unionByName(rows("right", self.right, self.right_nodes, "rn"))

    def correspondence(self) -> DataFrame:
        """``common`` (C1, C2, ... in signature order), ``left_id``, ``right_id``, ``sig``.

        Ambiguous signatures keep their number but are not listed.
        """
        both = self._named(self.matched.where("ln is not null and rn is not null"), self.left_nodes, "left_id")
        return number_rows(both, [F.col("sig")], "rank").where("ln = 1 and rn = 1").select(
            F.concat(F.lit("C"), F.col("rank") + 1).alias("common"), "left_id", "right_id", "sig"
        )

    def edge_differences(self) -> DataFrame:
        """Edges between paired nodes that one side lacks: ``side``, ``src``, ``dst``
        as ids of the left graph."""
        pairs = self.matched.where("ln = 1 and rn = 1").select("left_id", "right_id")

        def end(c):
            return pairs.select(F.col("right_id").alias(c), F.col("left_id").alias(f"{c}_l"))

        known = pairs.select("left_id")
        left = self.left_edges
        for c in ("src", "dst"):
            left = left.join(known.withColumnRenamed("left_id", c), c, "left_semi")
        right = self.right_edges.join(end("src"), "src").join(end("dst"), "dst").select(
            F.col("src_l").alias("src"), F.col("dst_l").alias("dst")
        )
        both = left.select("src", "dst", F.lit(1).alias("l")).distinct().join(
            right.select("src", "dst", F.lit(1).alias("r")).distinct(), ["src", "dst"], "full"
        )
        return both.where("l is null or r is null").select(
            F.when(F.col("r").isNull(), "left").otherwise("right").alias("side"), "src", "dst"
        )

    def summary(self) -> DataFrame:
        """One row of counts with ``nodes_match``, ``ambiguous`` and ``equivalent``.

        Edges count only when all nodes match and none is ambiguous.
        """
        def total(n):
            return F.coalesce(F.sum(n), F.lit(0)).cast("bigint")

        nodes = self.matched.agg(
            total("ln").alias("left_nodes"), total("rn").alias("right_nodes"),
            F.count_if(F.col("rn").isNull()).alias("only_left"),
            F.count_if(F.col("ln").isNull()).alias("only_right"),
            (F.count_if(F.col("ln") > 1) + F.count_if(F.col("rn") > 1)).alias("ambiguous_signatures"),
        )
        sizes = self.left_edges.select(F.lit(1).alias("l"), F.lit(0).alias("r")).unionAll(
            self.right_edges.select(F.lit(0), F.lit(1))
        ).agg(total("l").alias("left_edges"), total("r").alias("right_edges"))
        differ = self.edge_differences().agg(
            F.count_if(F.col("side") == "left").alias("el"), F.count_if(F.col("side") == "right").alias("er")
        )
        out = side_by_side([nodes, sizes, differ])
        match = (F.col("only_left") + F.col("only_right") + F.col("ambiguous_signatures")) == 0
        shown = [F.when(match, F.col(c)).otherwise(F.lit(0)).cast("bigint") for c in ("el", "er")]
        return out.select(
            "left_nodes", "right_nodes", "left_edges", "right_edges", "only_left", "only_right",
            "ambiguous_signatures", shown[0].alias("edges_only_left"), shown[1].alias("edges_only_right"),
            (F.col("ambiguous_signatures") > 0).alias("ambiguous"),
            (match & (F.col("el") + F.col("er") == 0)).alias("equivalent"),
        )


def compare_graphs(left: Graph, right: Graph) -> Comparison:
    """Compare two graphs with full labels."""
    left, right = left.saved("left"), right.saved("right")
    for g in (left, right):
        if edge_profile(g).unknown:
            raise GraphError("an edge names an unknown node")
    scratch = Scratch(left.nodes.sparkSession, "compare")
    sides = [scratch.save(digests(g.nodes), name) for g, name in ((left, "left"), (right, "right"))]

    def grouped(side, n, one):
        return side.groupBy("sig").agg(F.count(F.lit(1)).alias(n), F.min("id").alias(one))

    matched = grouped(sides[0], "ln", "left_id").join(grouped(sides[1], "rn", "right_id"), "sig", "full")
    matched = scratch.save(matched, "matched")
    _refuse_clashes(matched, sides, (left.nodes, right.nodes))
    return Comparison(
        matched, *sides,
        left.edges.select("src", "dst").distinct(), right.edges.select("src", "dst").distinct(), left.nodes, right.nodes,
    )


def _refuse_clashes(matched: DataFrame, sides: list[DataFrame], nodes: tuple[DataFrame, DataFrame]) -> None:
    """Raise if nodes of one digest have different items."""
    first = F.coalesce("left_id", "right_id")
    of = matched.select("sig", first.alias("first"), F.col("left_id").isNotNull().alias("is_left"), "ln", "rn")
    shared = of.where("coalesce(ln, 0) + coalesce(rn, 0) > 1").drop("ln", "rn")
    both = lambda rows, n: rows.join(n.select(F.col("id").alias("first"), _items().alias("want")), "first")
    want = both(shared.where("is_left"), nodes[0]).unionByName(both(shared.where("not is_left"), nodes[1]))
    for side, n in zip(sides, nodes, strict=True):
        got = side.join(n.select("id", _items().alias("got")), "id")
        if got.join(want, "sig").where("got <> want").limit(1).count():
            raise GraphError("two labels of one digest differ")


def pairwise(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Verdict for every two producers of a lattice for the same dataset.

    ``nodes`` and ``edges`` are graph tables with ``dataset`` and ``producer``; ``nodes`` may have a column ``long``.
    Result: ``dataset``, ``left``, ``right``, ``equivalent``.
    """
    key = ["dataset", "producer"]
    named = digests(nodes, *key)
    sigs = named.groupBy(*key, "sig").agg(F.count(F.lit(1)).alias("n"))
    ends = edges.select(*key, "src", "dst")
    for c in ("src", "dst"):
        ends = ends.join(
            named.select(*key, F.col("id").alias(c), F.col("sig").alias(f"{c}_sig")), [*key, c]
        )
    arcs = ends.select(*key, "src_sig", "dst_sig").distinct()
    sizes = (
        sigs.groupBy(*key).agg(F.count(F.lit(1)).alias("nodes"), F.max("n").alias("most"))
        .join(arcs.groupBy(*key).agg(F.count(F.lit(1)).alias("edges")), key, "left")
        .fillna(0, ["edges"])
    )

    def shared(df, on, name):
        a = df.select("dataset", F.col("producer").alias("left"), *on)
        b = df.select("dataset", F.col("producer").alias("right"), *on)
        both = a.join(b, ["dataset", *on]).where("left < right")
        return both.groupBy("dataset", "left", "right").agg(F.count(F.lit(1)).alias(name))

    def side(s):
        return sizes.select("dataset", F.col("producer").alias(s), *[
            F.col(c).alias(f"{s}_{c}") for c in ("nodes", "most", "edges")
        ])

    pair = ["dataset", "left", "right"]
    pairs = side("left").join(side("right"), "dataset").where("left < right")
    joined = (
        pairs.join(shared(sigs, ["sig"], "nodes"), pair, "left")
        .join(shared(arcs, ["src_sig", "dst_sig"], "edges"), pair, "left")
        .fillna(0, ["nodes", "edges"])
    )
    same = (
        (F.greatest("left_most", "right_most") == 1)
        & (F.col("nodes") == F.col("left_nodes")) & (F.col("nodes") == F.col("right_nodes"))
        & (F.col("edges") == F.col("left_edges")) & (F.col("edges") == F.col("right_edges"))
    )
    return joined.select(*pair, same.alias("equivalent"))


def equivalence_group_sizes(producers: DataFrame, pairs: DataFrame) -> DataFrame:
    """Largest group of equivalent producers per dataset: ``dataset``, ``n_equivalent``.

    ``producers``: ``dataset``, ``producer`` of the runs that ended well.
    ``pairs``: ``dataset``, ``left``, ``right``, ``equivalent``.  Groups are connected
    components: every producer takes the least label around it until none changes.
    """
    scratch = Scratch(producers.sparkSession, "groups")
    ok = scratch.save(producers.select("dataset", "producer").distinct(), "ok")
    yes = pairs.where("equivalent")
    links = yes.select("dataset", F.col("left").alias("producer"), F.col("right").alias("other")).union(
        yes.select("dataset", F.col("right"), F.col("left"))
    )
    links = links.join(ok, ["dataset", "producer"], "left_semi").join(
        ok.withColumnRenamed("producer", "other"), ["dataset", "other"], "left_semi"
    )
    links = scratch.save(links.distinct(), "links")
    labels = scratch.save(ok.withColumn("label", F.col("producer")), "labels0")
    turn = 0
    while True:
        turn += 1
        heard = links.join(
            labels.select("dataset", F.col("producer").alias("other"), F.col("label").alias("heard")),
            ["dataset", "other"],
        ).groupBy("dataset", "producer").agg(F.min("heard").alias("heard"))
        after = scratch.save(
            labels.join(heard, ["dataset", "producer"], "left").select(
                "dataset", "producer", F.least("label", "heard").alias("label"),
                (F.least("label", "heard") < F.col("label")).alias("moved"),
            ),
            f"labels{turn}",
        )
        labels = after
        if not after.where("moved").limit(1).count():
            break
    sizes = labels.groupBy("dataset", "label").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("dataset").agg(F.max("n").alias("n_equivalent"))
