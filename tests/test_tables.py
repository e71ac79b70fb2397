"""The frontier, and operators on concept tables, columns and blocks, against brute force."""

import random

import pytest
from conftest import brute_concepts, brute_covers, got_concepts, got_covers, make_context
from pyspark.sql import functions as F

from conceptloom.functions import masks as M
from conceptloom.operators import blocks as B
from conceptloom.operators import columns as V
from conceptloom.operators import compare as C
from conceptloom.operators import derive as D
from conceptloom.operators import frontier
from conceptloom.operators import graph as G
from conceptloom.operators import joins
from conceptloom.operators import neighbours as N
from conceptloom.operators.enumerate import LatticeTooLarge, build_lattice
from conceptloom.operators.validate import lattice_violations
from conceptloom.sources import dot


def random_rows(seed, n, g, density=0.5):
    r = random.Random(seed)
    return [sum((r.random() < density) << j for j in range(n)) for _ in range(g)]


CASES = [([], 3), ([], 0), ([0, 0], 0), ([0], 3), ([7, 7], 3), ([0, 7, 7, 1], 3), ([1, 2, 4], 3), ([3, 5, 6], 3),
         (random_rows(1, 8, 14), 8), (random_rows(2, 7, 30, 0.3), 7), (random_rows(3, 8, 12, 0.8), 8)]


@pytest.mark.parametrize("rows,n", CASES)
def test_frontier_equals_brute_force(spark, rows, n):
    want = brute_concepts(rows, n)
    lattice = build_lattice(make_context(spark, rows, n))
    assert got_concepts(lattice) == want and lattice.n_concepts == lattice.nodes.count() == len(want)
    covers = got_covers(lattice)
    assert len(covers) == len(set(covers)) and set(covers) == brute_covers(want)


@pytest.mark.parametrize("cells,first,share,chunk", [(0, 5, 5, 1), (40, 2, 3, 1), (1 << 20, 2, 3, 2), (60, 1024, 20_000, 16)])
def test_frontier_wherever_it_is_cut(spark, monkeypatch, cells, first, share, chunk):
    """Extents expanded by Spark, walked in units, or both; frontiers handed back after a few concepts; no broadcast."""
    for name, value in (("LOCAL_CELLS", cells), ("FIRST_SHARE", first), ("SHARE", share), ("LEAST_CHUNK", chunk), ("CHUNK_CELLS", 300)):
        monkeypatch.setattr(frontier, name, value)
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    rows = random_rows(5, 7, 16)
    want = brute_concepts(rows, 7)
    lattice = build_lattice(make_context(spark, rows, 7))
    assert got_concepts(lattice) == want and lattice.n_concepts == len(want)
    assert sorted(got_covers(lattice)) == sorted(brute_covers(want))
    with pytest.raises(LatticeTooLarge):
        build_lattice(make_context(spark, rows, 7), max_concepts=len(want) - 1)


def test_frontier_over_a_wide_context(spark):
    spots = [0, 5, 61, 62, 63, 64, 100, 125, 126, 129]
    rows = random_rows(3, 10, 12)
    spread = [sum(1 << spots[j] for j in range(10) if r >> j & 1) for r in rows]
    lattice = build_lattice(make_context(spark, spread, 130))
    full, want = (1 << 130) - 1, {}
    for intent, extent in brute_concepts(rows, 10).items():
        want[full if extent == 0 else sum(1 << spots[j] for j in range(10) if intent >> j & 1)] = extent
    assert got_concepts(lattice) == want and set(got_covers(lattice)) == brute_covers(want)


def test_members_of_narrow_and_wide_sets(spark):
    for n, sets in ((5, [0, 31, 9]), (63, [1 << 62 | 1]), (130, [0, 1 << 129 | 1 << 63 | 1 << 62 | 1, (1 << 130) - 1])):
        k = M.word_count(n)
        df = spark.createDataFrame([(s, *M.split_int(x, k)) for s, x in enumerate(sets)], "s int, " + ", ".join(f"m{i} bigint" for i in range(k)))
        got = M.each_member(df, M.cols("m", k), n, "j").select("s", "j").collect()
        assert sorted(map(tuple, got)) == [(s, j) for s, x in enumerate(sets) for j in range(n) if x >> j & 1]


def intents_df(spark, intents, n):
    k = M.word_count(n)
    return spark.createDataFrame([tuple(M.split_int(i, k)) for i in intents], ", ".join(f"i{i} bigint" for i in range(k)))


@pytest.mark.parametrize("rows,n", CASES[2:])
def test_covers_of_a_concept_table(spark, rows, n):
    want = brute_concepts(rows, n)
    if not n:
        return
    table = intents_df(spark, want, n)
    given = spark.createDataFrame([(r,) for r in rows], "m0 bigint")
    for found in (N.covers_of_concepts(table, n), N.covers_of_concepts(table, n, given)):
        got = [(r.child0, r.parent0) for r in found.collect()]
        assert sorted(got) == sorted(brute_covers(want))


def test_missing_concepts(spark):
    rows = random_rows(8, 7, 12)
    context, want = make_context(spark, rows, 7), brute_concepts(rows, 7)
    assert not N.missing_concepts(intents_df(spark, want, 7), context).count()
    top = min(want, key=int.bit_count)
    for gone in ([top], sorted(want)[3:6], [max(want)]):
        got = {r.i0 for r in N.missing_concepts(intents_df(spark, [i for i in want if i not in gone], 7), context).collect()}
        assert got and got <= set(gone)
    lattice = build_lattice(context)
    assert lattice_violations(lattice).first().missing == 0
    fewer = type(lattice)(context, lattice.nodes.where(F.col("i0") != sorted(want)[4]), 0)
    assert lattice_violations(fewer).first().missing == 1


@pytest.mark.parametrize("blocks", [1, 3, 7])
def test_blocks_merge_to_the_lattice_of_all_rows(spark, blocks):
    rows = random_rows(11, 6, 11) + [5, 5]
    want = brute_concepts(rows, 6)
    block = B.concepts_by_blocks(make_context(spark, rows, 6), blocks)
    got = [(r.i0, r.n_extent) for r in block.concepts.collect()]
    assert len(got) == len(want) and dict(got) == want
    steps = {(r.i0, r.j): r.d0 for r in block.transitions.collect()}
    close = lambda x: min((i for i in want if i & x == x), key=int.bit_count)
    assert steps == {(i, j): close(i | 1 << j) for i in want for j in range(6) if not i >> j & 1}


def test_closures_by_columns(spark):
    for n, g in ((6, 9), (70, 140)):
        rows = random_rows(13, n, g, 0.6 if n < 63 else 0.9)
        context = make_context(spark, rows, n)
        r = random.Random(1)
        sets = {0, (1 << n) - 1, *(sum(1 << j for j in r.sample(range(n), r.randint(1, 4))) for _ in range(20))}
        k = context.k
        queries = spark.createDataFrame([tuple(M.split_int(s, k)) for s in sets], ", ".join(f"q{i} bigint" for i in range(k)))
        got = {M.join_int(r[f"q{i}"] for i in range(k)): (M.join_int(r[f"d{i}"] for i in range(k)), r.n_extent)
               for r in V.closures_by_columns(V.vertical(context), queries).collect()}
        for s in sets:
            extent = [x for x in rows if x & s == s]
            want = (1 << n) - 1
            for x in extent:
                want &= x
            assert got[s] == (want, len(extent))
        same = {M.join_int(r[f"q{i}"] for i in range(k)): r.n_extent for r in D.closures(context, queries).collect()}
        assert same == {s: e for s, (_, e) in got.items()}


def test_lectic_successors(spark):
    rows, n = random_rows(17, 6, 9), 6
    want = brute_concepts(rows, n)
    key = lambda x: [x >> j & 1 for j in range(n)]
    order = sorted(want, key=key)
    context = make_context(spark, rows, n)
    queries = spark.createDataFrame([(x,) for x in range(1 << n)], "q0 bigint")
    got = {r.q0: (r.d0, r.n_extent) for r in D.next_closed(context, queries).collect()}
    for x in range(1 << n):
        after = next((i for i in order if key(i) > key(x)), None)
        assert got.get(x) == (None if after is None else (after, want[after]))
    chain, at = [], order[0]
    while at is not None:
        chain.append(at)
        at = got.get(at, (None,))[0]
    assert chain == order


FREE = """digraph "x" { rankdir=BT; node [fontsize=9];
"n;1" [shape=record,
   label="{n;1 (I: 1, E: 2)|a\\n|o; [1]\\n\\
p \\"q]\\\\\\n}", fillcolor="orange"]; 2 [label="{2 (I: 0,
 E: 0)||}"] "n;1" -> 2 [color=red];
2 -> 3; 3 [ label="{3 (I: 0, E: 0)|
x ; y
|}" ] }"""


def test_free_layout_of_files_over_many_splits(spark, tmp_path):
    old = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    (tmp_path / "f.dot").write_text(FREE)
    (tmp_path / "w").mkdir()
    context = make_context(spark, random_rows(19, 6, 40), 6)
    lattice = build_lattice(context)
    dot.write_dot(dot.dot_lines(lattice, "full"), str(tmp_path / "one"))
    dot.write_dot(dot.dot_lines(lattice, "full", wrap=2), str(tmp_path / "many"))
    try:
        for size in ("128m", "40b", "7b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1b")
            graph = dot.read_dot(spark, str(tmp_path / "f.dot"), free=True)
            rows = {r.id: r for r in graph.nodes.collect()}
            assert set(rows) == {"n;1", "2", "3"} and rows["n;1"].color == "orange" and rows["n;1"].options == {"shape": "record"}
            assert rows["n;1"].attrs == ["a"] and rows["n;1"].objs == ["o; [1]", 'p "q]\\'] and rows["3"].attrs == ["x ; y"]
            assert sorted(map(tuple, graph.edges.collect())) == [("2", "3"), ("n;1", "2")]
        spark.conf.set("spark.sql.files.maxPartitionBytes", "900b")
        free = [dot.read_dot(spark, str(tmp_path / x), free=True) for x in ("one", "many")]
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    plain = dot.read_dot(spark, str(tmp_path / "one"))
    for other in free:
        assert C.compare_graphs(plain, other).summary().first().equivalent


def test_expansion_of_odd_graphs(spark):
    """Sizes that don't grow along edges take longest paths as layers; items of both kinds may have one name."""
    node = lambda i, a, o: (i, i, 9, 9, a, o, None)
    schema = "id string, label_id string, n_intent bigint, n_extent bigint, attrs array<string>, objs array<string>, color string"
    nodes = spark.createDataFrame([node("t", ["x"], []), node("l", ["a"], ["x"]), node("r", ["b"], ["p"]), node("b", [], ["q"])], schema)
    edges = spark.createDataFrame([("b", "l"), ("b", "r"), ("l", "t"), ("r", "t"), ("b", "t")], "src string, dst string")
    full = G.expand(G.Graph(nodes, edges))
    got = lambda df: sorted(map(tuple, df.collect()))
    assert got(full.intents) == [("b", "a"), ("b", "b"), ("b", "x"), ("l", "a"), ("l", "x"), ("r", "b"), ("r", "x"), ("t", "x")]
    assert got(full.extents) == [("b", "q"), ("l", "q"), ("l", "x"), ("r", "p"), ("r", "q"), ("t", "p"), ("t", "q"), ("t", "x")]
    with pytest.raises(G.GraphError, match="cycle"):
        G.expand(G.Graph(nodes, edges.unionByName(spark.createDataFrame([("t", "b")], edges.schema))))


def test_labels_of_one_digest_are_compared_by_their_items(spark, monkeypatch):
    monkeypatch.setattr(C, "_folded", lambda items, seed: F.lit(0).cast("bigint"))
    nodes = spark.createDataFrame([("0", "0", 1, 0, ["a"], [])], "id string, label_id string, n_intent bigint, n_extent bigint, attrs array<string>, objs array<string>")
    other = nodes.withColumn("attrs", F.array(F.lit("b")))
    edges = spark.createDataFrame([], "src string, dst string")
    with pytest.raises(G.GraphError, match="digest"):
        C.compare_graphs(G.Graph(nodes, edges), G.Graph(other, edges))


def test_stream_state_is_compacted(spark, tmp_path):
    import os

    from conceptloom.streaming.incremental import LatticeState

    rng = random.Random(23)
    state = LatticeState(spark, str(tmp_path / "s"), [f"a{j}" for j in range(5)], compact=2)
    seen = []
    for batch, size in enumerate([3, 2, 0, 2, 1]):
        rows = [rng.getrandbits(5) for _ in range(size)]
        seen += rows
        data = spark.createDataFrame([(100 * batch + i, "o", r) for i, r in enumerate(rows)], "obj_id bigint, name string, m0 bigint")
        for _ in range(2):  # a batch run again counts once, also after its snapshot
            state.append(data, batch)
        parts = [x for kind in ("rows", "nodes") for x in os.listdir(tmp_path / "s" / kind) if x.startswith("batch=")]
        assert len(parts) <= 3
        want = brute_concepts(seen, 5)
        assert got_concepts(state.lattice()) == want
        assert set(got_covers(state.lattice())) == brute_covers(want)
    assert len(os.listdir(tmp_path / "s" / "snapshot")) == 1


def test_labels_of_many_objects_are_read_back(spark, tmp_path):
    """More objects than a label has on one line: normalize_cases, pairwise_matrix and producer_groups read such labels."""
    from conceptloom.plans import catalog

    n = dot.WRAP + 1
    spark.range(n).selectExpr("id c_custkey", "id % 2 c_nationkey").write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(n).selectExpr("id o_custkey", "if(id = 0, '2', '1') o_orderpriority", "'F' o_orderstatus").write.parquet(str(tmp_path / "orders.parquet"))
    spark.sql("select id n_nationkey, string(id) n_name from range(2)").write.parquet(str(tmp_path / "nation.parquet"))
    nodes = catalog.graph_of(spark, str(tmp_path), "cust_prio", "reduced").nodes
    assert nodes.selectExpr("max(size(objs))").first()[0] == n - 1
    found = catalog._produced(spark, str(tmp_path))[0].groupBy("dataset", "producer").agg(F.max(F.size("objs"))).collect()
    assert {(r[0], r[1]): r[2] for r in found if r[0] == "cust_prio"} == {("cust_prio", p): n for p in ("join", "subtree", "broken")}


def test_labels_over_several_files(spark, tmp_path, monkeypatch):
    """A text of many rows is several files, and a label may go on in the next one."""
    import os

    lattice = build_lattice(make_context(spark, random_rows(19, 6, 40), 6))
    dot.write_dot(dot.dot_lines(lattice, "full"), str(tmp_path / "one"))
    monkeypatch.setattr(dot, "ONE_FILE", 0)
    coalesce, parts = "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions"
    old = {c: spark.conf.get(c) for c in (coalesce, parts)}
    spark.conf.set(coalesce, "false")
    spark.conf.set(parts, "7")
    try:
        dot.write_dot(dot.dot_lines(lattice, "full", wrap=2), str(tmp_path / "many"))
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    files = sorted(x for x in os.listdir(tmp_path / "many") if x.startswith("part-"))
    texts = [(tmp_path / "many" / x).read_text() for x in files]
    assert any(t.endswith("\\\n") for t in texts)
    assert C.compare_graphs(dot.read_dot(spark, str(tmp_path / "one")), dot.read_dot(spark, str(tmp_path / "many"), free=True)).summary().first().equivalent


def test_lines_of_suppliers_are_read_once(spark, tmp_path):
    from conceptloom.plans import contexts

    spark.sql("select 1L l_suppkey, id l_partkey from range(3) union all select 2L, 0L").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.sql("select id p_partkey, if(id < 2, 'a', 'b') p_brand from range(3)").write.parquet(str(tmp_path / "part.parquet"))
    context = contexts.supplier_brand(spark, str(tmp_path))
    assert not any("lineitem.parquet" in f for f in context.objects.inputFiles())
    assert [r[0] for r in context.objects.select("obj_id").collect()] == [1] and context.attributes == ("a",)
