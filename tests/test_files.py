import os

import pytest
from conftest import ANIMALS, ANIMALS_SIZE, make_context
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conceptloom.operators import compare as C
from conceptloom.operators import graph as G
from conceptloom.operators.context import from_masks
from conceptloom.operators.enumerate import build_lattice
from conceptloom.sources import context_csv as S
from conceptloom.sources import dot


def content(context):
    return context.attributes, [tuple(r) for r in context.objects.orderBy("obj_id").collect()]


def write(tmp_path, text, name="c.csv"):
    path = tmp_path / name
    path.write_bytes(text.encode() if isinstance(text, str) else text)
    return str(path)


def test_layouts_give_the_same_context(spark, tmp_path):
    want = content(S.read_context(spark, write(tmp_path, ANIMALS)))
    assert want[1][0] == (0, "ladybird", 289) and len(want[1]) == 10
    quoted = "\n".join(";".join(f'"{c}"' for c in line.split(";")) for line in ANIMALS.split("\n"))
    variants = {
        "comma.csv": ANIMALS.replace(";", ","), "tab.csv": ANIMALS.replace(";", "\t"),
        "quoted.csv": quoted, "bom.csv": "﻿" + ANIMALS, "crlf.csv": ANIMALS.replace("\n", "\r\n") + "\r\n",
        "spaces.csv": ANIMALS.replace(";1", "; 1 "),
    }
    for name, text in variants.items():
        path = write(tmp_path, text, name)
        assert content(S.read_context(spark, path)) == want, name
        assert content(S.read_context(spark, path, mode="boolean")) == want, name
        assert content(S.read_context(spark, path, mode="lenient")) == want, name
    assert content(S.read_context(spark, write(tmp_path, ANIMALS), delimiter="whole-file")) == want


def test_sniffing():
    assert S.sniff_delimiter('"";"a,b,c";"d"') == ";"
    assert S.sniff_delimiter("") == "," and S.sniff_delimiter("a;b,c", tie=";") == ";"


@pytest.mark.parametrize("text", [
    "", "x;a\no;1", ";a;\no;1;0", ";a;a\no;1;0", "o\n1", ";a;b\no;1", ";a;b\no;1;0;1", ";a\no;2", ";a\no;",
    ";a\n;1", ";a\no;1\no;0", ";a",
])
def test_strict_mode_refuses(spark, tmp_path, text):
    with pytest.raises((S.ContextFormatError, PySparkException)):
        S.read_context(spark, write(tmp_path, text))


def test_lenient_and_boolean_cells(spark, tmp_path):
    path = write(tmp_path, ";a;b;c\no;1\n\n;x;1;0\np;1;1;1;1\n")
    assert content(S.read_context(spark, path, mode="lenient"))[1] == [(0, "o", 1), (1, "obj_1", 2), (2, "p", 7)]
    path = write(tmp_path, ";a;b;c\no;true;FALSE;x\np;-;1.0;\n", "b.csv")
    assert content(S.read_context(spark, path, mode="boolean"))[1] == [(0, "o", 5), (1, "p", 2)]
    with pytest.raises(PySparkException):
        S.read_context(spark, write(tmp_path, ";a\no;maybe", "m.csv"), mode="boolean")
    no_attributes = S.read_context(spark, write(tmp_path, "o\np\nq", "n.csv"), mode="lenient")
    assert build_lattice(no_attributes).nodes.first().n_extent == 2


def test_objects_keep_file_order_over_many_splits(spark, tmp_path):
    n = 3000
    path = write(tmp_path, ";a;b\n" + "".join(f"o{i};{i % 2};1\n" for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = content(S.read_context(spark, path))[1]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [(i, f"o{i}", 2 + i % 2) for i in range(n)]


def test_context_write_and_read(spark, tmp_path):
    context = S.read_context(spark, write(tmp_path, ANIMALS))
    S.write_context(context, str(tmp_path / "out"), ",")
    assert content(S.read_context(spark, str(tmp_path / "out"))) == content(context)


def text_of(folder):
    return "".join(
        open(os.path.join(folder, f)).read() for f in sorted(os.listdir(folder)) if f.startswith("part")
    )


def animals(spark, tmp_path):
    return build_lattice(S.read_context(spark, write(tmp_path, ANIMALS)))


def test_dot_text(spark, tmp_path):
    n = dot.write_dot(dot.dot_lines(animals(spark, tmp_path)), str(tmp_path / "d"))
    text = text_of(tmp_path / "d")
    assert n == 2 + sum(ANIMALS_SIZE)
    assert text.startswith("digraph G { \n\trankdir=BT;\n0 [") and text.endswith("\t12 -> 11\n}\n")
    assert '1 [shape=record,style=filled,fillcolor=lightblue,label="{1 (I: 1, E: 8)|flies\\n|}"];' in text
    assert ('fillcolor=orange,label="{9 (I: 6, E: 3)|migratory\\n|greater-flamingo\\nlittle-tern\\n}"];') in text


def test_reduced_expands_to_full(spark, tmp_path):
    lattice = animals(spark, tmp_path)
    for labels in ("reduced", "full"):
        dot.write_dot(dot.dot_lines(lattice, labels), str(tmp_path / labels))
    reduced, full = (dot.read_dot(spark, str(tmp_path / x)) for x in ("reduced", "full"))
    expanded = G.expand(reduced)
    G.validate(expanded)
    assert expanded.orientation == G.SPECIFIC_TO_GENERAL
    built = G.full_graph(expanded)
    assert C.compare_graphs(built, full).summary().first().equivalent
    # written from the expansion, long labels wrapped or not, and read back
    for wrap in (2, 1000):
        path = str(tmp_path / f"again{wrap}")
        dot.write_dot(dot.expanded_lines(expanded, wrap=wrap), path)
        again = dot.read_dot(spark, path, statements=wrap == 2)
        assert C.compare_graphs(again, full).summary().first().equivalent
    assert "|arctic-tern\\nbat\\ngiant-otter\\n" in text_of(tmp_path / "again1000")
    with pytest.raises(G.GraphError):
        G.full_graph(expanded, max_items=3)
    lattice.write_edges(lattice.with_ids(), str(tmp_path / "edges"))
    assert spark.read.json(str(tmp_path / "edges")).count() == ANIMALS_SIZE[1]
    names = {r.name for r in lattice.having(lattice.with_ids(), ["flies", "feathered"]).select(
        F.element_at(lattice.intent_names(), -1).alias("name")).collect()}
    assert lattice.having(lattice.with_ids(), ["flies", "feathered"]).count() == 7 and "feathered" in names
    # edges turned round
    turned = G.Graph(reduced.nodes, reduced.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    back = G.expand(turned)
    assert back.orientation == G.GENERAL_TO_SPECIFIC
    G.validate(back)
    assert sorted(map(tuple, back.intents.collect())) == sorted(map(tuple, expanded.intents.collect()))


def test_node_options_and_odd_ids_survive(spark, tmp_path):
    text = """digraph G {
    "n;1" [shape=box,color="dark red",label="{n;1 (I: 0, E: 2)|||}"];
    }""".replace("|||", "||p\\nq\\n")
    graph = dot.read_dot(spark, write(tmp_path, text, "o.dot"))
    dot.write_dot(dot.expanded_lines(G.expand(graph)), str(tmp_path / "o"))
    again = dot.read_dot(spark, str(tmp_path / "o")).nodes.first()
    assert (again.id, again.label_id) == ("n;1", "n;1")
    assert again.options == {"shape": "box", "color": "dark red"} and again.objs == ["p", "q"]


def test_graph_without_nodes(spark, tmp_path):
    lattice = build_lattice(make_context(spark, [1], 1))
    none = type(lattice)(lattice.context, lattice.nodes.where("false"), 0)
    assert dot.write_dot(dot.dot_lines(none), str(tmp_path / "e")) == 2
    assert text_of(tmp_path / "e") == "digraph G { \n\trankdir=BT;\n}\n"


def test_wrapped_labels_and_odd_names(spark, tmp_path):
    context = make_context(spark, [1, 3, 3, 2, 0, 1], 2)
    names = ['a|b', 'c"d', "e\\", "{f}", "<g; h>", "plain, x"]
    objects = context.objects.drop("name").join(
        spark.createDataFrame(list(enumerate(names)), "obj_id bigint, name string"), "obj_id"
    ).select("obj_id", "name", "m0")
    lattice = build_lattice(from_masks(objects, ["m|1", 'n"2\\']))
    dot.write_dot(dot.dot_lines(lattice, "full"), str(tmp_path / "one"))
    dot.write_dot(dot.dot_lines(lattice, "full", wrap=1), str(tmp_path / "many"))
    assert text_of(tmp_path / "many").count("\\\n") > 6
    lines = dot.read_dot(spark, str(tmp_path / "one"))
    free = dot.read_dot(spark, str(tmp_path / "one"), statements=True)
    wrapped = dot.read_dot(spark, str(tmp_path / "many"), statements=True)
    top = lines.nodes.orderBy(F.desc("n_extent")).first()
    assert top.objs == names
    assert {a for r in lines.nodes.collect() for a in r.attrs} == {"m|1", 'n"2\\'}
    for other in (free, wrapped):
        assert C.compare_graphs(lines, other).summary().first().equivalent
    with pytest.raises(G.GraphError):
        dot.read_dot(spark, str(tmp_path / "many"))


def test_free_layout(spark, tmp_path):
    text = """digraph "x" { rankdir=BT; node [fontsize=9];
    "n;1" [shape=record,
       label="{n;1 (I: 1, E: 2)|a\\\\nb|o; [1]\\lp}", fillcolor="orange"]; 2 [label="{2 (I: 0, E: 0)||}"]
    "n;1" -> 2 [color=red]; }"""
    graph = dot.read_dot(spark, write(tmp_path, text, "f.dot"), statements=True, loose_breaks=True)
    rows = {r.id: r for r in graph.nodes.collect()}
    assert set(rows) == {"n;1", "2"} and rows["n;1"].color == "orange"
    assert rows["n;1"].options == {"shape": "record"} and rows["2"].color is None
    assert rows["n;1"].attrs == ["a", "b"] and rows["n;1"].objs == ["o; [1]", "p"]
    assert [tuple(e) for e in graph.edges.collect()] == [("n;1", "2")]


def test_large_files_are_not_read_as_one_text(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dot, "WHOLE_FILE", 10)
    path = write(tmp_path, 'digraph G {\n0 [label="{0 (I: 0, E: 0)||}"];\n}\n', "big.dot")
    with pytest.raises(G.GraphError, match="too large"):
        dot.read_dot(spark, path, statements=True)
    assert dot.read_dot(spark, path).nodes.count() == 1


def test_very_long_label(spark, tmp_path):
    items = "".join(f"object number {i}\\n" for i in range(60_000))
    text = f'digraph G {{ \n0 [shape=record,label="{{0 (I: 0, E: 60000)||{items}}}"];\n}}\n'
    path = write(tmp_path, text, "long.dot")
    for statements in (False, True):
        row = dot.read_dot(spark, path, statements=statements).nodes.first()
        assert len(row.objs) == 60_000


def test_bad_dot(spark, tmp_path):
    node = '0 [label="{0 (I: 0, E: 0)||}"];\n'
    for text in ("", "digraph G {\n}\n", f"digraph G {{\n{node}{node}}}\n", 'digraph G {\n0 [label="{0 (I: 0, E: 0)|}"];\n}\n'):
        with pytest.raises((G.GraphError, PySparkException)):
            dot.read_dot(spark, write(tmp_path, text, "b.dot"))
    with pytest.raises(G.GraphError):
        dot.write_dot(dot.dot_lines(build_lattice(make_context(spark, [1], 1))).where("false"), str(tmp_path / "none"))


def graph(spark, nodes, edges):
    n = spark.createDataFrame(
        [(i, i, len(a), len(o), a, o, None) for i, a, o in nodes],
        "id string, label_id string, n_intent bigint, n_extent bigint, attrs array<string>, objs array<string>, color string",
    )
    return G.Graph(n, spark.createDataFrame(edges, "src string, dst string"))


DIAMOND = ([("t", [], ["x", "y"]), ("l", ["a"], ["x"]), ("r", ["b"], ["y"]), ("z", ["a", "b"], [])],
           [("z", "l"), ("z", "r"), ("l", "t"), ("r", "t")])


def test_compare_verdicts(spark):
    base = graph(spark, *DIAMOND)
    nodes, edges = DIAMOND
    other = graph(spark, [("9" + i, list(reversed(a)), o) for i, a, o in nodes], [("9" + s, "9" + t) for s, t in edges])
    same = C.compare_graphs(base, other)
    assert same.summary().first().equivalent
    rows = {r.left_id: (r.common, r.right_id) for r in same.correspondence().collect()}
    assert rows == {"t": ("C1", "9t"), "l": ("C2", "9l"), "r": ("C3", "9r"), "z": ("C4", "9z")}
    cut = C.compare_graphs(base, graph(spark, nodes, edges[1:]))
    assert not cut.summary().first().equivalent
    assert [tuple(r) for r in cut.edge_differences().collect()] == [("left", "z", "l")]
    changed = graph(spark, [("t", [], ["x", "q"]), *nodes[1:]], edges)
    diff = C.compare_graphs(base, changed)
    s = diff.summary().first()
    assert (s.only_left, s.only_right, s.equivalent) == (1, 1, False)
    assert diff.only_right().first().sig.objs == ["q", "x"]
    twin = graph(spark, [*nodes, ("l2", ["a"], ["x"])], edges)
    amb = C.compare_graphs(twin, twin)
    s = amb.summary().first()
    assert s.ambiguous and not s.equivalent and s.only_left == 0
    assert {r.id for r in amb.ambiguous().where("side = 'left'").collect()} == {"l", "l2"}
    assert [r.common for r in amb.correspondence().orderBy("common").collect()] == ["C1", "C3", "C4"]
    # commas in names do not run together
    a = graph(spark, [("1", ["a,b"], [])], [])
    b = graph(spark, [("1", ["a", "b"], [])], [])
    assert C.compare_graphs(a, b).summary().first().only_left == 1


def test_compare_refuses(spark):
    nodes, edges = DIAMOND
    with pytest.raises(G.GraphError):
        C.compare_graphs(graph(spark, nodes, [*edges, ("z", "nowhere")]), graph(spark, nodes, edges))
    wrong = graph(spark, nodes, edges)
    wrong = G.Graph(wrong.nodes.withColumn("n_intent", F.lit(5).cast("bigint")), wrong.edges)
    with pytest.raises(PySparkException):
        C.compare_graphs(wrong, wrong).summary().collect()


def test_graph_checks(spark):
    nodes, edges = DIAMOND
    own = graph(spark, [("t", [], []), ("l", ["a"], ["x"]), ("r", ["b"], ["y"]), ("z", [], [])], edges)
    sizes = spark.createDataFrame([(i, len(a), len(o)) for i, a, o in nodes], "id string, n_intent bigint, n_extent bigint")
    own = G.Graph(own.nodes.drop("n_intent", "n_extent").join(sizes, "id").select(*own.nodes.columns), own.edges)
    G.validate(G.expand(own))
    layers = {r.id: r.layer for r in G.topological_layers(own).collect()}
    assert layers == {"z": 0, "l": 1, "r": 1, "t": 2}
    with pytest.raises(G.GraphError, match="cycle"):
        G.expand(G.Graph(own.nodes, own.edges.union(spark.createDataFrame([("t", "z")], "src string, dst string"))))
    with pytest.raises(G.GraphError, match="unknown"):
        G.expand(G.Graph(own.nodes, own.edges.union(spark.createDataFrame([("t", "q")], "src string, dst string"))))
    lost = G.Graph(own.nodes, own.edges.where("src <> 'r'"))
    row = G.violations(G.expand(lost)).first()
    assert row.sources == 1 and row.sinks == 2 and row.bad_extents == 1
    misnamed = G.Graph(own.nodes.withColumn("label_id", F.lit("t")), own.edges)
    with pytest.raises(G.GraphError, match="bad_ids"):
        G.validate(G.expand(misnamed))


def test_long_chain_layers(spark):
    n = 23
    chain = graph(spark, [(f"{i}", [], []) for i in range(n)], [(f"{i}", f"{i + 1}") for i in range(n - 1)] + [("0", "5")])
    assert {int(r.id): r.layer for r in G.topological_layers(chain).collect()} == {i: i for i in range(n)}


def test_pairwise_and_groups(spark):
    nodes, edges = DIAMOND
    n, e = [], []
    for producer, cut in (("p", 0), ("q", 0), ("r", 1)):
        g = graph(spark, nodes, edges[cut:])
        tag = [F.lit("d").alias("dataset"), F.lit(producer).alias("producer")]
        n.append(g.nodes.select(*tag, "*"))
        e.append(g.edges.select(*tag, "*"))
    pairs = C.pairwise(n[0].union(n[1]).union(n[2]), e[0].union(e[1]).union(e[2]))
    assert {(r.left, r.right): r.equivalent for r in pairs.collect()} == {
        ("p", "q"): True, ("p", "r"): False, ("q", "r"): False
    }
    ok = n[0].union(n[1]).union(n[2]).select("dataset", "producer")
    assert C.equivalence_group_sizes(ok, pairs).first().n_equivalent == 2
    none = C.equivalence_group_sizes(ok.where("producer = 'r'"), pairs)
    assert none.first().n_equivalent == 1


def test_lenient_ids_over_many_splits(spark, tmp_path):
    from conceptloom.sources.context_csv import read_context

    lines = [";a;b"]
    for i in range(400):
        lines.append(f"o{i};{i % 2};1")
        if i % 3 == 0:
            lines.append(";;")
    path = tmp_path / "many.csv"
    path.write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = read_context(spark, str(path), mode="lenient").objects.select("obj_id", "name").orderBy("obj_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r.obj_id, r.name) for r in got] == [(i, f"o{i}") for i in range(400)]
