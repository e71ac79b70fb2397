"""Lattice graphs as Graphviz DOT text, in and out."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptloom.functions.text import escape_label, sort_caseless
from conceptloom.operators import labels as L
from conceptloom.operators.graph import FullLabels, Graph, GraphError
from conceptloom.operators.lattice import Lattice
from conceptloom.scratch import Scratch
from conceptloom.sources.dot_splitter import pieces, split_pieces
from conceptloom.sources.files import listing

# Nodes with more objects than this are written one object per line, with DOT's
# backslash continuation, so that no label is ever put together in one row.
WRAP = 10_000
# Files up to this many bytes may be read as one text; larger ones line by line.
WHOLE_FILE = 64 << 20
# Up to this many lines a graph is written as one file.
ONE_FILE = 1_000_000

# -- writing -------------------------------------------------------------------


def label_text(id_: Column, n_intent: Column, n_extent: Column, attrs: Column, objs: Column) -> Column:
    """``{id (I: i, E: e)|attribute lines|object lines}``, every item ended by \\n."""
    return F.concat(
        F.format_string("{%s (I: %d, E: %d)|", id_.cast("string"), n_intent, n_extent),
        _lines(attrs), F.lit("|"), _lines(objs), F.lit("}"),
    )


def _lines(items: Column) -> Column:
    ended = F.transform(items, lambda s: F.concat(escape_label(s), F.lit("\\n")))
    return F.array_join(ended, "")


STYLE = "shape=record,style=filled"


def node_head(id_: Column, color: Column, style: Column | None = None) -> Column:
    fill = F.coalesce(F.concat(F.lit(",fillcolor="), color), F.lit(""))
    style = F.lit(STYLE) if style is None else F.coalesce(F.nullif(style, F.lit("")), F.lit(STYLE))
    return F.concat(_identifier(id_.cast("string")), F.lit(" ["), style, fill, F.lit(',label="'))


def _identifier(c: Column) -> Column:
    """Quoted unless it is a plain name or number."""
    return F.when(c.rlike(r"^[A-Za-z0-9_.\-]+$"), c).otherwise(F.concat(F.lit('"'), escape_label(c), F.lit('"')))


# Rows of DOT text: sorted by all columns but ``line`` they are the file.  Nodes
# and edges sort by number, then by text for names that are no numbers.
SORT = ("section", "number", "text", "number2", "text2", "part", "seq", "seq2")


def _rows(df: DataFrame, section: int, line: Column, part: int = 0, **sort: Column) -> DataFrame:
    types = {"number": "bigint", "number2": "bigint", "text": "string", "text2": "string", "seq2": "string"}
    seq = sort.get("seq", F.lit(None))
    named = {c: sort.get(c, F.lit(None)).cast(t) for c, t in types.items()}
    named |= {"section": F.lit(section), "part": F.lit(part), "seq": seq}
    return df.select(*[named[c].alias(c) for c in SORT], line.alias("line"))


def _frame(spark: SparkSession, name: str = "G") -> list[DataFrame]:
    one = spark.range(1)
    return [_rows(one, 0, F.lit(f"digraph {name} {{ \n\trankdir=BT;")), _rows(one, 3, F.lit("}"))]


def _node_rows(nodes: DataFrame, items: DataFrame, sort: dict[str, Column], wrap: int) -> list[DataFrame]:
    """Node lines.  ``nodes``: ``id``, ``color``, ``n_i``, ``n_e``, ``shown`` (array of
    attributes), ``n_shown`` (number of objects).  ``items``: ``id``, ``seq``,
    ``seq2``, ``name``; a node of more than ``wrap`` items gets one row for each."""
    id_ = F.col("id")
    short, long = nodes.where(F.col("n_shown") <= wrap), nodes.where(F.col("n_shown") > wrap)
    wrapped = bool(long.limit(1).count())
    listed = (
        (items.join(long.select("id"), "id", "left_anti") if wrapped else items)
        .groupBy("id")  # at most `wrap` items each
        .agg(F.array_sort(F.collect_list(F.struct("seq", "seq2", "name"))).alias("o"))
        .select("id", F.col("o.name").alias("objs"))
    )
    objs = F.coalesce("objs", F.array().cast("array<string>"))
    shown_id = escape_label(id_.cast("string"))
    label = label_text(shown_id, F.col("n_i"), F.col("n_e"), F.col("shown"), objs)
    head = node_head(id_, F.col("color"), F.col("style") if "style" in nodes.columns else None)
    out = [_rows(short.join(listed, "id", "left"), 1, F.concat(head, label, F.lit('"];')), **sort)]
    if wrapped:
        start = F.concat(
            head, F.format_string("{%s (I: %d, E: %d)|", shown_id, F.col("n_i"), F.col("n_e")),
            _lines(F.col("shown")), F.lit("|\\"),
        )
        each = items.join(long.select("id"), "id", "left_semi")
        line = F.concat(escape_label(F.col("name")), F.lit("\\n\\"))
        out += [
            _rows(long, 1, start, **sort),
            _rows(each, 1, line, 1, **sort, seq=F.col("seq"), seq2=F.col("seq2")),
            _rows(long, 1, F.lit('}"];'), 2, **sort),
        ]
    return out


def dot_lines(
    lattice: Lattice, labels: str = "reduced", order: str = "intent", color_by: str = "own",
    wrap: int = WRAP,
) -> DataFrame:
    """The DOT text of a lattice as rows, concepts numbered in ``order``."""
    if labels not in ("reduced", "full"):
        raise ValueError(f"unknown labels {labels!r}")
    context = lattice.context
    scratch = Scratch(context.spark, "dot")
    ids = scratch.save(lattice.with_ids(order), "ids")
    nodes = scratch.save(L.labelled_concepts(lattice, ids, color_by), "labelled")
    if labels == "full":
        shown, n_shown, items = lattice.intent_names(), F.col("n_extent"), L.extents(lattice, ids)
    else:
        shown, n_shown, items = F.col("own_attrs"), F.col("n_own"), L.own_objects_with_ids(lattice, ids)
    nodes = nodes.select(
        "id", "color", F.col("n_intent").alias("n_i"), F.col("n_extent").alias("n_e"),
        shown.alias("shown"), n_shown.alias("n_shown"),
    )
    items = items.select("id", F.col("obj_id").alias("seq"), F.lit("").alias("seq2"), "name")
    edges = _rows(
        lattice.cover_ids(ids), 2, F.concat(F.lit("\t"), F.col("child_id"), F.lit(" -> "), F.col("parent_id")),
        number=F.col("child_id"), number2=F.col("parent_id"),
    )
    parts = [*_node_rows(nodes, items, {"number": F.col("id")}, wrap), edges, *_frame(context.spark)]
    return reduce(DataFrame.unionByName, parts)


def expanded_lines(full: FullLabels, name: str = "G", wrap: int = WRAP) -> DataFrame:
    """The DOT text of an expanded graph as rows: nodes in numeric then text order,
    items in case-blind order."""
    spark = full.graph.nodes.sparkSession
    style = F.lit(STYLE)
    if "options" in full.graph.nodes.columns:
        option = lambda e: F.concat(e["key"], F.lit("="), _identifier(e["value"]))
        style = F.array_join(F.transform(F.map_entries("options"), option), ",")
    names = full.intents.groupBy("id").agg(F.collect_list("item").alias("a"))  # attributes: bounded
    nodes = full.graph.nodes.join(names, "id", "left").select(
        "id", "color", F.col("n_intent").alias("n_i"), F.col("n_extent").alias("n_e"),
        F.coalesce(sort_caseless(F.col("a")), F.array().cast("array<string>")).alias("shown"),
        F.col("n_extent").alias("n_shown"), style.alias("style"),
    )
    items = full.extents.select("id", F.lower("item").alias("seq"), F.col("item").alias("seq2"), F.col("item").alias("name"))
    number = lambda c: F.coalesce(F.col(c).try_cast("bigint"), F.lit((1 << 63) - 1))
    edges = _rows(
        full.graph.edges.distinct(), 2, F.concat(F.lit("\t"), _identifier(F.col("src")), F.lit(" -> "), _identifier(F.col("dst"))),
        number=number("src"), text=F.col("src"), number2=number("dst"), text2=F.col("dst"),
    )
    sort = {"number": number("id"), "text": F.col("id")}
    parts = [*_node_rows(nodes, items, sort, wrap), edges, *_frame(spark, name)]
    return reduce(DataFrame.unionByName, parts)


def write_dot(lines: DataFrame, path: str) -> int:
    """Write DOT rows in order; returns the number of rows.

    One part file up to ``ONE_FILE`` rows, else part files whose concatenation in
    name order is the graph.  Nothing written counts as a failure.
    """
    saved = Scratch(lines.sparkSession, "lines").save(lines, "lines")
    n = saved.count()
    if not n:
        raise GraphError("nothing to write")
    ordered = saved.repartition(1).sortWithinPartitions(*SORT) if n <= ONE_FILE else saved.orderBy(*SORT)
    ordered.select("line").write.mode("errorifexists").text(path)
    return n


# -- reading -------------------------------------------------------------------

# The patterns repeat plain character classes only: labels may be megabytes long.
_ID = r'("[^"]*"|[A-Za-z0-9_.\-]+)'
_NODE = rf'(?s)^\s*{_ID}\s*\[(.*)\]\s*;?\s*$'
_EDGE = rf'^\s*{_ID}\s*->\s*{_ID}\s*(?:\[[^\]]*\])?\s*;?\s*$'
_LABEL = r'(?<![A-Za-z_])label\s*=\s*(?:"([^"]*)"|([^\s",\]]+))'
_COUNTS = r'^\s*(.*?)\s*\(I:\s*(\d+)\s*,\s*E:\s*(\d+)\s*\)\s*$'
# Escaped characters stand aside as private-use characters while a text is cut,
# and so do the cutting characters inside quotes.
_ASIDE = [("\\\\", "\ue000"), ("\\|", "\ue001"), ('\\"', "\ue002"), ("\\{", "\ue003"),
          ("\\}", "\ue004"), ("\\<", "\ue005"), ("\\>", "\ue006")]
_QUOTED = [(";", "\ue010"), ("[", "\ue011"), ("]", "\ue012"), ("{", "\ue013"), ("}", "\ue014"), ("\n", "\ue015")]


def _swap(c: Column, pairs) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def _back(pairs):
    return [(new, old) for old, new in pairs]


def read_dot(
    spark: SparkSession, path: str, statements: bool = False, loose_breaks: bool = False, free: bool = False, long: bool = False
) -> Graph:
    """Read a labelled lattice.

    By default one node or edge per line, as the writer lays them out; the file is
    split among tasks.  ``free`` accepts any layout, continuation lines included, in
    files of any size, and splits them too.  ``statements`` does so with each small
    file as one text.  ``loose_breaks`` also takes ``\\\\n`` (escaped twice) and ``\\l``
    as line breaks.  ``long`` is ``free`` with the objects of labels of very many lines in ``Graph.more`` instead of
    ``objs``, so that no row holds them.
    """
    prepare = lambda c: _swap(_loosen(c, loose_breaks), _ASIDE)
    apart = rest = None
    if free or long:
        whole, apart, rest = split_pieces(spark, path, prepare) if long else (pieces(spark, path, prepare), None, None)
        lines = whole.select(F.explode(_statements(F.col("value"))).alias("value")).where(F.trim("value") != "")
    elif statements:
        largest = listing(spark, path, recursive=False).agg(F.max("length").alias("n")).first().n
        if (largest or 0) > WHOLE_FILE:
            raise GraphError(f"a file of {largest} bytes is too large to be read as one text")
        text = spark.read.text(path, wholetext=True)
        joined = F.regexp_replace(F.regexp_replace("value", r"\\\r?\n", ""), r"\r\n?", "\n")
        found = _statements(_swap(_loosen(joined, loose_breaks), _ASIDE))
        lines = text.select(F.explode(found).alias("value")).where(F.trim("value") != "")
    else:
        lines = spark.read.text(path).select(_swap(_loosen(F.col("value"), loose_breaks), _ASIDE).alias("value"))
        known = (
            F.col("value").rlike(_EDGE) | F.col("value").rlike(_NODE) | (F.trim("value") == "")
            | F.col("value").rlike(r"^\s*(strict\s+)?digraph\b.*\{\s*$")
            | F.col("value").rlike(r"^\s*\}\s*$") | F.col("value").rlike(r"^\s*[A-Za-z]+\s*=\s*[^\[\]]*;?\s*$")
        )
        odd = lines.where(~known).first()
        if odd is not None:
            raise GraphError(f"not one statement per line, read with statements=True: {odd.value[:80]!r}")
    is_edge = F.col("value").rlike(_EDGE)
    edges = lines.where(is_edge).select(
        _plain(F.regexp_extract("value", _EDGE, 1)).alias("src"),
        _plain(F.regexp_extract("value", _EDGE, 2)).alias("dst"),
    ).distinct()
    nodes, more = _nodes(lines.where(~is_edge)), None
    if apart is not None:
        heads = _nodes(apart, "folder", "piece")
        nodes = nodes.unionByName(heads.drop("folder", "piece"))
        ids = F.broadcast(heads.select("folder", "piece", "id"))  # one for LONG lines at least
        each = rest.join(ids, ["folder", "piece"]).select("id", F.explode(F.split("value", r"\\[nl]")).alias("item"))
        item = _swap(F.trim("item"), [(mark, escaped[1]) for escaped, mark in _ASIDE])
        more = Scratch(spark, "dot").save(each.select("id", item.alias("item")).where("item <> ''"), "more")
    graph = replace(Graph(nodes, edges).saved("dot"), more=more)
    total = graph.nodes.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("d")).first()
    if not total.n:
        raise GraphError("no node with a concept label")
    if total.n != total.d:
        raise GraphError("a node is defined twice")
    return graph


def _statements(text: Column) -> Column:
    """The statements of a text whose escaped characters stand aside."""
    # every second piece between quotes is inside them
    quoted = F.transform(F.split(text, '"'), lambda t, i: F.when(i % 2 == 1, _swap(t, _QUOTED)).otherwise(t))
    statement = r"([^;\n\[{}]*\[[^\]]*\]|[^;\n\[{}]+)"
    return F.regexp_extract_all(F.array_join(quoted, '"'), F.lit(statement), F.lit(1))


def _loosen(c: Column, loose: bool) -> Column:
    return F.regexp_replace(c, r"\\+([nl])", r"\\$1") if loose else c


def _plain(c: Column) -> Column:
    """An identifier without its quotes."""
    t = F.trim(c)
    bare = F.when(t.startswith('"'), F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t)
    return _swap(_swap(bare, _back(_QUOTED)), [(mark, escaped[1]) for escaped, mark in _ASIDE])


def _nodes(lines: DataFrame, *keys: str) -> DataFrame:
    block = F.regexp_extract("value", _NODE, 2)
    found = lines.select(
        *keys, _plain(F.regexp_extract("value", _NODE, 1)).alias("id"),
        _swap(F.concat(F.regexp_extract(block, _LABEL, 1), F.regexp_extract(block, _LABEL, 2)), _back(_QUOTED)).alias("label"),
        _options(block).alias("options"),
    ).where((F.col("id") != "") & F.col("label").contains("(I:"))
    text = F.regexp_replace(F.trim("label"), r"\\[nl]|\r\n?", "\n")
    text = F.when(
        text.startswith("{") & text.endswith("}"), F.substring(text, F.lit(2), F.length(text) - 2)
    ).otherwise(text)
    cut = found.withColumn("f", F.split(text, r"\|"))
    bad = F.raise_error(F.concat(F.lit("label without exactly three fields at node "), F.col("id")))
    cut = cut.withColumn("head", F.when(F.size("f") == 3, F.col("f")[0]).otherwise(bad.cast("string")))
    return cut.select(
        *keys, "id",
        _swap(F.regexp_extract("head", _COUNTS, 1), [(m, e[1]) for e, m in _ASIDE]).alias("label_id"),
        F.regexp_extract("head", _COUNTS, 2).try_cast("bigint").alias("n_intent"),
        F.regexp_extract("head", _COUNTS, 3).try_cast("bigint").alias("n_extent"),
        _items(F.col("f")[1]).alias("attrs"),
        _items(F.col("f")[2]).alias("objs"),
        F.col("options").getItem("fillcolor").alias("color"),
        F.map_filter("options", lambda k, v: k != "fillcolor").alias("options"),
    )


def _options(block: Column) -> Column:
    """The attributes of a node but for its label, as a map."""
    pair = r'([A-Za-z_]+)\s*=\s*("[^"]*"|[^,\s"]+)'
    keys = F.regexp_extract_all(block, F.lit(pair), F.lit(1))
    values = F.transform(F.regexp_extract_all(block, F.lit(pair), F.lit(2)), _plain)
    entries = F.filter(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda e: e["k"] != "label")
    # the first of two equal keys counts
    first = F.filter(entries, lambda e, i: F.array_position(F.transform(entries, lambda x: x["k"]), e["k"]) == i + 1)
    return F.map_from_entries(first)


def _items(field: Column) -> Column:
    marks = [(mark, escaped[1]) for escaped, mark in _ASIDE]
    cut = F.transform(F.split(field, "\n"), lambda s: _swap(F.trim(s), marks))
    return F.array_distinct(F.filter(cut, lambda s: s != ""))
