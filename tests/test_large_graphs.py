"""Queries over lattice graphs with many objects: what the driver and a single row have to hold."""

import pytest
from conftest import make_context
from pyspark.sql import functions as F

from conceptloom.operators.compare import digests, long_sets
from conceptloom.operators.context import from_masks
from conceptloom.operators.enumerate import build_lattice
from conceptloom.plans.catalog import ENTRIES
from conceptloom.sources import dot, dot_splitter


@pytest.fixture(scope="module")
def small_tables(spark, tmp_path_factory):
    """Three nations, and customers with some of three priorities."""
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, f"N{i}") for i in range(3)], "n_nationkey int, n_name string").write.parquet(f"{d}/nation.parquet")
    customers = spark.range(60).select(F.col("id").alias("c_custkey"), (F.col("id") % 3).cast("int").alias("c_nationkey"))
    customers.write.parquet(f"{d}/customer.parquet")
    orders = spark.range(240).select(
        F.col("id").alias("o_orderkey"), (F.col("id") * 7 % 60).alias("o_custkey"),
        F.concat(F.lit("P"), (F.col("id") * F.col("id") + F.col("id") % 5) % 3).alias("o_orderpriority"), F.lit("F").alias("o_orderstatus"),
    )
    orders.write.parquet(f"{d}/orders.parquet")
    return d


def test_cases_are_worked_out_one_after_the_other(spark, small_tables):
    """The driver doesn't plan the checks of all graphs in one query."""
    found = ENTRIES["normalize_cases"].run(spark, small_tables)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 5
    status = {(r.dataset_id, r.algorithm_id): r.status for r in found.collect()}
    assert status["nation", "whole"] == status["cust_prio", "whole"] == "OK"
    assert status["absent", "whole"] == status["absent", "cut"] == "MISSING_RAW_DOT"
    assert len(status) == 6


def read_both(spark, path, monkeypatch, lines):
    monkeypatch.setattr(dot_splitter, "LONG", lines)
    return dot.read_dot(spark, path, free=True), dot.read_dot(spark, path, long=True)


def test_long_labels_stay_apart_and_keep_their_digest(spark, tmp_path, monkeypatch):
    """Objects of a label of many lines come to no row; the digest is that of the whole label."""
    rows = [i % 4 for i in range(40)]
    context = make_context(spark, rows, 2)
    odd = F.when(F.col("obj_id") % 5 == 0, F.concat(F.lit('a|b\\"{ \\n;'), "name")).otherwise(F.col("name"))
    context = from_masks(context.objects.withColumn("name", odd), context.attributes)
    path = f"{tmp_path}/dot"
    dot.write_dot(dot.dot_lines(build_lattice(context), "full", wrap=15), path)
    whole, split = read_both(spark, path, monkeypatch, 16)
    assert {len(r.objs) for r in whole.nodes.collect()} == {40, 20, 10}
    assert sorted(len(r.objs) for r in split.nodes.collect()) == [0, 0, 0, 10]
    assert whole.more is None and split.more.count() == 80
    assert sorted(split.edges.collect()) == sorted(whole.edges.collect())
    plain = {r.id: r.sig for r in digests(whole.nodes).collect()}
    sized = split.nodes.join(long_sets(split), "id", "left")
    assert {r.id: r.sig for r in digests(sized).collect()} == plain


def test_long_pieces_of_another_layout_come_together(spark, tmp_path, monkeypatch):
    """Real line breaks, two items a line, a quoted option before the label, two statements in a piece; repeated items."""
    label = 'label="{%s (I: 0, E: 4)||\\\na\\n\\\nb\\nc\\n\\\nb\\n\\\nd\\n}"'
    text = [
        "digraph G {", "1 [shape=record," + label % 1 + "];", '2 [color="x",' + label % 2 + "];",
        '3 [label="{3 (I: 0, E: 2)||', "a", "b", "", "", '}"];', "x=1; 4 [" + label % 4 + "];", "2 -> 1;", "}",
    ]
    (tmp_path / "g.dot").write_text("\n".join(text))
    whole, split = read_both(spark, str(tmp_path / "g.dot"), monkeypatch, 3)
    assert sorted(whole.nodes.drop("options").collect()) != []
    assert {r.id for r in split.nodes.collect()} == {r.id for r in whole.nodes.collect()} == {"1", "2", "3", "4"}
    assert {r.id for r in split.more.collect()} == {"1"}
    plain = {r.id: r.sig for r in digests(whole.nodes).collect()}
    assert {r.id: r.sig for r in digests(split.nodes.join(long_sets(split), "id", "left")).collect()} == plain


def test_pairwise_reads_long_labels_apart(spark, small_tables, monkeypatch):
    monkeypatch.setattr(dot, "WRAP", 5)
    monkeypatch.setattr(dot.dot_lines, "__defaults__", (*dot.dot_lines.__defaults__[:-1], 5))
    monkeypatch.setattr(dot_splitter, "LONG", 6)
    same = {(r.dataset, r.left, r.right): r.equivalent for r in ENTRIES["pairwise_matrix"].run(spark, small_tables).collect()}
    assert same["cust_prio", "join", "subtree"] and same["nation", "join", "subtree"]
    assert not same["cust_prio", "broken", "join"] and not same["cust_prio", "broken", "subtree"]
    assert len(same) == 6
