import random

import pytest
from conftest import ANIMALS_SIZE, brute_concepts, brute_covers, got_concepts, got_covers, make_context
from pyspark.sql import functions as F

from conceptloom.operators import enumerate as E
from conceptloom.operators import joins
from conceptloom.operators.context import from_pairs
from conceptloom.operators.enumerate import LatticeTooLarge, build_lattice
from conceptloom.operators.validate import lattice_violations
from conceptloom.sources.context_csv import read_context

METHODS = ("subtree", "join")


def cases():
    rng = random.Random(7)
    yield [], 3
    yield [], 0
    yield [0, 0], 0
    yield [0], 3
    yield [7, 7], 3
    yield [0, 7, 7, 1], 3
    yield [1, 2, 4], 3
    for density in (0.1, 0.3, 0.5, 0.9):
        n, g = rng.randint(2, 7), rng.randint(2, 9)
        yield [sum((rng.random() < density) << j for j in range(n)) for _ in range(g)], n


@pytest.mark.parametrize("rows,n", list(cases()))
def test_both_methods_equal_brute_force(spark, rows, n):
    want = brute_concepts(rows, n)
    context = make_context(spark, rows, n)
    for method in METHODS:
        lattice = build_lattice(context, method)
        assert got_concepts(lattice) == want, method
        assert lattice.n_concepts == lattice.nodes.count() == len(want)
        covers = got_covers(lattice)
        assert len(covers) == len(set(covers))
        assert set(covers) == brute_covers(want), method


def test_wide_context_equals_narrow_one(spark):
    """The same sets spread over attributes 0..129 give the same lattice."""
    rng = random.Random(3)
    spots = [0, 5, 61, 62, 63, 64, 100, 125, 126, 129]
    rows = [sum((rng.random() < 0.5) << j for j in range(10)) for _ in range(12)]
    spread = [sum(1 << spots[j] for j in range(10) if r >> j & 1) for r in rows]
    full = (1 << 130) - 1
    want = {}
    for intent, extent in brute_concepts(rows, 10).items():
        moved = sum(1 << spots[j] for j in range(10) if intent >> j & 1)
        want[full if extent == 0 else moved] = extent
    context = make_context(spark, spread, 130)
    for method in METHODS:
        lattice = build_lattice(context, method)
        assert got_concepts(lattice) == want, method
        assert set(got_covers(lattice)) == brute_covers(want), method


def test_example_sizes(spark, animals_file):
    context = read_context(spark, animals_file)
    for method in METHODS:
        lattice = build_lattice(context, method)
        assert (lattice.n_concepts, lattice.covers().count()) == ANIMALS_SIZE


def test_handing_back_the_frontier_changes_nothing(spark, monkeypatch):
    rng = random.Random(5)
    rows = [rng.getrandbits(9) for _ in range(14)]
    want = brute_concepts(rows, 9)
    monkeypatch.setattr(E, "FIRST_SHARE", 3)
    monkeypatch.setattr(E, "SHARE", 5)
    monkeypatch.setattr(E, "CHUNK_CELLS", 200)
    lattice = build_lattice(make_context(spark, rows, 9), "subtree")
    assert got_concepts(lattice) == want
    assert set(got_covers(lattice)) == brute_covers(want)


def test_many_rows_take_the_join_way_without_broadcast(spark, monkeypatch):
    rng = random.Random(6)
    rows = [rng.getrandbits(7) for _ in range(20)]
    monkeypatch.setattr(E, "SUBTREE_BYTES", 0)
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    want = brute_concepts(rows, 7)
    lattice = build_lattice(make_context(spark, rows, 7))
    assert got_concepts(lattice) == want
    assert set(got_covers(lattice)) == brute_covers(want)


def test_limit_fails_loudly(spark):
    context = make_context(spark, [1, 2, 4, 8], 4)
    for method in METHODS:
        with pytest.raises(LatticeTooLarge):
            build_lattice(context, method, max_concepts=3)
        assert build_lattice(context, method, max_concepts=6).n_concepts == 6


def test_checks_are_zero(spark):
    rng = random.Random(8)
    lattice = build_lattice(make_context(spark, [rng.getrandbits(8) for _ in range(15)], 8))
    assert set(lattice_violations(lattice).first()) == {0}
    broken = type(lattice)(lattice.context, lattice.nodes.withColumn("i0", F.col("i0").bitwiseXOR(1)), 0)
    assert lattice_violations(broken).first().not_closed > 0


def test_checks_find_a_cover_that_skips_a_level(spark):
    lattice = build_lattice(make_context(spark, [1, 3, 7], 3))
    far = F.struct(F.lit(7).cast("bigint").alias("i0"))
    nodes = lattice.nodes.withColumn("lower", F.when(F.col("i0") == 1, F.array_append("lower", far)).otherwise(F.col("lower")))
    found = lattice_violations(type(lattice)(lattice.context, nodes, 3)).first()
    assert found.skipped_level == 1 and found.wrong_direction == found.not_closed == 0


def test_checks_find_a_cover_that_skips_two_levels(spark):
    lattice = build_lattice(make_context(spark, [1, 3, 7, 15], 4))
    far = F.struct(F.lit(15).cast("bigint").alias("i0"))
    nodes = lattice.nodes.withColumn("lower", F.when(F.col("i0") == 1, F.array_append("lower", far)).otherwise(F.col("lower")))
    found = lattice_violations(type(lattice)(lattice.context, nodes, 4)).first()
    assert found.skipped_level == 1 and found.wrong_direction == found.not_closed == 0


def test_subtree_refuses_rows_too_large_for_every_task(spark, monkeypatch):
    monkeypatch.setattr(E, "SUBTREE_BYTES", 10)
    context = make_context(spark, [1, 2, 4], 3)
    with pytest.raises(ValueError, match="join"):
        build_lattice(context, "subtree")
    assert build_lattice(context).n_concepts == 5


def test_hot_row_and_hot_object(spark):
    """A third of all objects share one row; one object holds a third of all pairs."""
    pairs = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("g"),
        F.concat(F.lit("m"), F.when(F.col("id") % 3 == 1, 1).otherwise(F.col("id") % 7)).alias("m"),
    )
    context = from_pairs(pairs, "g", "m")
    sets = {}
    for r in pairs.collect():
        sets.setdefault(r.g, set()).add(r.m)
    rows = [sum(1 << context.attributes.index(m) for m in s) for s in sets.values()]
    assert got_concepts(build_lattice(context)) == brute_concepts(rows, len(context.attributes))


def test_orders_number_all_concepts(spark, monkeypatch):
    from conceptloom.operators import ordering

    rng = random.Random(9)
    lattice = build_lattice(make_context(spark, [rng.getrandbits(6) for _ in range(10)], 6))
    intents = set(got_concepts(lattice))
    keys = {
        "intent": lambda i: (i.bit_count(), i),
        "intent_desc": lambda i: (-i.bit_count(), f"{i:016x}"),
        "members": lambda i: (-i.bit_count(), [j for j in range(6) if i >> j & 1]),
        "names": lambda i: (i.bit_count(), [f"a{j}" for j in range(6) if i >> j & 1]),
        "lectic": lambda i: [i >> j & 1 for j in range(6)],
    }
    for small in (100_000, 0):  # one window, or range sort with offsets
        monkeypatch.setattr(ordering, "SMALL", small)
        for order, key in keys.items():
            rows = sorted(lattice.with_ids(order).collect(), key=lambda r: r.id)
            assert [r.id for r in rows] == list(range(len(intents)))
            assert [r.i0 for r in rows] == sorted(intents, key=key), order


def test_dual_context_has_the_dual_lattice(spark):
    rng = random.Random(10)
    rows = [rng.getrandbits(5) for _ in range(6)]
    turned = [sum((rows[g] >> m & 1) << g for g in range(6)) for m in range(5)]
    a = build_lattice(make_context(spark, rows, 5))
    b = build_lattice(make_context(spark, turned, 6))
    assert sorted((r.n_intent, r.n_extent) for r in a.concepts().collect()) == sorted(
        (r.n_extent, r.n_intent) for r in b.concepts().collect()
    )
    assert a.covers().count() == b.covers().count()
