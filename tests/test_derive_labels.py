import random

import pytest
from conftest import brute_concepts, make_context
from pyspark.sql import functions as F

from conceptloom.functions import masks as M
from conceptloom.operators import derive as D
from conceptloom.operators import joins
from conceptloom.operators import labels as L
from conceptloom.operators.enumerate import build_lattice

RNG = random.Random(2)
ROWS = [RNG.getrandbits(6) for _ in range(12)] + [0, 0]
FULL = 63


def close(x):
    out = FULL
    for r in ROWS:
        if r & x == x:
            out &= r
    return out


def test_derivations_and_empty_sets(spark):
    c = make_context(spark, ROWS, 6)
    assert D.objects_having(c, []).count() == len(ROWS)
    got = {r.obj_id for r in D.objects_having(c, ["a0", "a3"]).collect()}
    assert got == {i for i, r in enumerate(ROWS) if r & 9 == 9}
    assert {r.obj_id for r in D.with_attributes(c, ["a0", "a3"]).collect()} == got
    assert D.common_attributes(c, c.objects.where("false")).first().m0 == FULL
    assert D.common_attributes(c, c.objects.where("obj_id in (0, 1)")).first().m0 == ROWS[0] & ROWS[1]
    one = D.closure(c, ["a1"]).first()
    assert (one.m0, one.n_extent) == (close(2), sum(r & 2 == 2 for r in ROWS))


@pytest.mark.parametrize("broadcast", [True, False])
def test_closures_of_all_sets(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    c = make_context(spark, ROWS, 6)
    queries = spark.range(64).select(F.col("id").alias("q0"))
    got = {r.q0: (r.d0, r.n_extent) for r in D.closures(c, queries).collect()}
    assert got == {x: (close(x), sum(r & x == x for r in ROWS)) for x in range(64)}
    pairs = {(r.a, r.b): r.d0 for r in D.pair_closures(c).collect()}
    assert pairs == {(a, b): close(1 << a | 1 << b) for a in range(6) for b in range(a + 1, 6)}
    attrs = {r.attr_id: r.i0 for r in D.attribute_concepts(c).collect()}
    assert attrs == {j: close(1 << j) for j in range(6)}


def test_wide_closures(spark):
    spots = [1, 62, 63, 64, 99, 126]
    move = lambda m: sum(1 << spots[j] for j in range(6) if m >> j & 1)
    c = make_context(spark, [move(r) for r in ROWS], 127)
    data = [(x, *M.split_int(move(x), 3)) for x in range(64)]
    queries = spark.createDataFrame(data, "x int, q0 bigint, q1 bigint, q2 bigint")
    for r in D.closures(c, queries).collect():
        want = move(close(r.x)) if any(o & r.x == r.x for o in ROWS) else (1 << 127) - 1
        assert M.join_int([r.d0, r.d1, r.d2]) == want


def test_support_and_stats(spark):
    c = make_context(spark, ROWS, 6)
    got = {r.attr_id: r.n_objects for r in c.support().collect()}
    assert got == {j: sum(r >> j & 1 for r in ROWS) for j in range(6)}
    s = c.stats().first()
    assert (s.n_objects, s.n_attributes, s.n_incidences) == (len(ROWS), 6, sum(r.bit_count() for r in ROWS))
    assert s.n_distinct_rows == len(set(ROWS))
    assert c.incidence().count() == s.n_incidences
    nothing = make_context(spark, [], 2).stats().first()
    assert (nothing.n_objects, nothing.density) == (0, 0.0)


def test_contexts_from_columns_and_pairs(spark, monkeypatch):
    from conceptloom.operators import context as K

    data = [(1, "x", 5), (2, None, 6), (3, "y:z", None), (4, None, None)]
    df = spark.createDataFrame(data, "id int, t string, n int")
    want = {1: ["n:5", "t:x"], 2: ["n:6"], 3: ["t:y:z"], 4: []}
    for limit in (256, 1):
        monkeypatch.setattr(K, "MAX_LOOKUP", limit)
        c = K.from_columns(df, "id", {"t": "t", "n": "n"})
        assert c.attributes == ("n:5", "n:6", "t:x", "t:y:z")
        rows = c.objects.select("obj_id", M.to_names(c.words(), c.attributes).alias("a")).collect()
        assert {r.obj_id: r.a for r in rows} == want
    monkeypatch.setattr(K, "MAX_ATTRIBUTES", 1)
    with pytest.raises(ValueError, match="more than 1"):
        K.from_columns(df, "id", {"t": "t", "n": "n"})


def test_contexts_lose_no_pair(spark):
    from conceptloom.operators import context as K

    pairs = spark.createDataFrame([(1, "a"), (2, "b"), (9, "b")], "g int, m string")
    objects = spark.createDataFrame([(1, "one"), (2, None), (3, "three")], "g int, label string")
    c = K.from_pairs(pairs, "g", "m", objects=objects, name="label")
    rows = c.objects.select("obj_id", "name", M.to_names(c.words(), c.attributes).alias("a")).collect()
    assert {r.obj_id: (r.name, r.a) for r in rows} == {1: ("one", ["a"]), 2: (None, ["b"]), 3: ("three", []), 9: ("9", ["b"])}
    for others in (None, objects):
        with pytest.raises(Exception, match="isn't listed: b"):
            K.from_pairs(pairs, "g", "m", objects=others, attributes=["a"]).objects.collect()
    for n in (2, 300):  # repeated keys, few and many values
        df = spark.createDataFrame([(i % (n // 2), f"v{i}") for i in range(n)] + [(None, "v0"), (None, "v1")], "id int, t string")
        c = K.from_columns(df, "id", {"t": "t"})
        rows = c.objects.select("obj_id", M.to_names(c.words(), c.attributes).alias("a")).collect()
        assert len(rows) == n // 2 + 2
        assert all(sorted(r.a) == sorted({f"t:v{r.obj_id}", f"t:v{r.obj_id + n // 2}"}) for r in rows if r.obj_id is not None)


def test_own_labels_two_ways(spark):
    lattice = build_lattice(make_context(spark, ROWS, 6))
    mu = {}
    for j in range(6):
        mu.setdefault(close(1 << j), []).append(f"a{j}")
    rows = L.labelled_concepts(lattice, lattice.with_ids()).collect()
    assert {r.i0: r.own_attrs for r in rows if r.own_attrs} == mu
    assert {r.i0: r.n_own for r in rows} == {i: ROWS.count(i) for i in brute_concepts(ROWS, 6)}
    want = {0: "lightblue", 1: None}
    assert all(r.color == want.get(r.n_own, "orange") for r in rows)
    by_extent = L.labelled_concepts(lattice, lattice.with_ids(), "extent").collect()
    assert all(r.color == want.get(r.n_extent, "orange") for r in by_extent)
    difference = {r.i0: r.own_attrs for r in L.own_attributes_by_difference(lattice).collect()}
    assert difference == {r.i0: r.own_attrs for r in rows}
    counts = {r.i0: r.n_own for r in L.own_object_counts(lattice).collect()}
    assert counts == {r.i0: r.n_own for r in rows}


@pytest.mark.parametrize("broadcast", [True, False])
def test_extents(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    lattice = build_lattice(make_context(spark, ROWS, 6))
    ids = lattice.with_ids()
    intent = {r.id: r.i0 for r in ids.collect()}
    got = {(r.id, r.obj_id) for r in L.extents(lattice, ids).collect()}
    assert got == {(c, g) for c, i in intent.items() for g, r in enumerate(ROWS) if r & i == i}
    own = {(r.id, r.obj_id) for r in L.own_objects_with_ids(lattice, ids).collect()}
    assert own == {(c, g) for c, i in intent.items() for g, r in enumerate(ROWS) if r == i}
