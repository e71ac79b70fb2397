"""Subtrees that are closed as tables, against brute force."""

import random

import numpy as np
import pytest
from conftest import brute_concepts, brute_covers, got_concepts, got_covers, make_context
from pyspark.sql import functions as F

from conceptloom.operators import frontier
from conceptloom.operators.enumerate import build_lattice


def walked(sets, n, newer=None):
    """(concepts -> extent, covers, how many concepts were walked one by one)."""
    rows = (np.array(sets)[:, None] >> np.arange(n)) & 1 == 1
    walker = frontier._Walker(rows, np.ones(len(sets)), np.ones(len(sets), bool) if newer is None else newer)
    closed, opened = walker.run(rows.all(axis=0)[None], np.array([len(sets)]), np.array([0]), 1 << 40, False)
    assert not opened
    power = 1 << np.arange(n)
    found = [(h @ power, e, lower @ power, c) for h, e, _, lower, c in closed] + walker.tabled
    extents, covers = {}, set()
    for intents, extent, lower, counts in found:
        extents |= zip(intents.tolist(), extent.tolist())
        covers |= set(zip(lower.tolist(), np.repeat(intents, counts).tolist()))
    assert len(extents) == sum(len(f[0]) for f in found)
    return extents, covers, sum(len(c[2]) for c in closed)


@pytest.mark.parametrize("density", (0.2, 0.5, 0.9))
@pytest.mark.parametrize("table", (0, 3, 16))
def test_tables_equal_brute_force(monkeypatch, density, table):
    monkeypatch.setattr(frontier, "TABLE_START", -1e18)
    monkeypatch.setattr(frontier, "TABLE", table)
    rng = random.Random(density)
    sets = list({sum((rng.random() < density) << j for j in range(7)) for _ in range(12)})
    want = {i: e for i, e in brute_concepts(sets, 7).items() if e}  # the empty extent isn't walked
    extents, covers, _ = walked(sets, 7)
    assert extents == want
    assert covers == {(c, p) for c, p in brute_covers(brute_concepts(sets, 7)) if c in want}


def test_tables_visit_only_concepts_with_a_new_row(monkeypatch):
    monkeypatch.setattr(frontier, "TABLE_START", -1e18)
    rng = random.Random(4)
    sets = list({rng.getrandbits(7) for _ in range(14)})
    newer = np.arange(len(sets)) < 2
    extents, _, _ = walked(sets, 7, newer)
    assert extents == {i: e for i, e in brute_concepts(sets, 7).items() if any(s & i == i for s in sets[:2])}


def test_many_concepts_of_few_attributes_are_not_walked_one_by_one():
    """As of suppliers x brands: thousands of different rows over few attributes."""
    rng = random.Random(6)
    sets = list({rng.getrandbits(14) for _ in range(3000)})
    extents, _, steps = walked(sets, 14)
    assert len(extents) > 5000
    assert steps < len(extents) / 100


def test_lattice_with_tables_equals_the_join_method(spark):
    rng = random.Random(11)
    context = make_context(spark, [rng.getrandbits(11) for _ in range(400)], 11)
    some, other = build_lattice(context), build_lattice(context, "join")
    assert got_concepts(some) == got_concepts(other)
    assert sorted(got_covers(some)) == sorted(got_covers(other))
    named = some.covers(name=F.concat(F.lit("p"), "i0")).collect()
    assert all(r.name == f"p{r.parent0}" for r in named) and len(named) == len(got_covers(some))
