import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from conceptloom.operators.context import from_masks  # noqa: E402
from conceptloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests")
    session.conf.set("spark.sql.shuffle.partitions", "2")
    return session


# A well-known example context, one line per object.
ANIMALS = """\
;flies;nocturnal;feathered;migratory;red-bill;elytra;sea-habitat;wood-habitat;six-legged;eats-fish;water-habitat
ladybird;1;0;0;0;0;1;0;0;1;0;0
bat;1;1;0;0;0;0;0;0;0;0;0
ostrich;0;0;1;0;0;0;0;0;0;0;0
greater-flamingo;1;0;1;1;0;0;1;0;0;1;1
silver-gull;1;0;1;0;1;0;1;0;0;1;1
little-tern;1;0;1;1;0;0;1;0;0;1;1
great-auk;1;0;1;0;0;0;1;0;0;1;1
wood-pecker;1;0;1;0;0;0;0;1;0;0;0
giant-otter;0;0;0;0;0;0;0;0;0;1;1
arctic-tern;1;0;1;1;1;0;1;0;0;1;1"""
ANIMALS_SIZE = (13, 18)  # concepts, cover edges


@pytest.fixture()
def animals_file(tmp_path):
    path = tmp_path / "animals.csv"
    path.write_text(ANIMALS)
    return str(path)


def make_context(spark, rows, n_attributes, ids=None):
    """A context from Python ints, one per object."""
    from conceptloom.functions import masks as M

    k = M.word_count(n_attributes)
    data = [(i, f"o{i}", *M.split_int(r, k)) for i, r in enumerate(rows)]
    schema = "obj_id bigint, name string, " + ", ".join(f"m{i} bigint" for i in range(k))
    return from_masks(spark.createDataFrame(data, schema), [f"a{j}" for j in range(n_attributes)])


def brute_concepts(rows, n_attributes):
    """Closures of all attribute sets by definition: intent -> extent size."""
    full = (1 << n_attributes) - 1
    out = {}
    for x in range(1 << n_attributes):
        extent = [r for r in rows if r & x == x]
        intent = full
        for r in extent:
            intent &= r
        out[intent] = len(extent)
    return out


def brute_covers(intents):
    """(child, parent) with nothing between."""
    below = lambda a, b: a != b and a & b == a
    return {
        (c, p) for c in intents for p in intents
        if below(p, c) and not any(below(p, m) and below(m, c) for m in intents)
    }


def got_concepts(lattice):
    from conceptloom.functions import masks as M

    return {
        M.join_int(r[f"i{i}"] for i in range(lattice.k)): r.n_extent for r in lattice.concepts().collect()
    }


def got_covers(lattice):
    from conceptloom.functions import masks as M

    return [
        (M.join_int(r[f"child{i}"] for i in range(lattice.k)), M.join_int(r[f"parent{i}"] for i in range(lattice.k)))
        for r in lattice.covers().collect()
    ]
