"""Attribute-set algebra on BIGINT columns.

A set of attribute numbers is held in ``k`` BIGINT columns ("words") of 63 bits
each; the sign bit stays free.  Up to 63 attributes ``k`` is 1, so the usual
context needs one plain BIGINT and stays inside whole-stage code generation.
Wider contexts only use more columns: the same expressions, the same plans.

Every function takes and returns lists of Columns (one per word) or a Column.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_BITS = 63
WORD_FULL = (1 << WORD_BITS) - 1

Words = Sequence[Column]


def word_count(n_attributes: int) -> int:
    """Words needed for ``n_attributes`` attributes (at least one)."""
    return max(1, -(-n_attributes // WORD_BITS))


def names(prefix: str, k: int) -> list[str]:
    return [f"{prefix}{i}" for i in range(k)]


def cols(prefix: str, k: int) -> list[Column]:
    return [F.col(c) for c in names(prefix, k)]


def rename(words: Words, prefix: str) -> list[Column]:
    return [w.alias(f"{prefix}{i}") for i, w in enumerate(words)]


def fields(struct: Column, prefix: str, k: int) -> list[Column]:
    """Words stored as fields of a struct column."""
    return [struct.getField(c) for c in names(prefix, k)]


# -- Python ints <-> words ---------------------------------------------------


def split_int(mask: int, k: int) -> list[int]:
    return [(mask >> (WORD_BITS * i)) & WORD_FULL for i in range(k)]


def join_int(words: Iterable[int]) -> int:
    return sum(w << (WORD_BITS * i) for i, w in enumerate(words))


def literal(mask: int, k: int) -> list[Column]:
    return [F.lit(w).cast("bigint") for w in split_int(mask, k)]


# -- set algebra ---------------------------------------------------------------


def intersect(a: Words, b: Words) -> list[Column]:
    return [x.bitwiseAND(y) for x, y in zip(a, b)]


def union(a: Words, b: Words) -> list[Column]:
    return [x.bitwiseOR(y) for x, y in zip(a, b)]


def difference(a: Words, b: Words) -> list[Column]:
    return [x.bitwiseAND(F.bitwise_not(y)) for x, y in zip(a, b)]


def equal(a: Words, b: Words) -> Column:
    return reduce(and_, [x == y for x, y in zip(a, b)])


def is_subset(a: Words, b: Words) -> Column:
    """``a`` is contained in ``b``."""
    return equal(intersect(a, b), a)


def is_strict_subset(a: Words, b: Words) -> Column:
    return is_subset(a, b) & ~equal(a, b)


def size(a: Words) -> Column:
    """Number of members, as BIGINT."""
    return reduce(add, [F.bit_count(w).cast("bigint") for w in a])


# -- single attributes ---------------------------------------------------------


def _shift(by: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), by.cast("int"))


def _word_of(j: Column) -> Column:
    return F.floor(j / WORD_BITS).cast("int")


def _bit_of(j: Column) -> Column:
    return (j % WORD_BITS).cast("int")


def singleton(j: Column, k: int) -> list[Column]:
    """The set {j} for a column ``j`` of attribute numbers."""
    if k == 1:
        return [_shift(j)]
    return [
        F.when(_word_of(j) == i, _shift(_bit_of(j))).otherwise(F.lit(0).cast("bigint"))
        for i in range(k)
    ]


def contains(a: Words, j: Column) -> Column:
    """Attribute number ``j`` (a column) is a member of ``a``."""
    if len(a) == 1:
        return F.getbit(a[0], j) == 1
    return reduce(
        or_, [(_word_of(j) == i) & (F.getbit(w, _bit_of(j)) == 1) for i, w in enumerate(a)]
    )


def contains_fixed(a: Words, j: int) -> Column:
    """Attribute number ``j`` (a Python int) is a member of ``a``."""
    return F.getbit(a[j // WORD_BITS], F.lit(j % WORD_BITS)) == 1


def below(j: Column, k: int) -> list[Column]:
    """The prefix {0, ..., j-1}."""
    one = F.lit(1).cast("bigint")
    if k == 1:
        return [_shift(j) - one]
    return [
        F.when(_word_of(j) > i, F.lit(WORD_FULL).cast("bigint"))
        .when(_word_of(j) == i, _shift(_bit_of(j)) - one)
        .otherwise(F.lit(0).cast("bigint"))
        for i in range(k)
    ]


def each_attribute(n_attributes: int) -> Column:
    """Explode to all attribute numbers; follow it with a filter on membership."""
    return F.explode(F.lit(list(range(n_attributes))))


def each_member(df: DataFrame, a: Words, n_attributes: int, name: str) -> DataFrame:
    """``df`` with a row for each attribute number of ``a``, as column ``name``.

    Only words that aren't empty are opened, so a sparse set of a wide context costs its words, not the width.
    """
    if len(a) == 1:
        number = F.explode(F.lit(list(range(min(n_attributes, WORD_BITS)))))
        return df.withColumn(name, number).where(F.getbit(a[0], F.col(name)) == 1)
    words = F.filter(
        F.array(*[F.struct(F.lit(i * WORD_BITS).alias("at"), w.alias("w")) for i, w in enumerate(a)]), lambda x: x["w"] != 0
    )
    opened = df.withColumn("_word", F.explode(words)).withColumn("_bit", F.explode(F.lit(list(range(WORD_BITS)))))
    return opened.where(F.getbit("_word.w", "_bit") == 1).withColumn(name, F.col("_word.at") + F.col("_bit")).drop("_word", "_bit")


def members(a: Words, n_attributes: int) -> Column:
    """Sorted array of the attribute numbers in ``a``."""
    every = F.sequence(F.lit(0), F.lit(n_attributes - 1)) if n_attributes else F.array()
    return F.filter(every.cast("array<int>"), lambda j: contains(a, j))


# -- orders ----------------------------------------------------------------------


def lectic_less(a: Words, b: Words) -> Column:
    """Lectic order: the smallest attribute on which the sets differ is in ``b``."""
    out = F.lit(False)
    for x, y in reversed(list(zip(a, b))):
        diff = x.bitwiseXOR(y)
        lowest = diff.bitwiseAND(-diff)
        out = F.when(diff == 0, out).otherwise(y.bitwiseAND(lowest) != 0)
    return out


def lectic_less_at(a: Words, b: Words, j: Column) -> Column:
    """``a`` <_j ``b``: ``j`` is in ``b`` only, and both agree on all below ``j``."""
    return contains(b, j) & ~contains(a, j) & agree_below(a, b, j)


def agree_below(a: Words, b: Words, j: Column) -> Column:
    """Both sets hold the same attributes among {0, ..., j-1}.

    With ``b`` the closure of ``a + {j}`` this is the canonicity test.
    """
    p = below(j, len(a))
    return equal(intersect(a, p), intersect(b, p))


# -- names, text -------------------------------------------------------------------


def to_names(a: Words, attributes: Sequence[str]) -> Column:
    """Attribute names of the set, in attribute order."""
    if not attributes:
        return F.array().cast("array<string>")
    picks = [F.when(contains_fixed(a, j), F.lit(n)) for j, n in enumerate(attributes)]
    return F.array_compact(F.array(*picks))


def from_names(chosen: Iterable[str], attributes: Sequence[str]) -> int:
    """The set of the given names, as a Python int."""
    at = {n: j for j, n in enumerate(attributes)}
    return sum(1 << at[n] for n in set(chosen))


def union_of(j: Column, k: int) -> list[Column]:
    """Aggregate: the set of all attribute numbers ``j`` in the group."""
    return [F.coalesce(F.bit_or(w), F.lit(0).cast("bigint")) for w in singleton(j, k)]


def meet(a: Words) -> list[Column]:
    """Aggregate: intersection of all sets in the group (NULL on no rows)."""
    return [F.bit_and(w) for w in a]


def to_hex(a: Words) -> Column:
    """Hexadecimal text of the words, highest word first."""
    return F.concat(*[F.lpad(F.hex(w), 16, "0") for w in reversed(list(a))])


def digest(a: Words) -> Column:
    """SHA-256 of the set, a text key that is the same on every run."""
    return F.sha2(to_hex(a), 256)
