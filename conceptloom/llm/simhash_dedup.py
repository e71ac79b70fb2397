"""Near duplicates by SimHash with pigeonring filtering.

Two 64-bit fingerprints that differ in at most r bits, cut into m segments on a ring, have a segment from which every
chain of l consecutive segments differs in at most l * r / m bits.  Chains with a budget below one bit must be equal,
so the first of them is the key by which fingerprints meet; pairs then have to keep within the budget of every longer
chain before the full Hamming check.  Equal fingerprints are folded first, so copies never meet in pairs.

A key that more than ``PAIRS`` distinct fingerprints share is not expanded to pairs: its fingerprints go to all
fingerprints at a distance of up to r / 2 (each at most the ball's size times), and two within r bits meet at one
between them.  Those meetings are bounded by the ball's size and lose no link.  (This way needs an even radius.)

``survivors`` also links texts whose sets of five-word shingles have a similarity of ``SIMILARITY`` or more.  Such pairs
differ in about 10 of 64 bits, up to ``NEAR_RADIUS``, where no key of equal segments prunes any more.  Their candidates
are texts that share one of ``BANDS`` keys of ``ROWS`` minimal shingle hashes (a pair of similarity 0.8 has none in
common once in 300 000 times); pigeonring chains, the Hamming check and parities of the sets (which lose nothing) prune them, and the shingle sets
themselves decide.  As in ``odd_sketch_dedup``, each text of a key is compared with one of them, the hub; only texts that stay
unconnected are then compared, block by block, with those of other components of the key, so no link is lost and no group
is expanded to all pairs.

Defined results: null, empty and blank texts have fingerprint 0 and are linked like any other; repeated rows are
documents of their own with the same class; a null id never is a component's id unless all its ids are null; further
columns are ignored by ``near_duplicates`` and carried by ``survivors``; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conceptloom.llm.bitmaps import filtered, may_be_in, short_bitmap_of
from conceptloom.llm.common import ascii_lower, lookup, small_batches, spare, whole_text
from conceptloom.llm.components import components
from conceptloom.llm.decontamination import Text
from conceptloom.llm.odd_sketch_dedup import Verifier, one_text, parity_sketch, parity_words
from conceptloom.llm.odd_sketch_dedup import links as connecting
from conceptloom.scratch import Scratch

BITS = 64
RADIUS = 2
SEGMENTS = 16
SHINGLE = 3
SEED = 42
#: The most distinct fingerprints of a key that are compared in pairs, and comparisons that share a copy of a text's set.
PAIRS = 64
#: Links by similarity of shingle sets: words of a shingle, least similarity, most differing bits, segments of the ring.
WORDS, SIMILARITY = 5, 0.8
NEAR_RADIUS, NEAR_SEGMENTS = 24, 8
BANDS, ROWS = 24, 4
#: Bits of the bitmaps that keep texts without a partner from being shuffled (8 MiB each, at any size of the input).
BITMAP = 26
_WHITE = bytes(range(9, 14))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def fingerprint_of(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    import xxhash

    words = text.encode("utf-8", "surrogatepass").translate(_SPACES).split(b" ")
    words = [w for w in words if w]
    if not words:
        return 0
    whole = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    begin = end - size
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(whole[a:b], seed) for a, b in zip(begin[: len(words) - k + 1].tolist(), end[k - 1 :].tolist(), strict=True)],
        dtype=">u8",
    )
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 14):  # long texts in steps
        part = hashes[at : at + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big", signed=True)


_SPACES = bytes.maketrans(_WHITE, b" " * len(_WHITE))


def fingerprint(shingle: int = SHINGLE, seed: int = SEED):
    @F.pandas_udf("bigint")
    def simhash(texts):
        import pandas as pd

        return pd.Series([fingerprint_of(t, shingle, seed) for t in texts], dtype="int64")

    return simhash


def _turned(fp: Column, by: int) -> Column:
    return F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, BITS - by)) if by else fp


def _within_budgets(differ: Column, segments: int, radius: int) -> Column:
    """Every chain from the first segment on keeps within its share of the radius."""
    width, out = BITS // segments, F.lit(True)
    for chain in range(1, segments + 1):
        budget = chain * radius // segments
        if budget and (chain == segments or (chain + 1) * radius // segments > budget):  # the longest of each budget
            out = out & (F.bit_count(F.shiftrightunsigned(differ, BITS - chain * width)) <= budget)
    return out


def links(scratch: Scratch, fps: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS, pairs: int = PAIRS) -> DataFrame:
    """(a, b): links that connect all of the distinct fingerprints ``fps`` (fp) that differ in at most ``radius`` bits."""
    width = BITS // segments
    zero = max(c for c in range(1, segments) if c * radius // segments == 0)  # chain without budget
    rings = scratch.save(fps.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.shiftrightunsigned(_turned(F.col("fp"), i * width), BITS - zero * width).alias("key"))
        for i in range(segments)
    ])).alias("_r")).select("fp", "_r.i", "_r.key"), "rings")
    full = scratch.save(rings.groupBy("i", "key").agg(F.count("*").alias("_n")).where("_n > 1"), "keys")
    near = rings.join(full.where(F.col("_n") <= pairs).drop("_n"), ["i", "key"])
    other = near.select(F.col("fp").alias("fp2"), "i", "key")
    differ = F.col("fp").bitwiseXOR(F.col("fp2"))
    turned = F.coalesce(*[F.when(F.col("i") == i, _turned(differ, i * width)) for i in range(segments)])
    light = near.join(other, ["i", "key"]).where(F.col("fp") < F.col("fp2")).where(
        _within_budgets(turned, segments, radius)
    ).where(F.bit_count(differ) <= radius).select(F.col("fp").alias("a"), F.col("fp2").alias("b"))
    crowded = rings.join(full.where(F.col("_n") > pairs).drop("_n"), ["i", "key"]).select("fp").distinct()
    masks = [sum(1 << b for b in c) for k in range(radius // 2 + 1) for c in combinations(range(BITS), k)]
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]
    meet = crowded.select("fp", F.explode(F.transform(
        F.array(*[F.lit(m).cast("bigint") for m in signed]), lambda m: F.col("fp").bitwiseXOR(m)
    )).alias("hub")).groupBy("hub").agg(F.collect_list("fp").alias("_all")).where(F.size("_all") > 1)
    dense = meet.select(F.array_min("_all").alias("a"), F.explode("_all").alias("b")).where("a <> b")
    return light.unionByName(dense).distinct()


def shingles_of(text: str, k: int = WORDS) -> np.ndarray:
    """Hashes of the different shingles of a text, in order; one of all words if there are fewer than k."""
    h = Text(text, _SPACES).hashes
    k = min(k, len(h))
    out = np.zeros(len(h) - k + 1 if k else 0, np.uint64)
    for j in range(k):
        out = (out ^ out >> np.uint64(32)) * _MIX + h[j : j + len(out)]
    out = (out ^ out >> np.uint64(31)) * _MIX
    return np.unique(out ^ out >> np.uint64(29))


def _sketch_of(text: str) -> dict:
    """Fingerprint, size and parities of the shingle set, and its keys for candidates."""
    h = shingles_of(text)
    if not len(h):
        return {"near": 0, "size": 0, "keys": []} | dict.fromkeys(parity_words(), 0)
    seeds = np.random.default_rng(SEED).integers(1 << 63, size=(2, BANDS * ROWS), dtype=np.uint64) | np.uint64(1)
    least, ones = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64), np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 12):  # long texts in steps
        part = h[at : at + (1 << 12)]
        least = np.minimum(least, ((part[:, None] ^ seeds[0]) * seeds[1]).min(axis=0))
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ keys >> np.uint64(32)) * _MIX + column
    near = int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big", signed=True)
    return {"near": near, "size": len(h), "keys": keys.view(np.int64).tolist()} | dict(zip(parity_words(), parity_sketch(h).tolist(), strict=True))


_SKETCH = T.StructType().add("near", T.LongType()).add("size", T.IntegerType()).add("keys", T.ArrayType(T.LongType()))
for _word in parity_words():
    _SKETCH = _SKETCH.add(_word, T.LongType())


@F.pandas_udf(_SKETCH)
def _sketch(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_sketch_of(t) for t in texts], columns=_SKETCH.names)


def _marks(shingle: int):
    """Fingerprint and sketch of a text in one pass."""

    @F.pandas_udf(f"fp bigint, near bigint, size int, keys array<bigint>, {', '.join(f'{w} bigint' for w in parity_words())}")
    def marks(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = [{"fp": fingerprint_of(t, shingle)} | _sketch_of(t) for t in texts]
            yield pd.DataFrame(rows, columns=["fp", "near", "size", "keys", *parity_words()])

    return marks


@F.pandas_udf(T.ArrayType(T.LongType()))
def _shingle_set(texts: pd.Series) -> pd.Series:
    return pd.Series([shingles_of(t).view(np.int64) for t in texts], dtype=object)


def _normal() -> Column:
    return ascii_lower(whole_text())


class _Pigeonring(Verifier):
    """Fingerprints as sketches: some chain on their ring keeps within every budget, and so do all bits."""

    def similar(self) -> Column:
        differ = F.col("near_a").bitwiseXOR(F.col("near_b"))
        return super().similar() & reduce(Column.__or__, [
            _within_budgets(_turned(differ, i * (BITS // NEAR_SEGMENTS)), NEAR_SEGMENTS, NEAR_RADIUS) for i in range(NEAR_SEGMENTS)
        ])


def similar(scratch: Scratch, docs: DataFrame, marked: DataFrame, least: float = SIMILARITY, pairs: int = PAIRS) -> DataFrame:
    """(a, b): fingerprints of texts with similar shingle sets, as many as connect what all such links connect.

    ``marked`` has doc_id, node (digest of the text), fp, _s (sketch); ``pairs``: so many comparisons share a copy of a text's set.
    """
    texts = scratch.save(
        marked.where("_s.size > 0").groupBy("node").agg(F.first(F.struct("fp", "_s")).alias("_t"), F.min("doc_id").alias("of_id"))
        .select("node", "of_id", "_t.fp", "_t._s.*", F.monotonically_increasing_id().alias("t")), "texts",
    )
    keys = texts.select("t", F.explode("keys").alias("key"))
    shared = scratch.save(keys.select("key").groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1").select("key"), "shared-keys")
    members = scratch.save(filtered(keys, F.col("key"), shared, "key", BITMAP).join(shared, "key").select("key", "t"), "members")
    wanted = texts.join(members.select("t").distinct(), "t", "left_semi").select("t", "of_id", F.col("node").alias("of_digest"))
    sets = scratch.save(one_text(docs, wanted).select("t", _shingle_set("_text").alias("set")), "sets")  # only texts with a candidate
    check = _Pigeonring(scratch, texts.select("t", "size", "near", *parity_words()), sets, least * 100, NEAR_RADIUS, ["near"], pairs)
    edges = connecting(scratch, check, members)
    fp = lambda old: texts.select(F.col("t").alias(old), F.col("fp").alias(f"fp_{old}"))
    return edges.join(fp("a"), "a").join(fp("b"), "b").where("fp_a <> fp_b").select(
        F.col("fp_a").alias("a"), F.col("fp_b").alias("b")).distinct()


def _classes(spark: SparkSession, docs: DataFrame, shingle: int, radius: int, segments: int, least: float | None = None):
    scratch = Scratch(spark, "simhash")
    if least is None:
        marked = docs.select("doc_id", fingerprint(shingle)(_normal()).alias("fp"))
    else:
        marked = docs.select("doc_id", F.md5(_normal()).alias("node"), _marks(shingle)(_normal()).alias("_m")).select(
            "doc_id", "node", "_m.fp", F.struct(*[f"_m.{c}" for c in ("near", "size", "keys", *parity_words())]).alias("_s"))
    marked = scratch.save(marked, "fingerprints")
    fps = scratch.save(marked.groupBy("fp").agg(F.min("doc_id").alias("_id"), F.count("*").alias("_n")), "distinct")
    edges = links(scratch, fps, radius, segments)
    if least is not None:
        edges = edges.unionByName(similar(scratch, docs, marked, least))
    labels = components(scratch, edges)
    joined = fps.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    ids = joined.groupBy("label").agg(F.min("_id").alias("component_id"))
    return marked, scratch.save(joined.join(ids, "label").select("fp", "_n", "component_id"), "classes")


def near_duplicates(
    spark: SparkSession, docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, segments: int = SEGMENTS
) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id of every row."""
    marked, classes = _classes(spark, docs, shingle, radius, segments)
    return lookup(marked, classes, "fp", "_n", marked.count(), F.struct("doc_id")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def survivors(
    spark: SparkSession, docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, segments: int = SEGMENTS,
    least: float = SIMILARITY,
) -> DataFrame:
    """The rows that stay, with all their columns: of each component, those with its least id."""
    with small_batches(spark):
        marked, classes = _classes(spark, docs, shingle, radius, segments, least)
    found = lookup(marked.select("doc_id", "node", "fp"), classes, "fp", "_n", marked.count(), F.struct("doc_id"))
    gone = Scratch(spark, "simhash-gone").save(
        found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).distinct().select(
            F.col("doc_id").alias("_gone"), F.col("node").alias("_gone_node"), F.xxhash64("node").alias("_h")), "gone",
    )
    node = spare(docs, "_node")
    here = docs.withColumn(node, F.md5(_normal()))
    # Texts that certainly stay don't move; of the others those that go are found by id and text.
    shared = spark.sparkContext.broadcast(short_bitmap_of(gone, "_h", BITMAP))
    maybe = may_be_in(shared, BITMAP)(F.xxhash64(node))
    same = F.col("doc_id").eqNullSafe(gone["_gone"]) & (F.col(node) == gone["_gone_node"])
    return here.where(~maybe).select(*docs.columns).unionByName(
        here.where(maybe).join(gone, same, "left_anti").select(*docs.columns)
    )
