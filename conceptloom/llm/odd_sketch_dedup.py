"""Near duplicates by MinHash bands, with odd sketches to verify candidates.

A document's set is that of its different word shingles.  Equal sets are folded first.  Of each set, ``BANDS * ROWS``
MinHash samples are taken; sets that share all samples of a band are candidates (a pair at the least similarity shares
none about once in ten million).  The samples are also folded into an odd sketch: sample i with value x flips the
bit that (i, x) hashes to, so in the XOR of two sketches equal samples cancel out and the number of ones grows with the
number of samples that differ, precisely so for similar sets.  Candidates whose XOR has more ones than a pair at the
least similarity reaches once in a million (``most_ones``) go.  A second odd sketch has the parities of the set itself: its
XOR has no more ones than the sets have different shingles, so pairs with more than the least similarity allows go, without
any loss.  The others are confirmed on the full sets.

Classes need links that connect, not all pairs of a group.  Of each band key the least member is the hub and is compared
with all others; for keys whose members are still in different components this is repeated ``TURNS`` times with a hub
from outside the first one's component.  What is left is compared across components in blocks: a key's fringe, the
members outside its largest component, meets blocks of that component and of the fringe, and of each two blocks only
links that join components leave the task; a set goes to a block only if its sketches allow a partner there.  So a group of copies costs its size, no pair of a group is ever a row, and
no link between components is lost.  Of keys with the same members one is compared.  Sketches decide first; sets move
only for texts that a candidate or a block still names.  Work is a group's size times its fringe; for a group of which no two belong
together that is its square, which no exact method avoids.

Defined results: a document without words has an empty set, size 0, is linked with nothing and is its own component;
one with fewer words than a shingle has one shingle of them all.  Repeated rows are documents of their own in the same
class; a null id is a component's id only if all its ids are null, and then kept.  Further columns are ignored; an empty
table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptloom.llm.bitmaps import filtered
from conceptloom.llm.common import ascii_lower, lookup, whole_text
from conceptloom.llm.components import components
from conceptloom.scratch import Scratch

WORDS = 4
#: Least similarity in percent.
PERCENT = 80
BANDS, ROWS = 40, 5
#: Bits of an odd sketch, of the samples and of the whole set.
BITS, PARITY_BITS = 512, 512
SEED = 13
TURNS = 1
#: Shingles of the sets in a block, and shingles that a set counts as besides its own, so that blocks of short texts are bounded.
CELLS, LEAST_CELLS = 1 << 18, 128
#: Bits of the bitmaps that keep rows without a partner from being shuffled (8 MiB each, at any size of the input).
BITMAP = 26
#: Copies of a hub's set are made for each so many of its candidates, so that no task compares all of them.
SPOKES = 512
#: Shingles whose samples are taken at once: small enough for the processor's cache.
_STEP = 256
_SPACES = bytes.maketrans(bytes(range(9, 14)), b" " * 5)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the different shingles of a lower-cased text."""
    import xxhash

    parts = text.encode("utf-8", "surrogatepass").translate(_SPACES).split()
    if not parts:
        return np.zeros(0, np.uint64)
    whole = b" ".join(parts)
    end = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    k = min(words, len(parts))
    begin = np.concatenate(([0], end[:-1] + 1))[: len(parts) - k + 1]
    digest = xxhash.xxh3_64_intdigest
    hashes = [digest(whole[a:b]) for a, b in zip(begin.tolist(), end[k - 1 :].tolist(), strict=True)]
    return np.unique(np.array(hashes, np.uint64))


def samples(hashes: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One MinHash value (32 bits) for each row of each band; ``hashes`` isn't empty."""
    seeds = np.random.default_rng(SEED).integers(1 << 32, size=(2, bands * rows), dtype=np.uint32)
    seeds[1] |= np.uint32(1)
    h = (hashes ^ hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(bands * rows, (1 << 32) - 1, np.uint32)
    for at in range(0, len(h), _STEP):
        np.minimum(least, ((h[at : at + _STEP, None] ^ seeds[0]) * seeds[1]).min(axis=0), out=least)
    return least


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * _MIX
    return x ^ x >> np.uint64(29)


def band_keys(least: np.ndarray, rows: int = ROWS) -> np.ndarray:
    keys = np.arange(len(least) // rows, dtype=np.uint64)
    for column in least.reshape(-1, rows).T:
        keys = _mixed(keys * _MIX + column + np.uint64(1))
    return keys.view(np.int64)


def odd_sketch(least: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Parity of the samples that fall on each bit, as 64-bit words."""
    place = _mixed(_mixed(np.arange(1, len(least) + 1, dtype=np.uint64) * _MIX) + least) % np.uint64(bits)
    odd = np.bincount(place.astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def parity_words(bits: int = PARITY_BITS) -> list[str]:
    return [f"p{i}" for i in range(bits // 64)]


def parity_sketch(hashes: np.ndarray, bits: int = PARITY_BITS) -> np.ndarray:
    """Parity of the hashes of a set that fall on each bit, as 64-bit words: two such differ in at most as many bits as the sets in hashes."""
    odd = np.bincount((_mixed(hashes) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def similarity_of(ones: int, n: int, bits: int = BITS) -> float:
    """Estimated similarity of two sets of ``n`` samples whose sketches differ in ``ones`` bits."""
    return 1 + bits / (4 * n) * math.log(max(1e-9, 1 - 2 * ones / bits))


def most_ones(percent: int = PERCENT, n: int = BANDS * ROWS, bits: int = BITS, deviations: float = 5.0) -> int:
    """Differing bits that a pair at the least similarity exceeds about once in a million.

    The number of differing samples is binomial and each flips two bits of the XOR; both spreads are allowed for.
    """
    p = 1 - percent / 100
    differ = min(n, n * p + deviations * math.sqrt(n * p * (1 - p)))
    mean = bits / 2 * (1 - (1 - 2 / bits) ** (2 * differ))
    spread = math.sqrt(max(0.0, bits / 4 * (1 - (1 - 4 / bits) ** (2 * differ))))
    return math.ceil(mean + deviations * spread)


def _normal() -> Column:
    return ascii_lower(whole_text())


def _sketched(words: int, bands: int, rows: int, bits: int):
    names = [*[f"o{i}" for i in range(bits // 64)], *parity_words()]
    words_type = ", ".join(f"{x} bigint" for x in names)

    @F.pandas_udf(f"d0 bigint, d1 bigint, size bigint, keys array<bigint>, {words_type}")
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import xxhash

        for texts in batches:
            out = []
            for t in texts:
                s = shingle_set(t, words)
                if not len(s):
                    out.append((0, 0, 0, np.zeros(0, np.int64), *[0] * len(names)))
                    continue
                d = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64).tolist()
                least = samples(s, bands, rows)
                out.append((*d, len(s), band_keys(least, rows), *odd_sketch(least, bits).tolist(), *parity_sketch(s).tolist()))
            yield pd.DataFrame(out, columns=["d0", "d1", "size", "keys", *names])

    return sketch


def _sets_of(words: int):
    @F.pandas_udf("array<bigint>")
    def shingles(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, words).view(np.int64) for t in texts], dtype=object)

    return shingles


class Verifier:
    """Confirms candidate pairs (a, b) of sets: sketches first, then the full sets.

    ``sets`` has t, size, the ``words`` of the sketches, of which similar pairs differ in at most ``ones`` bits, and the parities
    of the sets; ``full`` has t and set, at least of those that have a candidate.
    """

    def __init__(self, scratch: Scratch, sets: DataFrame, full: DataFrame | None, percent: float, ones: int, words: list[str],
                 spokes: int = SPOKES):
        self.scratch, self.sets, self.full, self.percent = scratch, sets, full, percent
        self.ones, self.words, self.spokes = ones, words, spokes
        self.columns = ["size", *words, *parity_words()]

    def side(self, s: str) -> DataFrame:
        return self.sets.select(F.col("t").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in self.columns])

    def similar(self) -> Column:
        """What sizes and sketches allow, over columns of both sides."""
        ones, odd = (sum((F.bit_count(F.col(f"{w}_a").bitwiseXOR(F.col(f"{w}_b"))) for w in words), F.lit(0)) for words in (self.words, parity_words()))
        return (F.least("size_a", "size_b") * 100 >= F.greatest("size_a", "size_b") * self.percent) & (ones <= self.ones) & (
            odd * (100 + self.percent) <= (F.col("size_a") + F.col("size_b")) * (100 - self.percent))

    def sketched(self, pairs: DataFrame) -> DataFrame:
        """Different pairs that sizes and sketches allow."""
        return pairs.distinct().join(self.side("a"), "a").join(self.side("b"), "b").where(self.similar()).select("a", "b")

    def across(self, apart: DataFrame, name: str) -> DataFrame:
        """Links that join components, among all members of a key in different components; ``apart``: key, t, label."""
        sized = self.scratch.save(apart.select("key", "t", "label").join(_named(self.sets, apart, "t"), "t"), f"{name}-members")
        parts = sized.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum(F.col("size") + LEAST_CELLS).alias("cells"))
        keys = parts.groupBy("key").agg(
            F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("cells").alias("cells"),
            F.max_by("cells", F.struct("n", "label")).alias("main_cells"),
        ).select("key", "main", F.ceil(F.col("main_cells") / CELLS).alias("main_blocks"),
                 F.ceil((F.col("cells") - F.col("main_cells")) / CELLS).alias("fringe_blocks"))
        own = F.col("label") == F.col("main")
        block = F.pmod(F.xxhash64("t"), F.when(own, F.col("main_blocks")).otherwise(F.col("fringe_blocks"))).alias("block")
        numbered = sized.join(keys, "key").select("*", own.alias("is_main"), block)
        place = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
        here, upto = F.col("block"), lambda c: F.sequence(F.lit(0).cast("bigint"), F.col(c) - 1)
        # fringe block i meets block j of the largest component (kind 0), and fringe block j >= i (kind 1)
        main = F.transform(upto("fringe_blocks"), lambda i: place(0, i, here, 1))
        fringe = F.concat(
            F.transform(upto("main_blocks"), lambda j: place(0, here, j, 0)),
            F.transform(F.sequence(here, F.col("fringe_blocks") - 1), lambda j: place(1, here, j, 0)),
            F.transform(F.sequence(F.lit(0).cast("bigint"), here), lambda i: place(1, i, here, 1)),
        )
        dealt = numbered.select("key", "t", "label", *self.columns, F.explode(F.when(F.col("is_main"), main).otherwise(fringe)).alias("_p"))
        dealt = dealt.select("key", "t", "label", *self.columns, "_p.*")
        blocks = ("key", "kind", "i", "j")
        maybe = self.scratch.save(dealt.groupBy(*blocks).applyInArrow(
            _with_partner(self.ones, self.percent, self.words), dealt.schema).select(*blocks, "side", "t", "label", *self.columns), f"{name}-maybe")
        found = maybe.join(_named(self.full, maybe, "t"), "t").groupBy(*blocks).applyInArrow(
            _between(self.ones, self.percent, self.words), "a bigint, b bigint")
        return self.scratch.save(found.distinct(), name)

    def confirmed(self, pairs: DataFrame, name: str) -> DataFrame:
        """Those whose sets are similar; the side with the more pairs of one set is dealt out over copies of it."""
        pairs = self.scratch.save(pairs, f"{name}-sketched")
        total = pairs.count()
        many = pairs.groupBy("a").agg(F.count("*").alias("_n"), F.count("*").alias("spokes"))
        dealt = lookup(pairs, many, "a", "_n", total, F.col("b")).withColumn(
            "copy", F.pmod(F.xxhash64("b"), F.floor(F.col("spokes") / self.spokes) + 1)
        )
        hubs = _named(self.full, pairs, "a").join(many, F.col("t") == F.col("a")).select(
            "a", F.col("set").alias("set_a"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("_n") / self.spokes))).alias("copy")
        )
        other = _named(self.full, pairs, "b").select(F.col("t").alias("b"), F.col("set").alias("set_b"))
        both = F.size(F.array_intersect("set_a", "set_b"))
        union = F.size("set_a") + F.size("set_b") - both
        return self.scratch.save(
            dealt.join(other, "b").join(hubs, ["a", "copy"]).where(both * 100 >= union * self.percent).select("a", "b"), name
        )


def _named(table: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """``table`` without most of the rows whose t isn't in ``column`` of ``rows``, so that they don't move."""
    return filtered(table, F.xxhash64("t"), rows.select(F.xxhash64(column).alias("_h")), "_h", BITMAP)


def _allowed(table: pa.Table, ones: int, percent: float, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the two sides of a block, and which pairs in different components sizes and sketches allow."""
    side, label, size = (table[c].to_numpy() for c in ("side", "label", "size"))
    a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)

    def differ(names: list[str]) -> np.ndarray:
        out = np.zeros((len(a), len(b)), np.int32)
        for w in names:
            word = table[w].to_numpy().view(np.uint64)
            out += np.bitwise_count(word[a][:, None] ^ word[b][None])
        return out

    low, high = np.minimum(size[a][:, None], size[b][None]), np.maximum(size[a][:, None], size[b][None])
    return a, b, (label[a][:, None] != label[b][None]) & (low * 100 >= high * percent) & (differ(words) <= ones) & (
        differ(parity_words()) * (100 + percent) <= (low + high) * (100 - percent))


def _with_partner(ones: int, percent: float, words: list[str]):
    """Rows of a block that sizes and sketches allow a partner."""

    def keep(group: pa.Table) -> pa.Table:
        table = group.combine_chunks()
        a, b, maybe = _allowed(table, ones, percent, words)
        return table.take(np.concatenate((a[maybe.any(axis=1)], b[maybe.any(axis=0)])))

    return keep


def _between(ones: int, percent: float, words: list[str]):
    """Links between two blocks of sets, one for each two components."""

    def compare(group: pa.Table) -> pa.Table:
        table = group.combine_chunks()
        t, label, size = (table[c].to_numpy() for c in ("t", "label", "size"))
        lists = table["set"].chunk(0) if table["set"].num_chunks else pa.array([], pa.list_(pa.int64()))
        cells, at = lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(size)))
        a, b, maybe = _allowed(table, ones, percent, words)
        keep_a, keep_b = maybe.any(axis=1), maybe.any(axis=0)
        a, b, maybe = a[keep_a], b[keep_b], maybe[keep_a][:, keep_b]
        if not len(a):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        both = _common([cells[at[i] : at[i + 1]] for i in a], [cells[at[i] : at[i + 1]] for i in b])
        union = size[a][:, None] + size[b][None] - both
        x, y = np.nonzero(maybe & (both * 100 >= union * percent))
        pairs = np.stack([np.minimum(label[a[x]], label[b[y]]), np.maximum(label[a[x]], label[b[y]])])
        _, first = np.unique(pairs, axis=1, return_index=True)
        x, y = x[first], y[first]
        return pa.table({"a": pa.array(t[a[x]]), "b": pa.array(t[b[y]])})

    return compare


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, through products of 0/1 matrices, some shingles at a time."""
    shared = np.intersect1d(np.concatenate(left), np.concatenate(right))
    out = np.zeros((len(left), len(right)), np.float32)
    step = max(1, (1 << 21) // max(len(left), len(right)))

    def marks(sets: list[np.ndarray], some: np.ndarray) -> np.ndarray:
        m = np.zeros((len(sets), len(some)), np.float32)
        row, all_cells = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)
        col = np.searchsorted(some, all_cells)
        col[col == len(some)] = 0
        hit = some[col] == all_cells
        m[row[hit], col[hit]] = 1
        return m

    for at in range(0, len(shared), step):
        some = shared[at : at + step]
        out += marks(left, some) @ marks(right, some).T
    return out.astype(np.int64)


def once(members: DataFrame) -> DataFrame:
    """Of keys with the same members (by their number and digests of 96 bits) the least one with its members; no pair is lost."""
    h = F.xxhash64("t", F.lit(SEED))
    same = members.groupBy("key").agg(F.count("*").alias("_n"), F.bit_xor(F.xxhash64("t")).alias("_x"), F.sum(F.shiftright(h, 32)).alias("_y"))
    return members.join(same.groupBy("_n", "_x", "_y").agg(F.min("key").alias("key")).select("key"), "key", "left_semi")


def links(scratch: Scratch, check: Verifier, members: DataFrame, turns: int = TURNS) -> DataFrame:
    """(a, b): confirmed links that connect all sets of ``members`` (key, t) that any chain of links connects."""
    members = scratch.save(once(members), "once")
    hubs = members.groupBy("key").agg(F.min("t").alias("hub"))
    edges, turn = None, 0
    while True:
        spokes = members.join(hubs, "key").where("t <> hub").select(F.col("hub").alias("a"), F.col("t").alias("b"))
        new = check.confirmed(check.sketched(spokes), f"turn-{turn}")
        edges = new if edges is None else edges.unionByName(new)
        # A hub has been compared with its whole key: it leaves.
        label = components(scratch, edges, f"component-{turn}").withColumnRenamed("node", "t")
        known = scratch.save(
            members.join(hubs, "key", "left").where("hub is null or t <> hub").select("key", "t")
            .join(label, "t", "left").select("key", "t", F.coalesce("label", "t").alias("label")), f"known-{turn}",
        )
        still = known.groupBy("key").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi")).where("_lo <> _hi")
        apart = scratch.save(once(known.join(still, "key")), f"apart-{turn}")
        if not apart.limit(1).count():
            return edges
        turn += 1
        members = apart.select("key", "t")
        if turn > turns:
            break
        # The next hub is one outside the component of the least member, which was joined first.
        hubs = apart.where("label <> _lo").groupBy("key").agg(F.min_by("t", F.xxhash64("t", F.lit(turn))).alias("hub"))
    return edges.unionByName(check.across(apart, "across"))


def one_text(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """t, _text: the normal text of each row of ``wanted`` (t, of_id, of_digest), from one row of ``docs``; only such rows
    move, and once.  Rows of one digest have one text, so a hash of the id only has to tell most of its copies apart."""
    of = wanted.select("t", F.col("of_digest").alias("digest"), F.xxhash64("of_digest", "of_id").alias("_h"))
    texts = docs.select(F.md5(_normal()).alias("digest"), "doc_id", _normal().alias("_text")).select(
        "digest", F.xxhash64("digest", "doc_id").alias("_h"), "_text")
    return filtered(texts, F.col("_h"), of, "_h", BITMAP).join(of, ["digest", "_h"]).dropDuplicates(["digest", "_h"]).select("t", "_text")


def near_duplicates(
    spark: SparkSession, docs: DataFrame, words: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS,
    bits: int = BITS, turns: int = TURNS,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    docs, scratch = docs.select("doc_id", "text"), Scratch(spark, "odd-sketch")
    odd = [f"o{i}" for i in range(bits // 64)]
    words_of = [*odd, *parity_words()]
    marked = scratch.save(
        docs.select("doc_id", F.md5(_normal()).alias("digest"), _sketched(words, bands, rows, bits)(_normal()).alias("_s"))
        .select("doc_id", "digest", "_s.*"), "sketches",
    )
    cells = F.struct(F.col("doc_id").alias("of_id"), F.col("digest").alias("of_digest"), "size", "keys", *words_of)
    sets = scratch.save(
        marked.where("size > 0").groupBy("d0", "d1")
        .agg(F.min("doc_id").alias("least_id"), F.count("*").alias("_n"), F.min_by(cells, "digest").alias("_c"))
        .select("d0", "d1", "least_id", "_n", "_c.*", F.monotonically_increasing_id().alias("t")), "sets",
    )
    keys = sets.select("t", F.explode("keys").alias("key"))
    shared = scratch.save(keys.select("key").groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1").select("key"), "shared")
    members = scratch.save(filtered(keys, F.col("key"), shared, "key", BITMAP).join(shared, "key").select("key", "t"), "members")
    check = Verifier(scratch, sets.select("t", "size", *words_of), None, percent, most_ones(percent, bands * rows, bits), odd)
    # Full sets of those that have a candidate, from one document of each set.
    wanted = sets.join(members.select("t").distinct(), "t", "left_semi").select("t", "of_id", "of_digest")
    check.full = scratch.save(
        one_text(docs, wanted.select("t", "of_id", "of_digest")).select("t", _sets_of(words)("_text").alias("set")), "full"
    )
    label = components(scratch, links(scratch, check, members, turns), "components").withColumnRenamed("node", "t")
    joined = sets.select("d0", "d1", "t", "least_id", "_n").join(label, "t", "left").withColumn("label", F.coalesce("label", "t"))
    ids = joined.groupBy("label").agg(F.min("least_id").alias("component"))
    classes = scratch.save(
        joined.join(ids, "label").select(F.struct("d0", "d1").alias("_d"), "_n", "component", F.lit(True).alias("_in")), "classes"
    )
    rows_of = marked.select("doc_id", "size", F.struct("d0", "d1").alias("_d"))
    full = lookup(rows_of.where("size > 0"), classes, "_d", "_n", marked.count(), F.struct("doc_id"))
    out = full.select("doc_id", "size", "component").unionByName(
        rows_of.where("size = 0").select("doc_id", "size", F.col("doc_id").alias("component"))
    )
    return out.select(
        "doc_id", F.col("size").cast("bigint").alias("n_shingles"), F.col("component").alias("component_id"),
        F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"),
    )


SQL = """with recursive d as (select doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then []
    else list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' ')) end) x from d),
n as (select doc_id, count(*) n from s group by all),
p as (select a.doc_id a, b.doc_id b, count(*) both from s a join s b on a.x = b.x and a.doc_id <> b.doc_id group by all),
e as (select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100 * both >= 80 * (x.n + y.n - both)),
r as (select doc_id, doc_id other from d union select r.doc_id, e.b from r join e on e.a = r.other)
select d.doc_id, coalesce(n.n, 0)::bigint n_shingles, c.component_id, d.doc_id = c.component_id kept
from d left join n on n.doc_id = d.doc_id join (select doc_id, min(other) component_id from r group by all) c on c.doc_id = d.doc_id"""
