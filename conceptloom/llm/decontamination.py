"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact verification.

Texts are lower-cased and cut to words (runs of ASCII letters, digits, underscores and of all characters beyond ASCII);
shingles are five words.  For each
benchmark item, windows of the item's number of words slide over the text.  A window that shares no shingle with an
item has similarity 0 to it, so only windows around a shared shingle are fingerprinted, which loses nothing.  A
window's 64-bit SimHash is looked up in four 16-bit blocks: a fingerprint within ``RADIUS`` bits has at least one
block within RADIUS / 4 bits, so all of them are found; each is then verified by the exact weighted Jaccard
similarity of shingles (weights: how often each occurs).  A similarity of 0.8 means about 10 differing bits on
average with a standard deviation below 3; the radius of 19 leaves out about one in 3000 such windows, of the many
that overlap a passage.

The benchmark is read in blocks of at most ``BLOCK_BYTES`` of text (one block, as a rule); each is broadcast and one
pass over the documents is made per block.

Defined results: null and empty texts and items match nothing; an item or text of fewer than five words is one
shingle of all its words; a text shorter than an item is one window; equal items are all reported, a repeated
document once per row; null ids are carried; further columns are kept by ``clean`` and ignored by ``matches``; an
empty table on either side gives no matches.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptloom.llm.common import whole_text

SHINGLE = 5
SIMILARITY = 0.8
BITS, BLOCKS, RADIUS = 64, 4, 19
BLOCK_BYTES = 64 << 20
_FOUND = "array<struct<item_id: bigint, similarity: double, start: bigint, n_words: bigint>>"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_CLEAN = bytes(b if b > 127 or chr(b).isalnum() or b == 95 else 32 for b in range(256))
_PIECE = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Text:
    """The words of a text, as spans of its bytes, with a hash of each."""

    powers = inverses = np.zeros(0, np.uint64)

    def __init__(self, text: str, clean: bytes = _CLEAN):
        self.raw = text.lower().encode("utf-8", "surrogatepass").translate(clean)
        begins, ends, hashes, at = [], [], [], 0
        while at < len(self.raw):
            cut = self.raw.find(b" ", min(at + _PIECE, len(self.raw)))  # pieces end between words
            cut = cut if cut >= 0 else len(self.raw)
            piece = np.frombuffer(self.raw, np.uint8, cut - at, at)
            inside = np.zeros(len(piece) + 2, np.int8)
            inside[1:-1] = piece != 32
            edges = np.flatnonzero(np.diff(inside))
            begin, end = edges[::2], edges[1::2]
            if len(piece) >= len(Text.powers):
                n = max(len(piece) + 1, 1 << 14)
                Text.powers, Text.inverses = _powers(int(_MIX), n), _powers(pow(int(_MIX), -1, 1 << 64), n)
            sums = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(piece * Text.powers[: len(piece)], out=sums[1:])
            h = (sums[end] - sums[begin]) * Text.inverses[begin]
            hashes.append((h ^ (h >> np.uint64(31))) * _MIX)
            begins.append(begin + at)
            ends.append(end + at)
            at = cut
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.begin, self.end, self.hashes = join(begins, np.int64), join(ends, np.int64), join(hashes, np.uint64)

    def __len__(self) -> int:
        return len(self.begin)

    def words(self, lo: int = 0, hi: int | None = None) -> list[str]:
        spans = zip(self.begin[lo:hi].tolist(), self.end[lo:hi].tolist(), strict=True)
        return [self.raw[a:b].decode("utf-8", "surrogatepass") for a, b in spans]


def words_of(text: str) -> list[str]:
    return Text(text).words()


def shingles_of(words: list[str], k: int = SHINGLE) -> list[str]:
    if not words:
        return []
    k = min(k, len(words))
    return [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity."""
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both) if a or b else 0.0


def _rolled(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words, from those of the words; it only finds places to look at."""
    n = max(len(h) - k + 1, 0)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _MIX + h[j : j + n]
    return out ^ (out >> np.uint64(29))


def _bits(shingles: list[str]) -> np.ndarray:
    """A row of +1 / -1 for each shingle."""
    import xxhash

    h = np.array([xxhash.xxh64_intdigest(s) for s in shingles], ">u8")
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1


def _packed(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1).view(">u8").ravel().astype(np.uint64)


class Index:
    """The items of one block: their shingles, and fingerprints by 16-bit blocks."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        texts = [Text(t) for _, t in items]
        self.words = [t.words() for t in texts]
        self.weights = [Counter(shingles_of(w)) for w in self.words]
        self.prints = np.zeros(len(items), np.uint64)
        by_hash = defaultdict(set)
        for j, w in enumerate(self.words):
            if w:
                self.prints[j] = _packed(_bits(shingles_of(w)).sum(axis=0)[None, :])[0]
                for h in _rolled(texts[j].hashes, min(SHINGLE, len(w))).tolist():
                    by_hash[min(SHINGLE, len(w)), h].add(j)
        self.sizes = sorted({k for k, _ in by_hash})
        self.by_hash = by_hash
        hashes = {k: np.array([h for n, h in by_hash if n == k], np.uint64) for k in self.sizes}
        self.tables = {k: np.bincount((h >> np.uint64(44)).astype(np.int64), minlength=1 << 20) > 0 for k, h in hashes.items()}
        parts = self.prints[:, None] >> np.arange(0, BITS, BITS // BLOCKS, dtype=np.uint64) & np.uint64(0xFFFF)
        self.parts = [np.unique(parts[:, b], return_inverse=True) for b in range(BLOCKS)]
        self.near: dict[tuple[int, int], frozenset[int]] = {}

    def within(self, print_: int) -> set[int]:
        """All items whose fingerprint differs in at most RADIUS bits."""
        found: set[int] = set()
        for b, (values, of) in enumerate(self.parts):
            key = b, print_ >> b * (BITS // BLOCKS) & 0xFFFF
            if key not in self.near:
                close = np.bitwise_count(values ^ np.uint64(key[1])) <= RADIUS // BLOCKS
                self.near[key] = frozenset(np.flatnonzero(close[of]).tolist())
            found |= self.near[key]
        if not found:
            return found
        who = np.array(sorted(found))
        return set(who[np.bitwise_count(self.prints[who] ^ np.uint64(print_)) <= RADIUS].tolist())

    def anchors(self, text: Text) -> dict[int, list[int]]:
        """Item -> places of shingles that it has too."""
        out = defaultdict(list)
        for k in self.sizes:
            h = _rolled(text.hashes, k)
            at = np.flatnonzero(self.tables[k][(h >> np.uint64(44)).astype(np.int64)])
            for p, x in zip(at.tolist(), h[at].tolist(), strict=True):
                for j in self.by_hash.get((k, x), ()):
                    out[j].append(p)
        return out

    def search(self, text: str, least: float = SIMILARITY) -> list[tuple[int, float, int, int]]:
        words, out = Text(text), []
        by_size = defaultdict(dict)  # places of windows by their number of words, for all items of that size
        for j, places in self.anchors(words).items():
            n = min(len(self.words[j]), len(words))
            last = len(words) - n
            starts = {s for p in places for s in range(max(0, p - n + 1), min(p, last) + 1)}
            for s in starts:
                by_size[n].setdefault(s, set()).add(j)
        best: dict[int, tuple[float, int, int]] = {}
        for n, windows in by_size.items():
            k = min(SHINGLE, n)
            starts = sorted(windows)
            for run in np.split(np.array(starts), np.flatnonzero(np.diff(starts) > n) + 1):
                lo, hi = int(run[0]), int(run[-1]) + n
                near = shingles_of(words.words(lo, hi), k)
                sums = np.concatenate([np.zeros((1, BITS), np.int32), _bits(near).cumsum(axis=0, dtype=np.int32)])
                at = run - lo
                for s, print_ in zip(run.tolist(), _packed(sums[at + n - k + 1] - sums[at]).tolist(), strict=True):
                    for j in self.within(print_) & windows[s]:
                        x = similarity(Counter(near[s - lo : s - lo + n - k + 1]), self.weights[j])
                        if x >= least and x > best.get(j, (0.0,))[0]:
                            best[j] = x, s, n
        for j, (x, s, n) in sorted(best.items()):
            out.append((self.ids[j], x, s, n))
        return out


def finders(spark: SparkSession, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> list:
    """Column functions, one per block of the benchmark: text -> array of (item_id, similarity, start, n_words)."""
    items = benchmark.select("item_id", whole_text().alias("text")).where("text <> ''")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = -(-size // block_bytes)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(n, 1)))
    out = []
    for k in range(n):
        block = [(r.item_id, r.text) for r in items.where(part == k).collect()]  # about block_bytes of text
        shared = spark.sparkContext.broadcast(sorted(block, key=lambda r: (r[0] is not None, r[0], r[1])))
        out.append(_finder(shared))
    return out


def _finder(shared):
    index: list[Index] = []

    @F.pandas_udf(_FOUND)
    def find(texts: pd.Series) -> pd.Series:
        if not index:
            index.append(Index(shared.value))
        keys = ("item_id", "similarity", "start", "n_words")
        return pd.Series([[dict(zip(keys, m, strict=True)) for m in index[0].search(t)] for t in texts], dtype=object)

    return find


def found(find: list) -> Column:
    """All matches of a text, over the blocks of the benchmark."""
    empty = F.array().cast(_FOUND)
    return reduce(lambda a, b: F.concat(a, b), [f(whole_text()) for f in find], empty) if find else empty


def matches(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, start (word), n_words: the best window of each document and item it contains."""
    find = finders(spark, benchmark)
    return docs.select("doc_id", F.explode(found(find)).alias("_m")).select("doc_id", "_m.*")


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a benchmark item, with all their columns."""
    return docs.where(F.size(found(finders(spark, benchmark))) == 0)
