"""Alignment of two tokenizations of the same texts by interval coalescing.

Every token of both tokenizers is an interval of byte offsets in space+text.  All intervals of a text are sorted by
their start (``lexsort``); where a start reaches the running maximum of the ends so far (``maximum.accumulate``) both
tokenizers have ended a token, and a new group begins.  Within a group, overlaps of A and B tokens are expanded; the
overlaps whose ends agree are the links.

Links of two ids need one token to be a suffix of the other, so the vocabularies alone bound the pairs of ids that can
ever be linked (``Vocabularies.pairs``, some 100 000).  Corpus-wide counts are therefore arrays of a fixed length: each
partition counts its links with ``bincount``, Spark adds the counts, and the sums are broadcast for the second pass,
which reads the links that the first one has written and no text.

A long text is encoded in pieces cut before single spaces between two other characters.  The byte-level splitting
pattern always ends a token there, and so does a piece vocabulary in which no entry holds a word mark after another
character (checked on loading; other vocabularies get the whole text at once), so the tokens are those of the whole.

Defined results: a null or empty text, and one whose joined token bytes differ from space+text for either tokenizer
(e.g. one that holds the word mark itself), has no tokens, counts of zero and '' as its digest.  Repeated rows are
documents of their own and count as often as they occur; null ids are ids like any other; special strings within texts
are plain text; further columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptloom.llm.common import whole_text
from conceptloom.scratch import Scratch

#: Characters of a text that are encoded at once, and of texts that are handed to a library at once.
CHUNK = 1 << 18
_CUT = re.compile(r"(?<=\S) (?=\S)")
_MARK = "▁"
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
#: The printable characters that stand for themselves in byte-level vocabularies.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]


def default_a() -> str:
    """The byte-level BPE of 50 257 entries as ranks: the same ids as its .json form, in a third of the time."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_b() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class _Ranks:
    """Byte-level BPE given as ranks (.tiktoken)."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(k): int(v) for k, v in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = [b""] * (max(ranks.values()) + 1)
        for k, v in ranks.items():
            self.pieces[v] = k

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.encoding.encode_ordinary(t) for t in texts]

    def decode(self, ids: list[int]) -> bytes:
        return self.encoding.decode_bytes(ids)


class _Json:
    """Byte-level BPE as a tokenizers file (.json)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = True
        others = iter(range(256, 512))
        byte = {chr(b if b in _PLAIN else next(others)): b for b in range(256)}
        words = self.tokenizer.get_vocab()
        self.pieces = [b""] * (max(words.values()) + 1)
        for word, i in words.items():
            self.pieces[i] = bytes(map(byte.get, word)) if all(c in byte for c in word) else word.encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


class _Pieces:
    """Pieces with byte fallback (.model); the library adds the space in front."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.pieces = [
            bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(p)) else p.replace(_MARK, " ").encode() for p in names
        ]
        self.splittable = not any(_MARK in p.lstrip(_MARK) for p in names)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


def parts_of(text: str, size: int = CHUNK) -> list[str]:
    """The text cut before single spaces, at the first one after ``size`` characters of each part."""
    cuts, at = [0], 0
    while at + size < len(text) and (m := _CUT.search(text, at + size)):
        at = m.start()
        cuts.append(at)
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)]


class Vocabularies:
    """Both tokenizers, the lengths of their tokens, and all pairs of ids that can end together."""

    def __init__(self, path_a: str, path_b: str):
        self.a = _Json(path_a) if path_a.endswith(".json") else _Ranks(path_a)
        self.b = _Pieces(path_b)
        self.size = [np.array([len(p) for p in v.pieces], np.int64) for v in (self.a, self.b)]
        ids_a, ids_b = {}, {}
        for ids, v in ((ids_a, self.a), (ids_b, self.b)):
            for i, p in enumerate(v.pieces):
                ids.setdefault(p, []).append(i)
        pairs = set()
        for p, ids in ids_a.items():
            for k in range(len(p)):  # B tokens that end an A token, or equal it
                pairs.update((i, j) for j in ids_b.get(p[k:], ()) for i in ids)
        for p, ids in ids_b.items():
            for k in range(1, len(p)):
                pairs.update((i, j) for i in ids_a.get(p[k:], ()) for j in ids)
        both = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.width = len(self.b.pieces)
        self.pairs = both[:, 0] * self.width + both[:, 1]  # sorted codes
        # All of one width, filled up with zero bytes, so that those of a text are gathered at once.
        width = max(len(str(len(v.pieces))) for v in (self.a, self.b)) + 1
        self.names = [np.array([f"{i}{end}".encode() for end in ",|;" for i in range(len(v.pieces))], f"S{width}") for v in (self.a, self.b)]

    def encoded(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both tokenizers of each text, or None if a tokenizer doesn't give the bytes of space+text."""
        parts = [parts_of(t) if self.b.splittable else [t] for t in texts]
        flat = [p for ps in parts for p in ps]
        firsts = [k == 0 for ps in parts for k in range(len(ps))]
        got_a = iter(self.a.encode([" " + p if first else p for p, first in zip(flat, firsts, strict=True)]))
        got_b = iter(self.b.encode([p if first else p[1:] for p, first in zip(flat, firsts, strict=True)]))
        for text, ps in zip(texts, parts, strict=True):
            ids = []
            for vocabulary, got in ((self.a, got_a), (self.b, got_b)):
                ids.append([i for _ in ps for i in next(got)])
                if text and vocabulary.decode(ids[-1]) != b" " + text.encode("utf-8", "surrogatepass"):
                    text = ""
            yield (np.array(ids[0], np.int64), np.array(ids[1], np.int64)) if text else None


@lru_cache(maxsize=1)
def vocabularies(path_a: str, path_b: str) -> Vocabularies:
    return Vocabularies(path_a, path_b)


def coalesce(size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): A tokens, then B tokens, sorted by start with A first; the group of each in that order.

    ``size_a`` and ``size_b`` are the byte lengths of the tokens of one text.
    """
    ends = np.concatenate((np.cumsum(size_a), np.cumsum(size_b)))
    starts = ends - np.concatenate((size_a, size_b))
    side = np.repeat((0, 1), (len(size_a), len(size_b)))
    order = np.lexsort((side, starts))
    reach = np.maximum.accumulate(ends[order])
    group = np.zeros(len(order), np.int64)
    group[1:] = np.cumsum(starts[order][1:] >= reach[:-1])
    return order, group


def overlaps(size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): all A and B tokens whose byte ranges share a byte; they always lie within one group."""
    end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
    first = np.searchsorted(end_b, end_a - size_a, "right")
    last = np.searchsorted(end_b - size_b, end_a, "left")
    many = last - first
    i = np.repeat(np.arange(len(size_a)), many)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many) + first[i]


def groups_text(v: Vocabularies, ids_a: np.ndarray, ids_b: np.ndarray, order: np.ndarray, group: np.ndarray) -> str:
    """``a1,a2|b1;a3|b2,b3`` of a text's groups."""
    is_b = order >= len(ids_a)
    of_a, of_b = group[~is_b], group[is_b]  # both sides stay in order
    many_a, many_b = np.bincount(of_a, minlength=group[-1] + 1), np.bincount(of_b, minlength=group[-1] + 1)
    last_a, last_b = (np.append(x[1:] != x[:-1], True) for x in (of_a, of_b))
    texts = np.empty(len(order), v.names[0].dtype)  # within a group A tokens, then B tokens
    texts[np.arange(len(of_a)) + (np.cumsum(many_b) - many_b)[of_a]] = v.names[0][ids_a + last_a * len(v.a.pieces)]
    texts[np.arange(len(of_b)) + np.cumsum(many_a)[of_b]] = v.names[1][ids_b + last_b * 2 * len(v.b.pieces)]
    return texts.tobytes().translate(None, b"\0")[:-1].decode()


def align(v: Vocabularies, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[int, np.ndarray, str]:
    """Number of groups, links as places in ``v.pairs``, the groups as text."""
    size_a, size_b = v.size[0][ids_a], v.size[1][ids_b]
    order, group = coalesce(size_a, size_b)
    i, j = overlaps(size_a, size_b)
    linked = np.cumsum(size_a)[i] == np.cumsum(size_b)[j]
    code = ids_a[i[linked]] * v.width + ids_b[j[linked]]
    return int(group[-1]) + 1, np.searchsorted(v.pairs, code), groups_text(v, ids_a, ids_b, order, group)


_FIRST = pa.schema([
    ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string()),
    ("links", pa.binary()),
])


def _grouped(texts: list[str], size: int) -> Iterator[list[str]]:
    """Runs of texts of about ``size`` characters."""
    group, held = [], 0
    for t in texts:
        group.append(t)
        held += len(t)
        if held >= size:
            yield group
            group, held = [], 0
    if group:
        yield group


def _aligned(path_a: str, path_b: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabularies(path_a, path_b)
        for batch in batches:
            at = 0
            for texts in _grouped(batch.column(1).to_pylist(), CHUNK):
                rows = []
                for found in v.encoded(texts):
                    if found is None:
                        rows.append((0, 0, 0, "", b""))
                        continue
                    n, links, text = align(v, *found)
                    rows.append((len(found[0]), len(found[1]), n, hashlib.sha256(text.encode()).hexdigest(),
                                 links.astype(np.int32).tobytes()))
                columns = [batch.column(0).slice(at, len(rows)), *map(list, zip(*rows, strict=True))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, _FIRST, strict=True)], schema=_FIRST
                )
                at += len(rows)

    return run


def _counted(n_pairs: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_pairs, np.int64)
        for batch in batches:
            links = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32)
            total += np.bincount(links, minlength=n_pairs)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["pair", "n"])

    return run


def pair_counts(aligned: DataFrame, n_pairs: int) -> DataFrame:
    """(pair, n): links of each pair of ids over all documents; at most ``n_pairs`` rows."""
    parts = aligned.select("links").where("links <> X''").mapInArrow(_counted(n_pairs), "pair bigint, n bigint")
    return parts.groupBy("pair").agg(F.sum("n").alias("n"))


def alignment(spark: SparkSession, docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    path_a, path_b = path_a or default_a(), path_b or default_b()
    v, scratch = vocabularies(path_a, path_b), Scratch(spark, "alignment")
    schema = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, links binary"
    aligned = scratch.save(
        docs.select(F.col("doc_id").cast("bigint"), whole_text().alias("text")).mapInArrow(_aligned(path_a, path_b), schema), "aligned"
    )
    counts = np.zeros(len(v.pairs), np.int64)
    got = pair_counts(aligned, len(v.pairs)).toArrow()  # bounded by the vocabularies
    counts[got["pair"].to_numpy()] = got["n"].to_numpy()
    highest = np.zeros(v.width, np.int64)
    np.maximum.at(highest, v.pairs % v.width, counts)
    best = counts == highest[v.pairs % v.width]
    shared = spark.sparkContext.broadcast((counts, best))

    @F.pandas_udf("n_links bigint, n_best bigint, count_sum bigint")
    def summed(links):
        import pandas as pd

        count, top = shared.value
        rows = [(len(x), int(top[x].sum()), int(count[x].sum())) for x in (np.frombuffer(b, np.int32) for b in links)]
        return pd.DataFrame(rows, columns=["n_links", "n_best", "count_sum"])

    return aligned.withColumn("_s", summed("links")).select(
        "doc_id", "n_a", "n_b", "n_groups", "_s.n_links", "_s.n_best", "_s.count_sum", "groups_sha256"
    )
