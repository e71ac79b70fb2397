"""Bitmaps of fixed size over 64-bit hashes, built by Spark and broadcast: what isn't in one is certainly not in the table.

The size doesn't depend on the number of hashes.  A fuller bitmap lets more rows through, never fewer.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_bitmap(bitmap: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    """Whether each of the hashes (unsigned) may be in the table that the bitmap of 2 ** bits places was made of."""
    cell = (h >> np.uint64(64 - bits)).astype(np.int64)
    return (bitmap[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1


def _words_of(hashes: DataFrame, column: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of 64 places that have any, in order, and their places; they are or-ed by one aggregate of Spark."""
    cell = f"shiftrightunsigned({column}, {64 - bits})"
    words = hashes.select(
        F.expr(f"shiftright({cell}, 6)").alias("word"), F.expr(f"shiftleft(1L, cast({cell} & 63 as int))").alias("place")
    ).groupBy("word").agg(F.bit_or("place").alias("places")).toArrow()  # at most 2 ** (bits - 6) rows
    word, places = words["word"].to_numpy(), words["places"].to_numpy()
    order = np.argsort(word)
    return word[order], places[order].view(np.uint64)


def _whole(word: np.ndarray, places: np.ndarray, bits: int) -> bytes:
    whole = np.zeros(1 << (bits - 6), np.uint64)
    whole[word] = places
    return whole.astype("<u8").tobytes()


def bitmap_of(hashes: DataFrame, column: str, bits: int) -> bytes:
    """The bitmap of a BIGINT column by its leading bits."""
    return _whole(*_words_of(hashes, column, bits), bits)


def short_bitmap_of(hashes: DataFrame, column: str, bits: int) -> bytes | tuple[np.ndarray, np.ndarray]:
    """The same bitmap; if most of its words are empty, only the others and their places, which takes a fraction of it."""
    word, places = _words_of(hashes, column, bits)
    return (word, places) if len(word) * 8 < 1 << (bits - 6) else _whole(word, places, bits)


def in_words(words: tuple[np.ndarray, np.ndarray], h: np.ndarray, bits: int) -> np.ndarray:
    """The same test as ``in_bitmap`` by the words that have places."""
    word, places = words
    if not len(word):
        return np.zeros(len(h), bool)
    cell = (h >> np.uint64(64 - bits)).astype(np.int64)
    at = np.searchsorted(word, cell >> 6)
    at[at == len(word)] = 0
    return (word[at] == cell >> 6) & ((places[at] >> (cell & 63).astype(np.uint64)) & np.uint64(1) == 1)


def may_be_in(shared, bits: int):
    """A column function over BIGINT hashes for a broadcast bitmap, short or not."""

    @F.pandas_udf("boolean")
    def test(h):
        import pandas as pd

        h, bitmap = h.to_numpy().view(np.uint64), shared.value
        return pd.Series(in_words(bitmap, h, bits) if isinstance(bitmap, tuple) else in_bitmap(np.frombuffer(bitmap, np.uint8), h, bits))

    return test


def filtered(df: DataFrame, column: Column, hashes: DataFrame, hash_column: str, bits: int) -> DataFrame:
    """``df`` without rows whose hash ``column`` is certainly not among ``hashes``."""
    shared = df.sparkSession.sparkContext.broadcast(short_bitmap_of(hashes, hash_column, bits))
    return df.where(may_be_in(shared, bits)(column))
