"""Language identification by a byte convolutional network.

The lower-cased UTF-8 bytes of a text are cut into windows of ``WINDOW`` bytes.  Filters of several widths run over
the bytes of a window (a filter is a table of a weight per byte at each of its places, that is a convolution of
one-hot bytes), the largest response of each filter goes through a rectifier to a softmax layer.  A text's
distribution is the mean of its windows', weighted by their bytes.  The network is trained in numpy by Adam, on
windows of at most ``SAMPLE`` texts of each language; all else reads all rows and whole texts.

Defined results: ``und`` with score 0 for null texts and texts without a letter, or if nothing could be learnt; rows
with a null language teach nothing; every row is classified; further columns are ignored; an empty table gives an
empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptloom.llm.common import id_remainder, small_batches, whole_text
from conceptloom.scratch import Scratch

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
#: At most so many texts of each language, and windows of each text, are learnt from.
SAMPLE, WINDOWS = 1000, 3
EPOCHS, BATCH, RATE = 6, 64, 0.01
UNDETERMINED = "und"
_AT_ONCE = 64  # windows


def windows_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(windows x WINDOW bytes, padded with zeros; bytes of text in each)."""
    raw = text.lower().encode("utf-8", "surrogatepass")
    n = max(1, -(-len(raw) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    used = np.full(n, WINDOW)
    used[-1] = len(raw) - (n - 1) * WINDOW
    return out.reshape(n, WINDOW), used


class Network:
    def __init__(self, classes: int, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.filters = [draw.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.layer = draw.normal(0, 0.1, (FILTERS * len(WIDTHS), classes)).astype(np.float32)
        self.bias = np.zeros(classes, np.float32)

    def pooled(self, x: np.ndarray, places: bool = False):
        """Largest response of every filter (and where it is)."""
        most, where = [], []
        for w, table in zip(WIDTHS, self.filters, strict=True):
            response = table[0][x[:, : WINDOW - w + 1]]
            for j in range(1, w):
                response += table[j][x[:, j : WINDOW - w + 1 + j]]
            most.append(response.max(axis=1))
            if places:
                where.append(response.argmax(axis=1))
        return np.concatenate(most, axis=1), where

    def probabilities(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled, 0) @ self.layer + self.bias
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def predict(self, x: np.ndarray) -> np.ndarray:
        parts = [self.probabilities(self.pooled(x[i : i + _AT_ONCE])[0]) for i in range(0, len(x), _AT_ONCE)]
        return np.concatenate(parts)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        pooled, where = self.pooled(x, places=True)
        d = self.probabilities(pooled)
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        back = (d @ self.layer.T) * (pooled > 0)
        out = [np.maximum(pooled, 0).T @ d, d.sum(axis=0)]
        rows, filters = np.arange(len(x))[:, None], np.arange(FILTERS)[None, :]
        for k, (w, at) in enumerate(zip(WIDTHS, where, strict=True)):
            grad, part = np.zeros_like(self.filters[k]), back[:, k * FILTERS : (k + 1) * FILTERS]
            for j in range(w):
                np.add.at(grad[j], (x[rows, at + j], np.broadcast_to(filters, at.shape)), part)
            out.append(grad)
        return out

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Network:
        draw, values = np.random.default_rng(seed), [self.layer, self.bias, *self.filters]
        first, second, step = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
        for _ in range(epochs):
            order = draw.permutation(len(x))
            for i in range(0, len(x), BATCH):
                step += 1
                part = order[i : i + BATCH]
                for v, m, s, g in zip(values, first, second, self.gradients(x[part], y[part]), strict=True):
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    v -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        return self


def learn(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], Network | None]:
    """Languages and network, from rows with a language whose remainder isn't 2."""
    usable = docs.where(F.col("lang").isNotNull() & (id_remainder(4) != 2))
    count = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(count)
    if not langs:
        return [], None
    # The smallest hashes of each language, as a threshold from its count; a table of one row per language.
    draw = F.pmod(F.xxhash64(F.lit(1), "doc_id", "text"), F.lit(1 << 40)).cast("double") / F.lit(float(1 << 40))
    share = F.coalesce(*[F.when(F.col("lang") == x, F.lit(sample / n)) for x, n in count.items()])
    rows = usable.where(draw < share).select("lang", whole_text().alias("text"), draw.alias("_d")).orderBy("_d", "text").limit(
        2 * sample * len(langs)).select("lang", "text").collect()
    x, y = [], []
    for r in rows:
        w, used = windows_of(r.text)
        w = w[used >= WINDOW // 8]
        x.append(w[np.linspace(0, len(w) - 1, min(WINDOWS, len(w))).astype(int)])
        y += [langs.index(r.lang)] * len(x[-1])
    if not y:
        return [], None
    return langs, Network(len(langs)).train(np.concatenate(x), np.array(y))


def identify(text: str, langs: list[str], net: Network | None) -> tuple[str, float]:
    if net is None or not any(map(str.isalpha, text)):
        return UNDETERMINED, 0.0
    x, used = windows_of(text)
    p = used @ net.predict(x) / used.sum()
    return langs[int(p.argmax())], float(min(p.max(), 1.0))


def language(spark: SparkSession, docs: DataFrame) -> Column:
    """Struct (lang_pred, score) of column ``text``."""
    shared = spark.sparkContext.broadcast(learn(docs))  # about 30,000 weights

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([identify(t, *shared.value) for t in texts], columns=["lang_pred", "score"])

    return predict(whole_text())


def languages(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; written here, as texts go to Python in batches of bounded bytes."""
    found = docs.select("doc_id", (id_remainder(4) == 2).alias("held_out"), language(spark, docs).alias("_p")).select(
        "doc_id", "held_out", "_p.lang_pred", "_p.score"
    )
    with small_batches(spark):
        return Scratch(spark, "language").save(found, "predicted")
