"""Toxicity by compression distance.

Two zstandard dictionaries are trained, on ordinary and on toxic texts, and a window is the more toxic the fewer
bytes the toxic dictionary needs than the ordinary one, or than none (short words can be shorter without a
dictionary than with one of many far places).  A window is one lower-cased word, written ``REPEAT`` times:
zstandard's lengths are whole bytes and it only sees matches of some length, so a lone short word would be hidden in
the rounding.  The ordinary dictionary holds the words that most ordinary texts have; the toxic one the words that
far more toxic than ordinary texts have (in units of the standard error, and as a ratio), as zstandard's own trainer
would pick what both kinds of text share.  Statistics of a text's window differences are calibrated to a probability
by a logistic regression on labelled texts that the dictionaries haven't seen (in
folds).

Labels are learnt from at most ``SAMPLE`` texts of each label, chosen by a hash of the id; all else reads all rows
and whole texts.

Defined results: null, empty and wordless texts get the score of a text without toxic windows; every row is scored;
labels that are null, or of unknown ids, teach nothing; if one of the labels is missing all scores are the share of
the other (0 without any); further columns are kept by ``accepted`` and ignored by ``scores``; an empty table gives
an empty table.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptloom.llm.common import id_remainder, small_batches, whole_text
from conceptloom.scratch import Scratch

#: At most so many texts of each label are learnt from.
SAMPLE = 4000
FOLDS = 4
REPEAT = 4
LEVEL = 12
ORDINARY_BYTES, TOXIC_BYTES = 512 << 10, 16 << 10
#: A word of the toxic dictionary: how many standard errors, and how many times, more toxic than ordinary texts have it.
ERRORS, RATIO = 2.8, 10.0
#: Bytes saved from which a window counts as toxic, and as very toxic.
MARKED = (4, 6)
LONGEST = 64  # bytes of a word in one window
REMEMBERED = 1 << 18  # words whose difference a worker remembers
_LETTERS = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))


def words_of(text: str) -> set[bytes]:
    words = set(text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split())
    for w in [w for w in words if len(w) > LONGEST]:
        words.remove(w)
        words.update(w[i : i + LONGEST] for i in range(0, len(w), LONGEST))
    return words


def window(word: bytes) -> bytes:
    return (b" " + word) * REPEAT + b" "


def _filled(words, size: int) -> bytes:
    """The windows of the first words, the first of them last, where zstandard has the shortest way back."""
    out, held = [], 0
    for w in map(window, words):
        if held + len(w) > size:
            break
        out.append(w)
        held += len(w)
    return b"".join(reversed(out))


def dictionaries(ordinary: list[str], toxic: list[str]) -> tuple[bytes, bytes]:
    """Contents of the ordinary and the toxic dictionary."""
    of = Counter(w for t in ordinary for w in words_of(t))
    tf = Counter(w for t in toxic for w in words_of(t))
    n, m = max(len(ordinary), 1), max(len(toxic), 1)
    error = {w: (k / m - of[w] / n) / np.sqrt((of[w] + 1) / n / m + (k + 1) / m / m) for w, k in tf.items()}
    marked = sorted((w for w, k in tf.items() if error[w] > ERRORS and k * n > RATIO * (of[w] + 0.5) * m),
                    key=lambda w: (-error[w], w))
    return (_filled(sorted(of, key=lambda w: (-of[w], w)), ORDINARY_BYTES), _filled(marked, TOXIC_BYTES))


class Scorer:
    """Compression lengths under both dictionaries, and the calibrated score."""

    def __init__(self, contents: tuple[bytes, bytes], weights: np.ndarray | None = None, constant: float = 0.0):
        import zstandard

        self.weights, self.constant, self.known = weights, constant, {}
        form = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False
        )
        self.compress = []
        for content in (*contents, b""):
            if len(content) < 8:  # zstandard takes no shorter dictionary
                self.compress.append(zstandard.ZstdCompressor(compression_params=form).compress)
                continue
            kept = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            kept.precompute_compress(compression_params=form)
            self.compress.append(zstandard.ZstdCompressor(dict_data=kept, compression_params=form).compress)

    def saved(self, word: bytes) -> int:
        known = self.known.get(word)
        if known is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            w = window(word)
            ordinary, toxic, alone = (len(c(w)) for c in self.compress)
            known = self.known[word] = min(ordinary, alone) - toxic
        return known

    def features(self, text: str) -> list[float]:
        saved = np.array([self.saved(w) for w in words_of(text)] or [0])
        top = np.sort(saved)[-2:]
        return [top[-1], top.mean(), *[np.log1p((saved >= m).sum()) for m in MARKED], np.log1p(len(saved)), 1.0]

    def score(self, text: str) -> float:
        if self.weights is None:
            return self.constant
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.features(text), self.weights), -40, 40))))


def _regression(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression, by Newton steps on scaled features."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    mean[-1], scale = 0.0, np.where(scale > 1e-9, scale, 1.0)
    z, b = (x - mean) / scale, np.zeros(x.shape[1])
    keep = ridge * np.eye(len(b))
    keep[-1, -1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -40, 40)))
        step = np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + keep, z.T @ (w * (y - p)) - keep @ b)
        b = b + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    out = b / scale
    out[-1] -= (b[:-1] / scale[:-1] * mean[:-1]).sum()
    return out


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple:
    """(dictionaries, weights, constant), from labelled rows whose remainder isn't 0."""
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).where(id_remainder(5) != 0)
    count = {r.toxic: r.n for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = count.get(1, 0) / max(sum(count.values()), 1)
    if len(count) < 2:
        return None, None, share
    order = F.md5(F.col("doc_id").cast("string"))
    picked = [usable.where(F.col("toxic") == t).select("doc_id", "toxic", order.alias("_order")).orderBy("_order").limit(sample)
              for t in (0, 1)]  # at most 2 * sample ids
    chosen = picked[0].unionByName(picked[1]).groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.first("_order").alias("_order"))
    rows = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(chosen), "doc_id").orderBy("_order", "text").limit(
        2 * sample).select("text", "toxic").collect()
    text = lambda part, t: [r.text for r in part if r.toxic == t]
    x, y = [], []
    for k in range(FOLDS):  # features of each text by dictionaries that haven't seen it
        seen = [r for i, r in enumerate(rows) if i % FOLDS != k]
        scorer = Scorer(dictionaries(text(seen, 0), text(seen, 1)))
        x += [scorer.features(r.text) for r in rows[k::FOLDS]]
        y += [r.toxic for r in rows[k::FOLDS]]
    y = np.array(y, float)
    if len(set(y)) < 2:
        return None, None, share
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    return dictionaries(text(rows, 0), text(rows, 1)), _regression(np.array(x), y, weight), share


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Column:
    """The score of column ``text`` (not null), by a model learnt from ``docs`` and ``labels``."""
    shared = spark.sparkContext.broadcast(learn(spark, docs, labels, sample))  # half a MiB of dictionaries
    scorer: list[Scorer] = []

    @F.pandas_udf("double")
    def toxicity(texts: pd.Series) -> pd.Series:
        if not scorer:
            contents, weights, constant = shared.value
            scorer.append(Scorer(contents or (b"", b""), weights, constant))
        return pd.Series([scorer[0].score(t) for t in texts], dtype="float64")

    return toxicity(whole_text())


def scores(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    return docs.select("doc_id", (id_remainder(5) == 0).alias("held_out"), score(spark, docs, labels).alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )


def accepted(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that aren't predicted to be toxic, with all their columns."""
    with small_batches(spark):
        return Scratch(spark, "toxicity").save(docs.where(score(spark, docs, labels) < 0.5), "accepted")
