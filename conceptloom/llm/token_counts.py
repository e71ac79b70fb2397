"""Token counts of whole texts, huge ones by overlap resynchronisation.

A text of more than ``CHUNK`` characters is encoded in overlapping chunks with offsets.  The first chunk begins at
the text's begin, so its pre-token boundaries are those of the whole text, but for those near its end, where what
follows is not seen (``MARGIN``, more than the longest special string).  A later chunk begins anywhere and may read
its first characters wrongly.  Where both have a pre-token boundary at the same place the chunks are spliced: the
pre-tokeniser looks ahead only, so all that follows a true boundary is read as in the whole text.  If an overlap has
no such place (one endless word), the overlap is doubled, and the chunk with it once it fills half of it; at the
latest a chunk that holds the rest of the text ends the search.

Defined results: null and empty texts have 0 bytes and 0 tokens; every row is counted, repeated or not, whatever its
id; further columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conceptloom.llm.common import whole_text

CHUNK = 1 << 16
OVERLAP = 256
MARGIN = 64
#: Texts are handed to the library in groups of about so many characters: what it returns stays in the processor's cache.
GROUP = 1 << 16
LIMIT = 512


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def word_starts(encoding, base: int) -> dict[int, int]:
    """Place of each pre-token's begin in the text -> tokens before it."""
    out, last = {}, object()
    for k, (word, (begin, _)) in enumerate(zip(encoding.word_ids, encoding.offsets, strict=True)):
        if word != last or word is None:
            out.setdefault(base + begin, k)
        last = word
    return out


def spliced_count(text: str, encode: Callable, chunk: int = CHUNK, overlap: int = OVERLAP, margin: int = MARGIN) -> int:
    total, base, size, lap = 0, 0, chunk, overlap
    left = encode(text[:size])
    starts, counted = word_starts(left, 0), 0
    while base + size < len(text):
        begin = base + size - lap
        right = encode(text[begin : begin + chunk])
        new = word_starts(right, begin)
        at = min((p for p in new.keys() & starts.keys() if p <= base + size - margin and starts[p] >= counted), default=None)
        if at is None:
            lap *= 2
            if lap > size // 2:
                size *= 2
                left = encode(text[base : base + size])
                starts = word_starts(left, base)
            continue
        total += starts[at] - counted
        base, size, lap, left, starts, counted = begin, chunk, overlap, right, new, new[at]
    return total + len(left) - counted


def counts_of(tokenizer, texts: Iterable[str], chunk: int = CHUNK, overlap: int = OVERLAP, size: int = GROUP) -> list[int]:
    """Number of tokens of each text; the encodings only give their lengths, as lists of ids are made anew for each."""
    encode = lambda t: tokenizer.encode(t, add_special_tokens=False)
    out, group, held = [], [], 0

    def flush() -> None:
        nonlocal held
        out.extend(map(len, tokenizer.encode_batch_fast(group, add_special_tokens=False)))
        group.clear()
        held = 0

    for t in texts:
        if len(t) > chunk:
            flush()
            out.append(spliced_count(t, encode, chunk, overlap))
            continue
        if held and held + len(t) > size:
            flush()
        group.append(t)
        held += len(t)
    flush()
    return out


def token_count(path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Callable[[Column], Column]:
    """A column function: number of tokens, for the library's tokenizer file at ``path``."""

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs a worker per core
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()

        for texts in batches:
            yield pd.Series(counts_of(tokenizer, texts, chunk, overlap), dtype="int64")

    return count


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row."""
    count = token_count(path or default_tokenizer())
    return docs.select(
        "doc_id", F.octet_length(whole_text()).cast("bigint").alias("n_bytes"), count(whole_text()).alias("n_tokens")
    ).withColumn("over_limit", F.col("n_tokens") > limit)
