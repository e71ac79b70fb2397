"""Exact duplicates by counting quotient filters.

A text's fingerprint is 52 bits of a 64-bit hash.  Each partition holds its fingerprints as counting quotient
filter blocks: the block and quotient are the leading bits, the sorted remainders carry counts.  Blocks of all
partitions meet by block number and merge without loss, as equal remainders add their counts.  Texts whose
fingerprint has a count above one go on to byte verification: they are grouped by the text itself, so a clash of
fingerprints joins nothing.

Defined results: null and empty texts are equal; a null id is smaller than any other; of rows with equal text and
the same largest id, one is kept; an empty table gives an empty table; other columns are carried by ``survivors``
and ignored by ``classes``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from conceptloom.llm.common import ascii_lower, lookup, spare, whole_text
from conceptloom.scratch import Scratch

BITS = 52
REMAINDER = 32
BLOCK = 12  # leading bits of the quotient: the number of blocks that merge on their own is 2 ** BLOCK
#: Bits of the sketch that says which texts may need byte verification (8 MiB, at any size of the input).
SKETCH = 26
_SLOTS = "block int, quotients binary, remainders binary, counts binary"


def fingerprint(text):
    return F.shiftrightunsigned(F.xxhash64(text), 64 - BITS)


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, int)
    return key[first], (np.add.reduceat(count, first) if len(key) else count)


def _filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of one partition's filter."""
    key, count = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    for batch in batches:
        new = batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint64)
        key, count = _merge([key, new], [count, np.ones(len(new), np.uint32)])
    block = key >> np.uint64(BITS - BLOCK)
    edges = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1], [True]))) if len(key) else [0]
    quotient = ((key >> np.uint64(REMAINDER)) & np.uint64((1 << BITS - BLOCK - REMAINDER) - 1)).astype(np.uint8)
    remainder = (key & np.uint64((1 << REMAINDER) - 1)).astype(np.uint32)
    spans = list(zip(edges[:-1], edges[1:], strict=True))
    yield pa.RecordBatch.from_arrays(
        [pa.array([int(block[a]) for a, _ in spans], pa.int32())]
        + [pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()) for x in (quotient, remainder, count.astype(np.uint32))],
        names=["block", "quotients", "remainders", "counts"],
    )


def _merged(group: pa.Table) -> pa.Table:
    """One block of the merged filter: its fingerprints with a count above one."""
    block = np.uint64(group["block"][0].as_py())
    cells = {c: [x.as_py() for x in group[c]] for c in ("quotients", "remainders", "counts")}
    quotient = np.frombuffer(b"".join(cells["quotients"]), np.uint8).astype(np.uint64)
    remainder = np.frombuffer(b"".join(cells["remainders"]), np.uint32).astype(np.uint64)
    key = (block << np.uint64(BITS - BLOCK)) | (quotient << np.uint64(REMAINDER)) | remainder
    key, count = _merge([key], [np.frombuffer(b"".join(cells["counts"]), np.uint32).astype(np.int64)])
    many = count > 1
    return pa.table({"fp": key[many].astype(np.int64), "n": count[many]})


def repeated_fingerprints(fingerprints: DataFrame) -> DataFrame:
    """(fp, n) of the fingerprints that more than one row has."""
    blocks = fingerprints.select("fp").mapInArrow(_filters, _SLOTS)
    return blocks.groupBy("block").applyInArrow(_merged, "fp bigint, n bigint")


def _sketch(repeated: DataFrame) -> bytes:
    """A bitmap over the leading bits of the repeated fingerprints; its size doesn't depend on their number."""
    pieces = 1 << 10

    def draw(group: pa.Table) -> pa.Table:
        cell = group["cell"].to_numpy()
        bits = np.zeros((1 << SKETCH) // pieces, np.uint8)
        bits[cell & (len(bits) - 1)] = 1
        return pa.table({"piece": [int(cell[0] // len(bits))], "bits": [np.packbits(bits).tobytes()]})

    cells = repeated.select(F.shiftrightunsigned("fp", BITS - SKETCH).cast("int").alias("cell")).distinct()
    per = (1 << SKETCH) // pieces
    rows = cells.withColumn("piece", (F.col("cell") / per).cast("bigint")).groupBy("piece").applyInArrow(
        draw, "piece bigint, bits binary"
    )
    whole = bytearray((1 << SKETCH) // 8)
    for r in rows.toLocalIterator():  # 2 ** 10 rows of 8 KiB at most
        whole[r.piece * per // 8 : (r.piece + 1) * per // 8] = r.bits
    return bytes(whole)


def _may_repeat(spark: SparkSession, repeated: DataFrame):
    shared = spark.sparkContext.broadcast(_sketch(repeated))

    @F.pandas_udf("boolean")
    def may_repeat(fp):
        import pandas as pd

        cell = fp.to_numpy().astype(np.int64) >> (BITS - SKETCH)
        bitmap = np.frombuffer(shared.value, np.uint8)
        return pd.Series((bitmap[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1)

    return may_repeat


def _digests(scratch: Scratch, docs: DataFrame) -> DataFrame:
    norm = ascii_lower(whole_text())
    return scratch.save(
        docs.select("doc_id", norm.alias("norm")).select(
            "doc_id", fingerprint(F.col("norm")).alias("fp"), F.sha2("norm", 256).alias("text_sha256")
        ), "digests",
    )


def _suspects(spark: SparkSession, docs: DataFrame, repeated: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """(rows whose fingerprint may be repeated, the other rows, name of the added column of normalised text)."""
    may_repeat, norm, fp = _may_repeat(spark, repeated), spare(docs, "_norm"), spare(docs, "_fp")
    marked = docs.withColumn(norm, ascii_lower(whole_text())).withColumn(fp, fingerprint(F.col(norm)))
    return marked.where(may_repeat(fp)), marked.where(~may_repeat(fp)), norm


def classes(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    docs, scratch = docs.select("doc_id", "text"), Scratch(spark, "exact-dedup")
    digests = _digests(scratch, docs)
    repeated = scratch.save(repeated_fingerprints(digests), "repeated")
    suspects, _, _ = _suspects(spark, docs, repeated)
    verified = scratch.save(
        suspects.groupBy("_norm").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .where("group_size > 1").select(F.sha2("_norm", 256).alias("text_sha256"), "keep_id", "group_size",
                                        F.col("group_size").alias("_n")), "verified",
    )
    found = lookup(digests, verified.withColumn("_found", F.lit(True)), "text_sha256", "_n", digests.count(),
                   F.struct("doc_id"))
    single = F.col("_found").isNull()
    same = Window.partitionBy("text_sha256", "doc_id").orderBy("fp")
    return found.select(
        "doc_id", F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"), "text_sha256", "fp",
    ).select(
        "doc_id", "keep_id", "group_size",
        ((F.row_number().over(same) == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), "text_sha256",
    )


def survivors(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns: of equal texts, the one with the largest id."""
    columns, scratch = docs.columns, Scratch(spark, "exact-dedup")
    repeated = scratch.save(
        repeated_fingerprints(docs.select(fingerprint(ascii_lower(whole_text())).alias("fp"))), "repeated"
    )
    suspects, others, norm = _suspects(spark, docs, repeated)
    # The row as a value, not as the order: its columns may be of types without one.
    best = suspects.groupBy(norm).agg(
        F.max_by(F.struct(*[F.col(c) for c in columns]), F.struct("doc_id", "text")).alias(spare(suspects, "_best"))
    )
    return best.select(f"{best.columns[-1]}.*").unionByName(others.select(*columns))


SQL = """with d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t
  from documents)
select doc_id, max(doc_id) over (partition by t) keep_id, count(*) over (partition by t) group_size,
  row_number() over (partition by t order by doc_id desc nulls last) = 1 kept, sha256(t) text_sha256 from d"""
