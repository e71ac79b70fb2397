"""Formal contexts from delimited text files.

First line: an empty cell, then the attribute names.  Every further line: the
object's name, then one 0/1 cell per attribute.  Cells may be quoted.
"""

from __future__ import annotations

import csv
import io

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conceptloom.functions import masks as M
from conceptloom.operators.context import MAX_ATTRIBUTES, Context

# Cell texts read as set and as not set.
TRUE_CELLS = ("1", "1.0", "true", "True", "TRUE", "x", "X")
FALSE_CELLS = ("0", "0.0", "false", "False", "FALSE", "", "-")
DELIMITERS = (";", ",", "\t")


class ContextFormatError(ValueError):
    """The file is not a formal context."""


def sniff_delimiter(header: str, tie: str = ",") -> str:
    """The delimiter that occurs most often outside quotes in the header line."""
    counts, quoted = dict.fromkeys(DELIMITERS, 0), False
    for ch in header:
        if ch == '"':
            quoted = not quoted
        elif not quoted and ch in counts:
            counts[ch] += 1
    most = max(counts.values())
    best = [d for d in DELIMITERS if counts[d] == most]
    return tie if tie in best else best[0]


def sniff_file_delimiter(spark: SparkSession, path: str, tie: str = ",") -> str:
    """The delimiter that occurs most often in the whole file."""
    lines = spark.read.text(path)
    counts = lines.agg(*[
        F.sum(F.length("value") - F.length(F.replace("value", F.lit(d)))).alias(f"c{i}")
        for i, d in enumerate(DELIMITERS)
    ]).first()
    got = {d: counts[f"c{i}"] or 0 for i, d in enumerate(DELIMITERS)}
    best = [d for d in DELIMITERS if got[d] == max(got.values())]
    return tie if tie in best else best[0]


def read_header(spark: SparkSession, path: str, delimiter: str | None) -> tuple[list[str], str]:
    """Header cells (trimmed, unquoted, without byte order mark) and delimiter."""
    first = spark.read.text(path).first()
    if first is None:
        raise ContextFormatError(f"{path} is empty")
    line = first.value.lstrip("\ufeff").rstrip("\r")
    delimiter = delimiter or sniff_delimiter(line)
    cells = next(csv.reader(io.StringIO(line), delimiter=delimiter), [])
    return [c.strip() for c in cells], delimiter


def read_context(
    spark: SparkSession,
    path: str,
    delimiter: str | None = None,
    mode: str = "strict",
    allow_no_attributes: bool = False,
) -> Context:
    """Read a context file; objects are numbered in file order.

    ``delimiter``: given, or by default the more frequent one of the header line;
    ``"whole-file"`` counts the whole file.  ``mode``:

    ``strict``   every line as wide as the header, cells exactly 0 or 1, object
                 and attribute names present, first header cell empty, no object
                 name twice;
    ``boolean``  as strict, with the usual spellings of true and false;
    ``lenient``  a cell is set if it is 1, short lines are filled with 0, long
                 ones cut, blank lines skipped, blank object names numbered.
    """
    if mode not in ("strict", "boolean", "lenient"):
        raise ValueError(f"unknown mode {mode!r}")
    if delimiter == "whole-file":
        delimiter = sniff_file_delimiter(spark, path)
    header, delimiter = read_header(spark, path, delimiter)
    attributes = header[1:]
    if mode != "lenient":
        if not attributes and not allow_no_attributes:
            raise ContextFormatError("no attributes: wrong delimiter?")
        if header[:1] != [""]:
            raise ContextFormatError("the first header cell must be empty")
        if any(not a for a in attributes):
            raise ContextFormatError("an attribute has no name")
        if len(set(attributes)) != len(attributes):
            raise ContextFormatError("an attribute name occurs twice")
    if len(attributes) > MAX_ATTRIBUTES:
        raise ContextFormatError(f"more than {MAX_ATTRIBUTES} attributes")

    cell_names = [f"c{j}" for j in range(len(attributes))]
    schema = T.StructType(
        [T.StructField(c, T.StringType()) for c in ["name", *cell_names, "_bad"]]
    )
    raw = (
        spark.read.schema(schema)
        .option("sep", delimiter).option("header", True).option("enforceSchema", True)
        .option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_bad")
        .option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
        .option("nullValue", "\u0000").option("emptyValue", "")
        .csv(path)
        .select(
            "*",
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
        )
    )
    name = F.trim(F.coalesce("name", F.lit("")))
    if mode == "lenient":
        blank = (name == "") & F.forall(
            F.array(F.lit(None).cast("string"), *cell_names), lambda c: F.coalesce(c, F.lit("")) == ""
        )
        raw = raw.where(~blank)
    # Lines are numbered after the blank ones are gone, as they are counted per split then.
    numbered = _number_lines(raw.withColumn("_at", F.monotonically_increasing_id()))
    cells = [_cell(F.col(c), mode) for c in cell_names]
    masks = _to_words(cells, M.word_count(len(attributes)))
    if mode == "lenient":
        label = F.when(name == "", F.concat(F.lit("obj_"), F.col("obj_id"))).otherwise(name)
    else:
        label = (
            F.when(F.col("_bad").isNotNull(), _fail("line of another width than the header: ", F.col("_bad")))
            .when(name == "", _fail("an object has no name, line ", F.col("obj_id") + 1))
            .otherwise(name)
        )
    objects = numbered.select("obj_id", label.alias("name"), *M.rename(masks, "m"))
    context = Context(objects, tuple(attributes))
    if mode != "lenient":
        _check_objects(context)
    return context


def _fail(text: str, detail: Column) -> Column:
    return F.raise_error(F.concat(F.lit(text), detail.cast("string"))).cast("string")


def _cell(c: Column, mode: str) -> Column:
    text = F.trim(F.coalesce(c, F.lit("")))
    if mode == "lenient":
        return text == "1"
    true, false = (("1",), ("0",)) if mode == "strict" else (TRUE_CELLS, FALSE_CELLS)
    return F.when(text.isin(*true), True).when(text.isin(*false), False).otherwise(
        _fail("not a 0/1 cell: ", text).cast("boolean")
    )


def _to_words(cells: list[Column], k: int) -> list[Column]:
    """Set bit j where cell j is true: no shuffle, one pass over the line."""
    out = []
    for i in range(k):
        word = F.lit(0).cast("bigint")
        for b, cell in enumerate(cells[i * M.WORD_BITS:(i + 1) * M.WORD_BITS]):
            word = word + F.when(cell, F.lit(1 << b).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
        out.append(word)
    return out


def _number_lines(raw: DataFrame) -> DataFrame:
    """Add ``obj_id`` = 0, 1, ... in file order: one count per file split."""
    split = ["_file", "_block"]
    sizes = raw.groupBy(*split).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first")
    )
    before = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*split, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    # one row per file split
    return raw.join(F.broadcast(starts), split).withColumn(
        "obj_id", F.col("_start") + F.col("_at") - F.col("_first")
    )


def _check_objects(context: Context) -> None:
    """At least one object, no name twice; also forces the checks of every cell."""
    seen = context.objects.groupBy("name").agg(
        F.count(F.lit(1)).alias("n"), *[F.bit_or(w).alias(f"o{i}") for i, w in enumerate(context.words())]
    )
    got = seen.agg(F.count(F.lit(1)).alias("names"), F.max("n").alias("most"),
                   *[F.bit_or(f"o{i}") for i in range(context.k)]).first()
    if not got.names:
        raise ContextFormatError("no objects")
    if got.most > 1:
        raise ContextFormatError("an object name occurs twice")


def write_context(context: Context, path: str, delimiter: str = ";") -> None:
    """Write a context in the same layout, objects in id order.

    A folder of part files, each with the header line; ``read_context`` takes it.
    """
    cells = [
        F.when(M.contains_fixed(context.words(), j), F.lit("1")).otherwise(F.lit("0")).alias(a)
        for j, a in enumerate(context.attributes)
    ]
    (
        context.objects.orderBy("obj_id").select(F.col("name").alias(""), *cells)
        .write.mode("errorifexists").option("header", True).option("sep", delimiter)
        .option("escape", '"').csv(path)
    )
