"""DOT statements of any layout, from files of any size.

Files are read as lines in splits.  What a line means depends on what is open where it begins: a quote, brackets, a
continuation.  Each line changes that state in a way that combines (quotes by parity, brackets by a sum), so the state
before every line is a running total: within a split by a window over the split's lines, and from split to split by a
window over one row per split.  Lines that begin with nothing open start a piece; the lines of a piece come together by
(file, number of the piece), and pieces are cut into statements where they are, in parallel.

A piece of more than ``LONG`` lines may be a label of millions of objects.  If each of its lines but the first and the last
ends an item of the label's last field, as the writer lays them out, the lines can stay apart (``split_pieces``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from conceptloom.scratch import Scratch

_SPLIT, _LINE = ["folder", "part"], "at"
# Lines of a piece that may stay apart.
LONG = 10_000
# The lines of such a piece: one node whose label's quote is open, its third field begun, to the line's end; items; the rest.
_HEAD = r'^\s*(?:"[^"]*"|[A-Za-z0-9_.\-]+)\s*\[(?:[^"\[\]{};]*[^"\[\]{};A-Za-z_])?label\s*=\s*"[^"]*\\$'
_MIDDLE = r'^[^"|]*\\[nl]\\$'
_TAIL = r'^[^"|]*"[^"\[\]{};]*\]\s*;?\s*$'


def _running(lines: DataFrame, scratch: Scratch, change: Column, name: str) -> DataFrame:
    """``lines`` with the sum of ``change`` over all earlier lines of the folder as column ``name``."""
    kept = scratch.save(lines.withColumn("_c", change.cast("bigint")), name)
    parts = kept.groupBy(*_SPLIT).agg(F.sum("_c").alias("_s"))  # one row per split
    before = Window.partitionBy("folder").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*_SPLIT, F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*_SPLIT).orderBy(_LINE).rowsBetween(Window.unboundedPreceding, -1)
    summed = kept.withColumn("_in", F.coalesce(F.sum("_c").over(inside), F.lit(0)))
    return summed.join(parts, _SPLIT).withColumn(name, F.col("_before") + F.col("_in")).drop("_c", "_in", "_before")


def _count(text: Column, what: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))


def pieces(spark: SparkSession, path: str, prepare) -> DataFrame:
    """(``value``): whole statements, or several, of every folder; ``prepare`` sets escaped characters aside."""
    return _whole(_numbered(spark, path, prepare, Scratch(spark, "statements")))


def split_pieces(spark: SparkSession, path: str, prepare) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """``value`` of the pieces whose lines come together, ``folder``, ``piece`` and ``value`` of the others without their
    middle lines, and the same of each middle line; None and None if no lines stay apart."""
    scratch, key, at = Scratch(spark, "statements"), ["folder", "piece"], F.struct("part", _LINE)
    lines = scratch.save(_numbered(spark, path, prepare, scratch), "pieces")
    many = lines.groupBy(*key).agg(F.count("*").alias("n"), F.min(at).alias("from"), F.max(at).alias("to"))
    many = scratch.save(many.where(F.col("n") > LONG).drop("n"), "many")  # a row for LONG lines at least
    place = F.when(at == F.col("from"), "head").when(at == F.col("to"), "tail").otherwise("middle")
    placed = lines.join(F.broadcast(many), key).select(*key, "value", place.alias("place"))
    head, tail = F.col("place") == "head", F.col("place") == "tail"
    label = F.substring_index("value", '"', -1)
    fits = (
        F.when(head, F.col("value").rlike(_HEAD) & (_count(label, "|") == 2) & label.rlike(r"(\||\\[nl])\\$"))
        .when(tail, F.col("value").rlike(_TAIL)).otherwise(F.col("value").rlike(_MIDDLE))
    )
    ends = [F.max(F.when(w, F.col("value"))).alias(n) for w, n in ((head, "head"), (tail, "tail"))]
    apart = placed.groupBy(*key).agg(F.min(fits).alias("fits"), *ends).where("fits")
    joined = F.replace(F.concat_ws("\n", "head", "tail"), F.lit("\\\n"), F.lit(""))
    apart = scratch.save(apart.select(*key, joined.alias("value")), "apart")
    if not apart.limit(1).count():
        return _whole(lines), None, None
    names = F.broadcast(apart.select(*key))
    middle = placed.where("place = 'middle'").join(names, key)
    return _whole(lines.join(names, key, "left_anti")), apart, middle.select(*key, F.expr("left(value, length(value) - 1)").alias("value"))


def _numbered(spark: SparkSession, path: str, prepare, scratch: Scratch) -> DataFrame:
    """Lines with the number of their piece."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split")]
    text = spark.read.text(path).select(*place, F.monotonically_increasing_id().alias(_LINE), prepare(F.col("value")).alias("value"))
    folder = F.regexp_extract("file", "^(.*)/[^/]*$", 1)
    splits = spark.read.text(path).select(*place).distinct().withColumn("folder", folder).withColumn(
        "part", F.row_number().over(Window.partitionBy("folder").orderBy("file", "split")))  # one row per split
    text = text.join(splits, ["file", "split"]).select(*_SPLIT, _LINE, "value")
    lines = _running(text, scratch, _count(F.col("value"), '"'), "quotes")
    open_quote = F.col("quotes") % 2
    outside = F.array_join(F.filter(F.split("value", '"'), lambda t, i: (i + open_quote) % 2 == 0), '"')
    lines = _running(lines, scratch, _count(outside, "[") - _count(outside, "]"), "brackets")
    # The line before a split's first one is the last of the split before.
    lines = scratch.save(lines.withColumn("goes_on", F.col("value").endswith("\\").cast("int")), "lines")
    follows = Window.partitionBy(*_SPLIT).orderBy(_LINE)
    last = lines.groupBy(*_SPLIT).agg(F.max_by("goes_on", _LINE).alias("_end"))
    carried = last.select(*_SPLIT, F.lag("_end").over(Window.partitionBy("folder").orderBy("part")).alias("_carried"))
    lines = lines.withColumn("_first", F.row_number().over(follows) == 1).withColumn("_lag", F.lag("goes_on").over(follows))
    lines = lines.join(carried, _SPLIT)
    after = F.coalesce(F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_lag")), F.lit(0))
    begins = (F.col("quotes") % 2 == 0) & (F.col("brackets") <= 0) & (after == 0)
    lines = _running(lines.select(*_SPLIT, _LINE, "value", begins.cast("int").alias("begins")), scratch, F.col("begins"), "piece")
    return lines.select(*_SPLIT, _LINE, "value", (F.col("piece") + F.col("begins")).alias("piece"))


def _whole(lines: DataFrame) -> DataFrame:
    """The lines of each piece together."""
    piece = lines.groupBy("folder", "piece").agg(
        F.array_sort(F.collect_list(F.struct("part", _LINE, "value"))).alias("_l")
    )
    joined = F.array_join(F.col("_l.value"), "\n")
    return piece.select(F.replace(joined, F.lit("\\\n"), F.lit("")).alias("value"))
