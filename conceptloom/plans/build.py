"""From a context file to the DOT text of its lattice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from conceptloom.operators.enumerate import build_lattice
from conceptloom.operators.graph import GraphError, expand, validate
from conceptloom.sources import dot
from conceptloom.sources.context_csv import read_context


def context_to_dot(
    spark: SparkSession, csv_path: str, delimiter: str | None = None, mode: str = "strict",
    method: str = "frontier", order: str = "intent", labels: str = "reduced", color_by: str = "own",
    max_concepts: int | None = None,
) -> DataFrame:
    """Rows of DOT text for the lattice of a context file."""
    context = read_context(spark, csv_path, delimiter, mode).saved()
    return dot.dot_lines(build_lattice(context, method, max_concepts), labels, order, color_by)


def expand_dot(spark: SparkSession, path: str, loose_breaks: bool = False) -> DataFrame:
    """Rows of DOT text with full labels for a graph with reduced ones, of any layout."""
    full = expand(dot.read_dot(spark, path, loose_breaks=loose_breaks, free=True))
    validate(full)
    return dot.expanded_lines(full)


def to_local_file(lines: DataFrame, path: str) -> int:
    """Write DOT rows to one file on this machine, partition by partition."""
    ordered = lines.orderBy(*dot.SORT).select("line")
    n = 0
    with open(path, "w", encoding="utf-8") as out:
        for row in ordered.toLocalIterator():
            out.write(row.line + "\n")
            n += 1
    if not n:
        raise GraphError("nothing to write")
    return n
