"""Run reports as Markdown, written from tables and read back into tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The headings and column titles of a report.
TITLE = "Rapport pipeline"
STAMP = "Généré le"
COUNTS = {"execution": "Cas execution", "normalize": "Cas normalize", "compare": "Paires compare"}
SECTIONS = {
    "summary": "Résumé global",
    "resources": "Ressources par algorithme",
    "execution": "Étape execution",
    "normalize": "Étape normalize",
    "compare": "Étape compare",
    "matrix": "Matrice d'équivalence",
    "timeouts": "Timeouts",
}
EXECUTION_TITLES = {
    "dataset_id": "Dataset", "algorithm_id": "Algo", "status": "Status", "elapsed_seconds": "Elapsed(s)",
    "peak_rss_bytes": "RAM max", "total_written_bytes": "Disque max", "peak_disk_bytes": "Disque dossier pic",
    "peak_written_live_bytes": "Disque écrit pic", "peak_io_read_bytes": "I/O lecture",
    "peak_io_write_bytes": "I/O écriture", "timed_out": "Timeout", "raw_dot_copy": "DOT copié",
}
NORMALIZE_TITLES = {
    "dataset_id": "Dataset", "algorithm_id": "Algo", "status": "Status", "message": "Message",
    "normalized_dot": "DOT normalisé",
}
COMPARE_TITLES = {"dataset_id": "Dataset", "pair": "Pair", "status": "Status", "equivalent": "Equivalent"}
# end of fixed values


def cell(c: Column) -> Column:
    """Text of one table cell; a bar in it would end the cell."""
    return F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("/"))


def row_lines(df: DataFrame) -> DataFrame:
    """One Markdown table line per row: ``line``; all other columns stay."""
    cells = [cell(F.col(c)) for c in df.columns]
    return df.select("*", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def table_lines(df: DataFrame, titles: dict[str, str], order: Sequence) -> DataFrame:
    """A whole Markdown table as rows (``at``, ``line``), header lines first."""
    from conceptloom.operators.ordering import number_rows

    head = "| " + " | ".join(titles.values()) + " |"
    rule = "| " + " | ".join("---" for _ in titles) + " |"
    body = number_rows(row_lines(df.select(*titles)), order, "at")
    spark = df.sparkSession
    top = spark.createDataFrame([(-2, head), (-1, rule)], "at bigint, line string")
    return top.unionByName(body.select("at", "line"))


def markdown_table(rows: Sequence[dict], columns: Sequence[str]) -> str:
    """A small table that already is on the driver."""
    if not rows:
        return "_Aucune donnée._"
    shown = [c for c in columns if c in rows[0]] or list(rows[0])
    out = ["| " + " | ".join(shown) + " |", "| " + " | ".join(["---"] * len(shown)) + " |"]
    out += ["| " + " | ".join(str(r.get(c, "")) for c in shown) + " |" for r in rows]
    return "\n".join(out)


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    """Table rows of Markdown reports: ``path``, ``section``, ``cells`` (title -> text).

    Each report is one small file, read as one text; the first table under every
    second-level heading counts.
    """
    text = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", r"\r\n?", "\n").alias("value")
    )
    sections = text.select("path", F.explode(F.split("value", r"(?m)^##\s+")).alias("s")).select(
        "path", F.trim(F.regexp_extract("s", r"^([^\n]*)", 1)).alias("section"),
        F.regexp_extract_all("s", F.lit(r"(?m)^\s*(\|[^\n]*)$"), F.lit(1)).alias("lines"),
    ).where(F.size("lines") > 2)

    def cut(line):
        inner = F.regexp_replace(F.trim(line), r"^\||\|$", "")
        return F.transform(F.split(inner, r"\|"), lambda c: F.trim(c))

    rows = sections.select(
        "path", "section", cut(F.col("lines")[0]).alias("titles"),
        F.posexplode(F.slice("lines", F.lit(3), F.size("lines"))).alias("at", "line"),
    )
    return rows.select(
        "path", "section", "at",
        F.map_from_arrays("titles", F.slice(F.concat(cut(F.col("line")), F.array_repeat(F.lit(""), F.size("titles"))), F.lit(1), F.size("titles"))).alias("cells"),
    )


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """``- key: value`` lines of reports: ``path``, ``section``, ``key``, ``value``."""
    text = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", r"\r\n?", "\n").alias("value")
    )
    sections = text.select("path", F.explode(F.split("value", r"(?m)^##\s+")).alias("s"))
    items = sections.select(
        "path", F.trim(F.regexp_extract("s", r"^([^\n]*)", 1)).alias("section"),
        F.explode(F.regexp_extract_all("s", F.lit(r"(?m)^\s*-\s*([^:\n]+:[^\n]*)$"), F.lit(1))).alias("item"),
    )
    return items.select(
        "path", "section", F.trim(F.regexp_extract("item", r"^([^:]+):", 1)).alias("key"),
        F.trim(F.regexp_extract("item", r"^[^:]+:(.*)$", 1)).alias("value"),
    )


def read_titles(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``title`` and ``generated_at`` (``n/a`` if absent) of reports."""
    text = spark.read.text(path, wholetext=True)
    stamp = F.trim(F.regexp_extract("value", rf"(?m)^{STAMP}:\s*(.+)$", 1))
    return text.select(
        F.col("_metadata.file_path").alias("path"),
        F.trim(F.regexp_extract("value", rf"(?m)^#\s+{TITLE}\s+-\s+(.+)$", 1)).alias("title"),
        F.when(stamp == "", F.lit("n/a")).otherwise(stamp).alias("generated_at"),
    )


def now_iso() -> str:
    return datetime.now().astimezone().isoformat(timespec="seconds")
