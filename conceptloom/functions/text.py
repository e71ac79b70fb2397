"""Text expressions: DOT escapes, natural order, sizes and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def escape_label(c: Column) -> Column:
    """Backslash before the characters that mean something in a record label."""
    return F.regexp_replace(c, r'([\\"{}|<>])', r"\\$1")


def unescape_label(c: Column) -> Column:
    return F.regexp_replace(c, r'\\([\\"{}|<>])', "$1")


def natural_key(c: Column) -> Column:
    """Sort key of the natural order: case-blind, digit runs by their value."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.transform(
        parts,
        lambda p: F.when(
            p.rlike(r"^\d"),
            # a digit run sorts by its length without leading zeros, then by digits
            F.concat(
                F.lit("0"),
                F.lpad(F.length(F.regexp_replace(p, "^0+", "")).cast("string"), 9, "0"),
                F.regexp_replace(p, "^0+", ""),
            ),
        ).otherwise(F.concat(F.lit("1"), p)),
    )


def pinned_natural_key(c: Column, first: str) -> list[Column]:
    """Natural order with one name (case-blind) before all others."""
    return [F.when(F.lower(F.trim(c)) == first.lower(), 0).otherwise(1), natural_key(c)]


def sort_caseless(names: Column) -> Column:
    """Distinct names, case-blind order (ties: by the name itself)."""
    keyed = F.transform(F.array_distinct(names), lambda s: F.struct(F.lower(s).alias("k"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda p: p.getField("s"))


def format_bytes(n: Column) -> Column:
    """``0 B`` ... ``1.50 KiB`` ... up to TiB; NULL is ``NA``."""
    out = F.format_string("%.2f TiB", n / F.lit(1024.0**4))
    for power, unit in ((3, "GiB"), (2, "MiB"), (1, "KiB")):
        out = F.when(n < 1024 ** (power + 1), F.format_string(f"%.2f {unit}", n / F.lit(1024.0**power))).otherwise(out)
    out = F.when(n < 1024, F.concat(n.cast("bigint").cast("string"), F.lit(" B"))).otherwise(out)
    return F.when(n.isNull(), F.lit("NA")).otherwise(out)


def parse_elapsed(c: Column) -> Column:
    """Seconds from ``12.5``, ``m:ss.cc``, ``h:mm:ss`` or ``250 ms``; else NULL."""
    t = F.trim(c)
    parts = F.transform(F.split(t, ":"), lambda p: p.try_cast("double"))
    clock = F.aggregate(parts, F.lit(0.0), lambda acc, p: acc * 60 + p)
    return (
        F.when(t.rlike(r"^\d+(\.\d+)?\s*ms$"), F.regexp_extract(t, r"^([\d.]+)", 1).try_cast("double") / 1000)
        .when(t.rlike(r"^\d+(:\d+){1,2}(\.\d+)?$"), clock)
        .otherwise(t.try_cast("double"))
    )


def format_elapsed(seconds: Column) -> Column:
    """``hh:mm:ss`` of a number of seconds."""
    s = F.floor(seconds).cast("bigint")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)
