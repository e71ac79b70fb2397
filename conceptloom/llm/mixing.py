"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight (its place among the sources, by code point) and a schedule: how its weight moves over
training time 0..1, linear between knots.  The share of a source is the integral of its schedule; targets are those
shares of all words, limited to ``MAX_REPEATS`` times the source, the excess reshared by weight until none is above.
A source's documents, in a fixed pseudo-random order, are laid end to end (again and again, if the target is larger
than the source) up to the target; the last copy is cut where the target is met.  The time at which a copy begins
is found by inverting the source's cumulative token demand, and documents are range-sorted by their first position.

Running sums are taken in two steps, over buckets and within each, so a source with any share of the rows is spread
over 4096 window partitions.  Only ids and sizes are shuffled, no text.

Defined results: a null or empty text has size 0 and takes nothing; a null source is a source, the last one;
a null id is ordered as an empty one; rows with equal ids are told apart by size; if no row has a word, all targets
are 0; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from conceptloom.llm.common import whole_text

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Knots (time, factor) of the schedules, one schedule per weight class: early, steady and late sources.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))
WORD = r"[^\x20\x09-\x0D]+"
_BUCKET = 3  # hexadecimal digits: 4096 buckets a source


def words_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def _integral(knots: Sequence[tuple[float, float]]) -> float:
    return sum((t1 - t0) * (a + b) / 2 for (t0, a), (t1, b) in zip(knots, knots[1:], strict=False))


def _time(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time at which a source has been asked for ``share`` of its whole demand."""
    whole, done, out = _integral(knots), 0.0, F.lit(1.0)
    steps = []
    for (t0, a), (t1, b) in zip(knots, knots[1:], strict=False):
        part = (t1 - t0) * (a + b) / 2 / whole
        y = (share - F.lit(done)) * F.lit(whole)
        slope = (b - a) / (t1 - t0)
        if slope:
            t = F.lit(t0) + (F.sqrt(F.greatest(F.lit(a * a) + F.lit(2 * slope) * y, F.lit(0.0))) - F.lit(a)) / F.lit(slope)
        else:
            t = F.lit(t0) + y / F.lit(a)
        steps.append((done + part, t))
        done += part
    for upto, t in reversed(steps):
        out = F.when(share <= F.lit(upto), t).otherwise(out)
    return F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """source, class, source_size, target from (source, size); one row per source."""
    every = Window.partitionBy(F.lit(0))
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per.withColumn("place", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last()))).select(
        "source", "source_size", F.pmod(F.col("place") - 1, F.lit(len(weights))).cast("int").alias("class"), "place",
    ).withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("class") + 1).cast("bigint"))
    # Sources meet their limit in the order of limit / weight; the level is found where the rest stays below.
    order = every.orderBy(F.col("source_size") / F.col("weight"), "place")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    level = ranked.select(
        "*", (F.sum("source_size").over(every) - F.lit(max_repeats) * F.coalesce(F.sum("source_size").over(before), F.lit(0))).alias("left"),
        F.sum("weight").over(after).alias("weights"),
    ).withColumn(
        "free", F.col("left") * F.col("weight") <= F.lit(max_repeats) * F.col("source_size") * F.col("weights")
    )
    first = F.min(F.when(F.col("free"), F.struct(F.col("source_size") / F.col("weight"), "place", "left", "weights"))).over(every)
    level = level.withColumn("first", first)
    limit = (F.lit(max_repeats) * F.col("source_size")).cast("double")
    share = F.col("first.left") * F.col("weight") / F.col("first.weights")
    return level.select("source", "class", "source_size", F.coalesce(F.least(limit, share), limit).alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS, schedules=SCHEDULES) -> DataFrame:
    """One row per document, in the order of training: doc_id, source, size, source_size, target, taken, repeats,
    position (time of its first copy, null if nothing is taken), positions (of every copy)."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    sized = docs.select("doc_id", "source", words_of(whole_text()).alias("size"), key.alias("_key")).withColumn(
        "_bucket", F.substring("_key", 1, _BUCKET)
    )
    buckets = sized.groupBy("source", "_bucket").agg(F.sum("size").alias("_words"))
    goals = targets(buckets.select("source", F.col("_words").alias("size")), weights, max_repeats)
    earlier = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.select("source", "_bucket", F.coalesce(F.sum("_words").over(earlier), F.lit(0)).alias("_start"))
    # A null source is a key like any other; source and bucket are joined under names of their own.
    named = lambda df: df.withColumn("_named", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))).drop("source")
    inside = Window.partitionBy("_named", "_bucket").orderBy("_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = named(sized.withColumn("_source", F.col("source"))).withColumn(
        "_inside", F.coalesce(F.sum("size").over(inside), F.lit(0))
    ).join(named(starts).join(named(goals), "_named"), ["_named", "_bucket"]).withColumn("_at", F.col("_start") + F.col("_inside"))

    # Copy e covers the words [e * source_size + at, + size) of the source's demand.
    goal = F.floor("target").cast("bigint")
    begin = [F.lit(e) * F.col("source_size") + F.col("_at") for e in range(max_repeats)]
    parts = [F.least(F.greatest(goal - b, F.lit(0)), F.col("size")) for b in begin]
    times = []
    for b, p in zip(begin, parts, strict=True):
        when = F.lit(None).cast("double")
        for k, knots in enumerate(schedules):
            when = F.when(F.col("class") % len(schedules) == k, _time(b / F.when(F.col("target") > 0, F.col("target")), knots)).otherwise(when)
        times.append(F.when(p > 0, F.round(when, 9)))
    return placed.select(
        "doc_id", F.col("_source").alias("source"), "size", "source_size", "target",
        sum(parts[1:], parts[0]).cast("bigint").alias("taken"), F.filter(F.array(*times), lambda t: t.isNotNull()).alias("positions"),
    ).select("*", F.size("positions").alias("repeats"), F.get("positions", F.lit(0)).alias("position")).orderBy(
        F.col("position").asc_nulls_last(), "doc_id"
    )


SQL = r"""with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint size,
    md5(coalesce(doc_id::varchar, '')) k from documents),
 p as (select source, sum(size)::bigint ss, row_number() over (order by source nulls last) pl from d group by source),
 w as (select *, case (pl - 1) % 3 when 0 then 5 when 1 then 2 else 1 end wt, (pl - 1) % 3 cl from p),
 o as (select *, row_number() over (order by ss / wt, pl) r, sum(ss) over () as t from w),
 l as (select *, t - 3 * coalesce(sum(ss) over (order by r rows between unbounded preceding and 1 preceding), 0) lft,
    sum(wt) over (order by r rows between current row and unbounded following) ws from o),
 f as (select lft, ws from l where lft * wt <= 3 * ss * ws order by r limit 1),
 g as (select source, ss, cl, least((3 * ss)::double, (f.lft::bigint * wt)::double / f.ws::double) target from l, f),
 a as (select doc_id, size, ss source_size, target, cl, coalesce(sum(size) over (partition by d.source order by k, size
    rows between unbounded preceding and 1 preceding), 0)::bigint a0 from d join g on d.source is not distinct from g.source),
 c as (select *, [least(greatest(floor(target)::bigint - a0, 0), size), least(greatest(floor(target)::bigint - source_size - a0, 0),
    size), least(greatest(floor(target)::bigint - 2 * source_size - a0, 0), size)] n,
    case when target > 0 then a0 / target end y from a)
select doc_id, size, source_size, target, list_sum(n)::bigint taken, ((n[1] > 0)::int + (n[2] > 0)::int + (n[3] > 0)::int) repeats,
  case when n[1] > 0 then round(least(greatest(case cl when 0 then (sqrt(1.5 * 1.5 + 2 * -1.0 * y) - 1.5) / -1.0
    when 1 then y else (sqrt(0.5 * 0.5 + 2 * 1.0 * y) - 0.5) / 1.0 end, 0), 1), 9) end "position" from c"""
