"""The registered queries: name -> (Spark query, SQL answer or None)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptloom.functions import masks as M
from conceptloom.functions import text as X
from conceptloom.operators import blocks as B
from conceptloom.operators import columns as V
from conceptloom.operators import compare as C
from conceptloom.operators import derive as D
from conceptloom.operators import graph as G
from conceptloom.operators import labels as L
from conceptloom.operators import metering as R
from conceptloom.operators import neighbours as N
from conceptloom.operators.context import Context, from_masks
from conceptloom.operators.enumerate import build_lattice
from conceptloom.operators.lattice import Lattice
from conceptloom.operators.ordering import number_rows
from conceptloom.operators.validate import lattice_violations
from conceptloom.plans import oracles as Q
from conceptloom.plans.contexts import SOURCES, table
from conceptloom.scratch import Scratch
from conceptloom.sources import context_csv, dot, reports
from conceptloom.streaming.incremental import LatticeState, follow

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def register(name: str, sql: str | None = None):
    def keep(fn: Query) -> Query:
        ENTRIES[name] = Entry(fn, sql)
        return fn

    return keep


def context_of(spark: SparkSession, d: str, source: str) -> Context:
    return SOURCES[source].build(spark, d)


def lattice_of(spark: SparkSession, d: str, source: str, **options) -> Lattice:
    return build_lattice(context_of(spark, d, source), **options)


def joined(names) -> Column:
    return F.array_join(names, ",")


# -- contexts ------------------------------------------------------------------


@register("context_incidence", Q.base("docs", False) + """
select inc.g obj_id, j::bigint attr_id from inc join att using (m)""")
def context_incidence(spark, d):
    return context_of(spark, d, "docs").incidence().select(
        F.col("obj_id").cast("bigint"), F.col("attr_id").cast("bigint")
    )


@register("context_stats", Q.base("docs", False) + """
select count(*) n_objects, (select count(*) from att) n_attributes, sum(bit_count(r))::bigint n_incidences,
       count(distinct r) n_distinct_rows, sum(bit_count(r))::bigint / (count(*) * (select count(*) from att)) density
from obj""")
def context_stats(spark, d):
    return context_of(spark, d, "docs").stats()


@register("row_masks", Q.base("order_lines", False) + "select r as mask, n from rws")
def row_masks(spark, d):
    return context_of(spark, d, "order_lines").rows.select(F.col("m0").alias("mask"), "n")


@register("attribute_support", Q.base("docs", False) + """
select j::bigint attr_id, att.m as name, count(g)::bigint n_objects from att left join inc using (m) group by all""")
def attribute_support(spark, d):
    return context_of(spark, d, "docs").support().withColumn("attr_id", F.col("attr_id").cast("bigint"))


@register("context_csv_round_trip", Q.base("docs", False) + """
select row_number() over (order by g) - 1 obj_id, nm as name, r as mask from obj""")
def context_csv_round_trip(spark, d):
    """Write a context as delimited text and read it back."""
    context = context_of(spark, d, "docs")
    path = f"{Scratch(spark, 'csv').path}/context"
    context_csv.write_context(context, path)
    return context_csv.read_context(spark, path).objects.select("obj_id", "name", F.col("m0").alias("mask"))


# -- set algebra -----------------------------------------------------------------


@register("set_algebra", Q.base("docs", False) + """,
two as (select distinct x.r a, y.r b from obj x join obj y on y.g = x.g + 1)
select a, b, a & b as meet, a | b as "join", a & ~b as minus, bit_count(a)::bigint size_a,
       (a & b) = a as subset, (a & b) = a and a <> b as strict_subset,
       a & ((1::bigint << 7) - 1) as below_7,
       (xor(a, b) & -xor(a, b)) & b <> 0 as lectic_less,
       (a & 63) = (b & 63) and (b >> 6) & 1 = 1 and (a >> 6) & 1 = 0 as lectic_less_at_6,
       lpad(upper(format('{:x}', a)), 16, '0') as hex
from two""")
def set_algebra(spark, d):
    """Every set operation on the rows of consecutive documents."""
    objects = context_of(spark, d, "docs").objects
    after = objects.select((F.col("obj_id") - 1).alias("obj_id"), F.col("m0").alias("b"))
    two = objects.select("obj_id", F.col("m0").alias("a")).join(after, "obj_id").select("a", "b").distinct()
    a, b = [F.col("a")], [F.col("b")]
    return two.select(
        "a", "b",
        M.intersect(a, b)[0].alias("meet"), M.union(a, b)[0].alias("join"), M.difference(a, b)[0].alias("minus"),
        M.size(a).alias("size_a"), M.is_subset(a, b).alias("subset"), M.is_strict_subset(a, b).alias("strict_subset"),
        M.intersect(a, M.below(F.lit(7), 1))[0].alias("below_7"),
        M.lectic_less(a, b).alias("lectic_less"),
        M.lectic_less_at(a, b, F.lit(6)).alias("lectic_less_at_6"),
        M.to_hex(a).alias("hex"),
    )


# -- derivation and closure --------------------------------------------------------


@register("derive_attrs", Q.base("docs", False) + """
select g obj_id from inc where m in ('lang:en', 'quality:1') group by g having count(*) = 2""")
def derive_attrs(spark, d):
    """Objects with all the given attributes."""
    found = D.objects_having(context_of(spark, d, "docs"), ["lang:en", "quality:1"])
    return found.select(F.col("obj_id").cast("bigint"))


@register("superset_search", Q.base("docs", False) + """
select g obj_id from obj where r & (select sum(1::bigint << j::int)::bigint from att where m in ('lang:en', 'toxic:0'))
  = (select sum(1::bigint << j::int)::bigint from att where m in ('lang:en', 'toxic:0'))""")
def superset_search(spark, d):
    """The same question as relational division on the pairs."""
    found = D.with_attributes(context_of(spark, d, "docs"), ["lang:en", "toxic:0"])
    return found.select(F.col("obj_id").cast("bigint"))


@register("derive_objs", Q.base("nation", False) + """
select coalesce(bit_and(r), any_value(f)) as mask
from full_ left join (select r from obj join nation on g = n_nationkey where n_regionkey = 1) on true""")
def derive_objs(spark, d):
    """Attributes common to the nations of one region."""
    context = context_of(spark, d, "nation")
    region = table(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("obj_id"))
    chosen = context.objects.join(region, "obj_id", "left_semi")
    return D.common_attributes(context, chosen).select(F.col("m0").alias("mask"))


@register("closure_of_set", Q.base("docs", False) + """
select coalesce(bit_and(r), any_value(f)) as mask, count(r)::bigint n_extent from full_ left join
  (select r from obj where r & (select bit_or(1::bigint << j::int) from att where m = 'quality:1') <> 0) on true""")
def closure_of_set(spark, d):
    return D.closure(context_of(spark, d, "docs"), ["quality:1"]).select(F.col("m0").alias("mask"), "n_extent")


@register("closure_pairs", Q.base("nation", False) + """
select x.j::bigint a, y.j::bigint b, coalesce(bit_and(r), any_value(f)) as mask, coalesce(sum(n), 0)::bigint n_extent
from att x join att y on x.j < y.j cross join full_
left join rws on (r >> x.j::int) & 1 = 1 and (r >> y.j::int) & 1 = 1 group by x.j, y.j""")
def closure_pairs(spark, d):
    """Closures of all two-attribute sets."""
    return D.pair_closures(context_of(spark, d, "nation")).select(
        F.col("a").cast("bigint"), F.col("b").cast("bigint"), F.col("d0").alias("mask"), "n_extent"
    )


@register("closure_sets", Q.base("docs", False) + """,
qs as (select distinct r & (r - 1) q from rws where r <> 0)
select q, coalesce(bit_and(r), any_value(f)) as mask, coalesce(sum(n), 0)::bigint n_extent
from qs cross join full_ left join rws on r & q = q group by q""")
def closure_sets(spark, d):
    """Closures of many sets at once: every row without its first attribute."""
    context = context_of(spark, d, "docs")
    sets = context.rows.where("m0 <> 0").select(
        F.col("m0").bitwiseAND(F.col("m0") - 1).alias("q0")
    ).distinct()
    return D.closures(context, sets).select(F.col("q0").alias("q"), F.col("d0").alias("mask"), "n_extent")


@register("closure_by_columns", Q.base("docs", False) + """,
qs as (select distinct r & (r - 1) q from rws where r <> 0)
select q, coalesce(bit_and(r), any_value(f)) as mask, coalesce(sum(n), 0)::bigint n_extent
from qs cross join full_ left join rws on r & q = q group by q""")
def closure_by_columns(spark, d):
    """The same closures from the columns: chunks of extents, and the attributes that contain them."""
    context = context_of(spark, d, "docs").with_rows()
    sets = context.rows.where("m0 <> 0").select(F.col("m0").bitwiseAND(F.col("m0") - 1).alias("q0")).distinct()
    found = V.closures_by_columns(V.vertical(context), sets)
    return found.select(F.col("q0").alias("q"), F.col("d0").alias("mask"), "n_extent")


@register("next_closed_set", Q.base("docs") + """,
qs as (select distinct r & (r - 1) q from rws where r <> 0 union select i from con),
k as (select i, reverse(lpad(bin(i), 63, '0')) s from con)
select q, i mask, n_extent from (select q, arg_min(i, s) i from qs join k on s > reverse(lpad(bin(q), 63, '0')) group by q) join ext using (i)""")
def next_closed_set(spark, d):
    """The lectic successors of all concepts, and of sets that aren't closed."""
    context = context_of(spark, d, "docs").saved()
    sets = context.rows.where("m0 <> 0").select(F.col("m0").bitwiseAND(F.col("m0") - 1).alias("q0"))
    sets = sets.unionByName(build_lattice(context).concepts().select(F.col("i0").alias("q0"))).distinct()
    return D.next_closed(context, sets).select(F.col("q0").alias("q"), F.col("d0").alias("mask"), "n_extent")


@register("attribute_concepts", Q.base("docs", False) + """
select att.m as name, coalesce(bit_and(r), any_value(f)) intent_mask, coalesce(sum(n), 0)::bigint n_extent
from att cross join full_ left join rws on (r >> j::int) & 1 = 1 group by att.m, att.j""")
def attribute_concepts(spark, d):
    return D.attribute_concepts(context_of(spark, d, "docs")).select(
        "name", F.col("i0").alias("intent_mask"), "n_extent"
    )


@register("object_concepts", Q.base("nation", False) + "select g::bigint obj_id, nm as name, r as intent_mask from obj")
def object_concepts(spark, d):
    return D.object_concepts(context_of(spark, d, "nation")).select(
        F.col("obj_id").cast("bigint"), "name", F.col("i0").alias("intent_mask")
    )


# -- concepts and covers -------------------------------------------------------------


def _concepts(source: str) -> Query:
    def run(spark, d):
        lattice = lattice_of(spark, d, source)
        out = lattice.concepts().select(
            *lattice.intent(), joined(lattice.intent_names()).alias("intent"), "n_intent", "n_extent"
        )
        return out.drop(*M.names("i", lattice.k))

    return run


def _covers(source: str) -> Query:
    def run(spark, d):
        lattice = lattice_of(spark, d, source)
        return lattice.covers(parent=joined(lattice.intent_names())).select(
            joined(lattice.intent_names("child")).alias("child"), "parent",
        )

    return run


for _s in SOURCES:
    register(f"fca_concepts_{_s}", Q.base(_s) + f"""
select {Q.names('i')} intent, (select count(*) from att where (i >> j::int) & 1 = 1)::bigint n_intent, n_extent from ext""")(_concepts(_s))
    _how = Q.COVERS_BY_CLOSURE if _s in ("supplier_brand", "nation_month") else Q.COVERS
    register(f"fca_covers_{_s}", Q.base(_s) + _how + f"""
, nam as (select i, {Q.names('i')} t from con)
select a.t child, b.t parent from cov join nam a on a.i = child join nam b on b.i = parent""")(_covers(_s))


@register("concepts_join_method", Q.base("nation") + "select i intent_mask, bit_count(i)::bigint n_intent, n_extent from ext")
def concepts_join_method(spark, d):
    """The enumeration that never gathers the rows, whatever their number."""
    lattice = lattice_of(spark, d, "nation", method="join")
    return lattice.concepts().select(F.col("i0").alias("intent_mask"), "n_intent", "n_extent")


@register("covers_join_method", Q.base("order_lines") + Q.COVERS + "select child, parent from cov")
def covers_join_method(spark, d):
    lattice = lattice_of(spark, d, "order_lines", method="join")
    return lattice.covers().select(F.col("child0").alias("child"), F.col("parent0").alias("parent"))


@register("concept_ids", Q.base("nation") + Q.IDS + "select id, i intent_mask, n_intent, n_extent from num")
def concept_ids(spark, d):
    return lattice_of(spark, d, "nation").with_ids().select("id", F.col("i0").alias("intent_mask"), "n_intent", "n_extent")


@register("concept_ids_lectic", Q.base("docs") + """
select row_number() over (order by reverse(lpad(bin(i), 63, '0'))) - 1 id, i intent_mask from con""")
def concept_ids_lectic(spark, d):
    return lattice_of(spark, d, "docs").with_ids("lectic").select("id", F.col("i0").alias("intent_mask"))


@register("concept_ids_by_names", Q.base("docs") + f""",
nam as (select i, {Q.names('i')} t, bit_count(i) c from con)
select row_number() over (order by c, string_split(t, ',')) - 1 id, i intent_mask from nam""")
def concept_ids_by_names(spark, d):
    return lattice_of(spark, d, "docs").with_ids("names").select("id", F.col("i0").alias("intent_mask"))


@register("concept_ids_descending", Q.base("docs") + """
select row_number() over (order by bit_count(i) desc, i) - 1 id, i intent_mask from con""")
def concept_ids_descending(spark, d):
    return lattice_of(spark, d, "docs").with_ids("intent_desc").select("id", F.col("i0").alias("intent_mask"))


@register("top_bottom", Q.base("docs") + """
select 'top' which, bit_count(i)::bigint n_intent, i intent_mask, n_extent from ext where i = (select bit_and(i) from con)
union all select 'bottom', bit_count(i)::bigint, i, n_extent from ext where i = (select f from full_)""")
def top_bottom(spark, d):
    ends = lattice_of(spark, d, "docs").extremes()
    return ends.select("which", "n_intent", F.col("i0").alias("intent_mask"), "n_extent")


@register("level_histogram", Q.base("supplier_brand") + """
select bit_count(i)::bigint n_intent, count(*) n_concepts,
       (sum(count(*)) over (order by bit_count(i)))::bigint n_upto from con group by bit_count(i)""")
def level_histogram(spark, d):
    return lattice_of(spark, d, "supplier_brand").level_histogram()


@register("concept_superset_search", Q.base("docs") + """
select i intent_mask, n_extent from ext where (select count(*) from att where m in ('lang:en', 'quality:1') and (i >> j::int) & 1 = 1) = 2""")
def concept_superset_search(spark, d):
    """Concepts whose intent contains the given attributes, by relational division."""
    lattice = lattice_of(spark, d, "docs")
    found = lattice.having(lattice.with_ids(), ["lang:en", "quality:1"])
    return found.select(F.col("i0").alias("intent_mask"), "n_extent")


@register("edge_json_round_trip", Q.base("docs") + Q.COVERS + Q.IDS + """
select a.id src, b.id dst from cov join num a on a.i = child join num b on b.i = parent""")
def edge_json_round_trip(spark, d):
    """Cover edges written as JSON lines and read back."""
    lattice = lattice_of(spark, d, "docs")
    path = f"{Scratch(spark, 'edges').path}/edges"
    lattice.write_edges(lattice.with_ids(), path)
    return spark.read.schema("src bigint, dst bigint").json(path)


@register("lattice_checks", "select 0::bigint repeated, 0::bigint not_closed, 0::bigint wrong_extent, 0::bigint wrong_direction, 0::bigint skipped_level, 0::bigint extra_tops")
def lattice_checks(spark, d):
    """Closedness, extents, uniqueness and direction checked by other operators."""
    return lattice_violations(lattice_of(spark, d, "docs")).drop("missing")


@register("lattice_checks_broken", Q.base("docs") + Q.COVERS + """,
p as (select * from ext where bit_count(i) <> 2),
cl as (select coalesce(bit_and(r), any_value(f)) c from p cross join att cross join full_
         left join rws on r & (p.i | (1::bigint << j::int)) = (p.i | (1::bigint << j::int))
       where (p.i >> j::int) & 1 = 0 group by p.i, j union select bit_and(r) from rws)
select 1::bigint repeated, 0::bigint not_closed, (select count(*) from p where bit_count(i) = 3) wrong_extent, 0::bigint wrong_direction,
  0::bigint skipped_level, (select count(*) from p where not exists (select 1 from cov where child = p.i and bit_count(parent) <> 2)) extra_tops,
  (select count(distinct c) from cl where c not in (select i from p)) missing""")
def lattice_checks_broken(spark, d):
    """A lattice without its concepts of two attributes, with wrong extents of three and its top twice."""
    lattice = lattice_of(spark, d, "docs")
    size = M.size(lattice.intent())
    nodes = lattice.nodes.where(size != 2).withColumn("n_extent", F.col("n_extent") + F.when(size == 3, 1).otherwise(0))
    top = lattice.nodes.where(M.equal(lattice.intent(), [F.lit(lattice.extremes().where("which = 'top'").first().i0)]))
    return lattice_violations(Lattice(lattice.context, nodes.unionByName(top), lattice.n_concepts))


@register("covers_of_concepts", Q.base("nation") + Q.COVERS + "select child, parent from cov")
def covers_of_concepts(spark, d):
    """The cover relation of concepts that come from a file."""
    context = context_of(spark, d, "nation")
    intents, rows = N.concepts_of_graph(graph_of(spark, d, "nation", "full"), list(context.attributes))
    found = N.covers_of_concepts(intents, context.n_attributes, rows)
    return found.select(F.col("child0").alias("child"), F.col("parent0").alias("parent"))


@register("covers_without_rows", Q.base("docs") + Q.COVERS + "select child, parent from cov")
def covers_without_rows(spark, d):
    """The same from nothing but a table of intents."""
    lattice = lattice_of(spark, d, "docs")
    found = N.covers_of_concepts(lattice.concepts().select("i0"), lattice.context.n_attributes)
    return found.select(F.col("child0").alias("child"), F.col("parent0").alias("parent"))


@register("concepts_by_blocks", Q.base("docs") + "select i intent_mask, n_extent from ext")
def concepts_by_blocks(spark, d):
    """The lattice merged from those of three blocks of rows."""
    return B.concepts_by_blocks(context_of(spark, d, "docs"), 3).concepts.select(F.col("i0").alias("intent_mask"), "n_extent")


# -- labels -------------------------------------------------------------------------------


@register("own_attributes", Q.base("docs") + Q.IDS + Q.OWN + "select i intent_mask, own_attrs from own where own_attrs <> ''")
def own_attributes(spark, d):
    own = L.own_attributes(lattice_of(spark, d, "docs"))
    names = F.array_sort(F.collect_list(F.struct("attr_id", "name"))).getField("name")
    return own.groupBy(F.col("i0").alias("intent_mask")).agg(joined(names).alias("own_attrs"))


@register("own_attributes_by_difference", Q.base("docs") + Q.IDS + Q.OWN + "select i intent_mask, own_attrs from own")
def own_attributes_by_difference(spark, d):
    own = L.own_attributes_by_difference(lattice_of(spark, d, "docs"))
    return own.select(F.col("i0").alias("intent_mask"), joined("own_attrs").alias("own_attrs"))


@register("own_objects", Q.base("docs") + "select i intent_mask, g obj_id from con join obj on r = i")
def own_objects(spark, d):
    lattice = lattice_of(spark, d, "docs")
    own = L.own_objects(lattice).join(lattice.concepts().select("i0"), "i0", "left_semi")
    return own.select(F.col("i0").alias("intent_mask"), F.col("obj_id").cast("bigint"))


@register("own_object_counts", Q.base("order_lines") + Q.IDS + Q.OWN + "select i intent_mask, n_own from own")
def own_object_counts(spark, d):
    return L.own_object_counts(lattice_of(spark, d, "order_lines")).select(F.col("i0").alias("intent_mask"), "n_own")


def labelled(lattice: Lattice, **options) -> DataFrame:
    return L.labelled_concepts(lattice, lattice.with_ids(), **options)


@register("node_colors", Q.base("nation") + Q.IDS + Q.OWN + f"""
select id, {Q.COLOR} color, case when n_extent = 0 then 'lightblue' when n_extent > 1 then 'orange' end color_by_extent from own""")
def node_colors(spark, d):
    own = labelled(lattice_of(spark, d, "nation"))
    return own.select("id", "color", L.color(F.col("n_extent")).alias("color_by_extent"))


@register("labelled_concepts", Q.base("nation") + Q.IDS + Q.OWN + f"""
select id, i intent_mask, n_intent, n_extent, own_attrs, n_own, {Q.COLOR} color from own""")
def labelled_concepts(spark, d):
    return labelled(lattice_of(spark, d, "nation")).select(
        "id", F.col("i0").alias("intent_mask"), "n_intent", "n_extent",
        joined("own_attrs").alias("own_attrs"), "n_own", "color",
    )


@register("full_extents", Q.base("docs") + Q.IDS + "select id, g obj_id from num join obj on r & i = i")
def full_extents(spark, d):
    lattice = lattice_of(spark, d, "docs")
    return L.extents(lattice, lattice.with_ids()).select("id", F.col("obj_id").cast("bigint"))


def _dot_nodes(labels: str) -> Query:
    def run(spark, d):
        lines = dot.dot_lines(lattice_of(spark, d, "nation"), labels)
        return lines.where("section = 1").select(F.col("number").alias("id"), "line")

    return run


register("node_labels_reduced", Q.base("nation") + Q.IDS + Q.OWN + f"select id, {Q.dot_node(*Q.OWN_ITEMS)} line from own")(_dot_nodes("reduced"))
register("node_labels_full", Q.base("nation") + Q.IDS + Q.OWN + f"select id, {Q.dot_node(*Q.ALL_ITEMS)} line from own")(_dot_nodes("full"))


@register("dot_edges", Q.base("brand") + Q.COVERS + Q.IDS + """
select a.id child_id, b.id parent_id from cov join num a on a.i = child join num b on b.i = parent""")
def dot_edges(spark, d):
    lattice = lattice_of(spark, d, "brand")
    return lattice.cover_ids(lattice.with_ids())


@register("dot_lines", Q.base("nation") + Q.COVERS + Q.IDS + Q.OWN + f""",
txt as (select 0 s, 0 id, 0 id2, 'digraph G {{ ' || chr(10) || chr(9) || 'rankdir=BT;' line
        union all select 1, id, 0, {Q.dot_node(*Q.OWN_ITEMS)} from own
        union all select 2, a.id, b.id, chr(9) || a.id || ' -> ' || b.id
                  from cov join num a on a.i = child join num b on b.i = parent
        union all select 3, 0, 0, '}}')
select row_number() over (order by s, id, id2) - 1 as at, line from txt""")
def dot_lines(spark, d):
    """The whole DOT text, one numbered row per line."""
    lines = Scratch(spark, "text").save(dot.dot_lines(lattice_of(spark, d, "nation")), "lines")
    return number_rows(lines, list(dot.SORT), "at").select("at", "line")


@register("dot_full_lines", Q.base("nation") + Q.COVERS + Q.IDS + Q.OWN + f""",
txt as (select 0 s, 0 id, 0 id2, 'digraph G {{ ' || chr(10) || chr(9) || 'rankdir=BT;' line
        union all select 1, id, 0, {Q.dot_node(*Q.ALL_ITEMS)} from own
        union all select 2, a.id, b.id, chr(9) || a.id || ' -> ' || b.id
                  from cov join num a on a.i = child join num b on b.i = parent
        union all select 3, 0, 0, '}}')
select row_number() over (order by s, id, id2) - 1 as at, line from txt""")
def dot_full_lines(spark, d):
    """The whole DOT text with full labels."""
    lines = Scratch(spark, "text").save(dot.dot_lines(lattice_of(spark, d, "nation"), "full"), "lines")
    return number_rows(lines, list(dot.SORT), "at").select("at", "line")


# -- graphs -------------------------------------------------------------------------------


def graph_of(spark, d, source: str, labels: str) -> G.Graph:
    """A lattice written as DOT and read back."""
    return _through_dot(build_lattice(context_of(spark, d, source).saved()), labels)


def _through_dot(lattice: Lattice, labels: str, long: bool = False) -> G.Graph:
    """Read in any layout: labels of many objects are written over several lines, which ``long`` leaves apart."""
    spark = lattice.context.spark
    path = f"{Scratch(spark, 'graph').path}/dot"
    dot.write_dot(dot.dot_lines(lattice, labels), path)
    return dot.read_dot(spark, path, free=True, long=long)


@register("dot_round_trip", Q.base("nation") + Q.IDS + Q.OWN + f"""
select id::varchar id, n_intent, n_extent, own_attrs attrs,
       coalesce((select string_agg(nm, ',' order by g) from obj where r = own.i), '') objs, {Q.COLOR} color from own""")
def dot_round_trip(spark, d):
    nodes = graph_of(spark, d, "nation", "reduced").nodes
    return nodes.select("id", "n_intent", "n_extent", joined("attrs").alias("attrs"), joined("objs").alias("objs"), "color")


@register("dot_free_layout", Q.base("nation") + Q.IDS + Q.OWN + f"""
select id::varchar id, n_intent, n_extent, own_attrs attrs,
       coalesce((select string_agg(nm, ',' order by g) from obj where r = own.i), '') objs, {Q.COLOR} color from own""")
def dot_free_layout(spark, d):
    """The same from a text with several statements a line, and statements over several lines."""
    scratch = Scratch(spark, "free")
    lines = scratch.save(dot.dot_lines(lattice_of(spark, d, "nation")), "lines")
    text = number_rows(lines, list(dot.SORT), "at").groupBy(F.floor(F.col("at") / 3).alias("row")).agg(
        F.array_sort(F.collect_list(F.struct("at", "line"))).getField("line").alias("l")
    ).select("row", F.regexp_replace(F.array_join("l", "; "), ",label=", ",\n  label =\n").alias("line"))
    # a small text of the nation lattice, in order in one file
    text.repartition(1).sortWithinPartitions("row").select("line").write.text(f"{scratch.path}/dot")
    nodes = dot.read_dot(spark, f"{scratch.path}/dot", free=True).nodes
    return nodes.select("id", "n_intent", "n_extent", joined("attrs").alias("attrs"), joined("objs").alias("objs"), "color")


@register("orientation_vote", Q.base("nation") + Q.COVERS + """
select count(*) forward, 0::bigint backward, 'specific_to_general' orientation from cov""")
def orientation_vote(spark, d):
    return G.orientation_votes(graph_of(spark, d, "nation", "reduced"))


@register("topological_layers", Q.base("nation") + Q.COVERS + Q.IDS + """,
lay(i, n) as (select f, 0 from full_ union select cov.parent, lay.n + 1 from lay join cov on cov.child = lay.i)
select num.id::varchar id, max(n)::bigint layer from lay join num using (i) group by num.id""")
def topological_layers(spark, d):
    layers = G.topological_layers(graph_of(spark, d, "nation", "reduced"))
    return layers.select("id", F.col("layer").cast("bigint"))


@register("expand_reduced_to_full", Q.base("nation") + Q.IDS + """
select id::varchar id, 'attribute' kind, m item from num join att on (i >> j::int) & 1 = 1
union all select id::varchar, 'object', nm from num join obj on r & i = i""")
def expand_reduced_to_full(spark, d):
    full = G.expand(graph_of(spark, d, "nation", "reduced"))
    return full.intents.select("id", F.lit("attribute").alias("kind"), "item").unionByName(
        full.extents.select("id", F.lit("object").alias("kind"), "item")
    )


def reversed_edges(graph: G.Graph) -> G.Graph:
    return G.Graph(graph.nodes, graph.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


@register("orientation_reversed", Q.base("nation") + Q.COVERS + """
select 0::bigint forward, count(*) backward, 'general_to_specific' orientation from cov""")
def orientation_reversed(spark, d):
    return G.orientation_votes(reversed_edges(graph_of(spark, d, "nation", "reduced")))


@register("expand_reversed", Q.base("nation") + Q.IDS + """
select id::varchar id, 'attribute' kind, m item from num join att on (i >> j::int) & 1 = 1
union all select id::varchar, 'object', nm from num join obj on r & i = i""")
def expand_reversed(spark, d):
    """A graph whose edges lead from general to specific."""
    full = G.expand(reversed_edges(graph_of(spark, d, "nation", "reduced")))
    return full.intents.select("id", F.lit("attribute").alias("kind"), "item").unionByName(
        full.extents.select("id", F.lit("object").alias("kind"), "item")
    )


@register("expand_broken", Q.base("nation") + Q.COVERS + Q.IDS + Q.OWN + """,
e as (select * from cov where parent <> (select bit_and(i) from con)),
up(x, y) as (select i, i from con union select up.x, e.parent from up join e on e.child = up.y),
gi as (select up.x i, count(distinct m) n from up left join mu on mu.i = up.y group by all),
ge as (select up.y i, count(distinct nm) n from up left join obj on r = up.x group by all)
select 0::bigint bad_ids, (select count(*) from gi where n <> bit_count(i)) bad_intents,
  (select count(*) from ge join ext using (i) where n <> n_extent) bad_extents, 0::bigint lost_attributes, 0::bigint lost_objects,
  0::bigint repeated_ids, (select count(*) from con where i not in (select parent from e)) sources,
  (select count(*) from con where i not in (select child from e)) sinks""")
def expand_broken(spark, d):
    """The checks on a graph that lost the edges into its top."""
    graph = graph_of(spark, d, "nation", "reduced")
    return G.violations(G.expand(G.Graph(graph.nodes, graph.edges.where("dst <> '0'"))))


@register("expand_violations", """select 0::bigint bad_ids, 0::bigint bad_intents, 0::bigint bad_extents, 0::bigint lost_attributes,
  0::bigint lost_objects, 0::bigint repeated_ids, 1::bigint sources, 1::bigint sinks""")
def expand_violations(spark, d):
    return G.violations(G.expand(graph_of(spark, d, "nation", "reduced")))


# -- comparison -----------------------------------------------------------------------------


def renumbered(graph: G.Graph) -> G.Graph:
    """The same lattice under other node names."""
    other = lambda c: F.concat(F.lit("n"), F.lit(100_000) - F.col(c).cast("int"))
    return G.Graph(
        graph.nodes.withColumn("id", other("id")),
        graph.edges.select(other("src").alias("src"), other("dst").alias("dst")),
    )


_SAME_COUNTS = """(select count(*) from con) left_nodes, (select count(*) from con) right_nodes,
       (select count(*) from cov) left_edges, (select count(*) from cov) right_edges"""


@register("compare_same", Q.base("nation") + Q.COVERS + f"""
select {_SAME_COUNTS}, 0::bigint only_left, 0::bigint only_right, 0::bigint ambiguous_signatures,
       0::bigint edges_only_left, 0::bigint edges_only_right, false ambiguous, true equivalent""")
def compare_same(spark, d):
    """A lattice and itself renumbered."""
    graph = graph_of(spark, d, "nation", "full")
    return C.compare_graphs(graph, renumbered(graph)).summary()


@register("compare_missing_edge", Q.base("nation") + Q.COVERS + """
select (select count(*) from con) left_nodes, (select count(*) from con) right_nodes,
       (select count(*) from cov) left_edges, (select count(*) from cov where parent <> (select bit_and(i) from con)) right_edges,
       0::bigint only_left, 0::bigint only_right, 0::bigint ambiguous_signatures,
       (select count(*) from cov where parent = (select bit_and(i) from con)) edges_only_left,
       0::bigint edges_only_right, false ambiguous, false equivalent""")
def compare_missing_edge(spark, d):
    """All edges into the top removed on one side."""
    graph = graph_of(spark, d, "nation", "full")
    fewer = G.Graph(graph.nodes, graph.edges.where("dst <> '0'"))
    return C.compare_graphs(graph, fewer).summary()


@register("compare_edge_differences", Q.base("nation") + Q.COVERS + Q.IDS + """
select 'left' side, a.id::varchar src, b.id::varchar dst from cov join num a on a.i = child join num b on b.i = parent
where parent = (select bit_and(i) from con)""")
def compare_edge_differences(spark, d):
    """The edges that one side lacks, by name."""
    graph = graph_of(spark, d, "nation", "full")
    return C.compare_graphs(graph, G.Graph(graph.nodes, graph.edges.where("dst <> '0'"))).edge_differences()


@register("compare_ambiguous", Q.base("nation") + Q.IDS + """
select 'left' side, x || id::varchar id, n_intent i, n_extent e from num, (values (''), ('copy')) t(x) where n_intent = 1""")
def compare_ambiguous(spark, d):
    """Nodes that share a label: those of one attribute are there twice on the left."""
    graph = graph_of(spark, d, "nation", "full")
    copies = graph.nodes.where("n_intent = 1").withColumn("id", F.concat(F.lit("copy"), "id"))
    found = C.compare_graphs(G.Graph(graph.nodes.unionByName(copies), graph.edges), graph).ambiguous()
    return found.select("side", "id", "sig.i", "sig.e")


@register("compare_different", Q.base("nation") + """,
less as (select g, nm, r & ~1::bigint r from obj), lrw as (select distinct r from less),
con2(i) as (select f & ~1::bigint i from full_ union select con2.i & lrw.r from con2, lrw),
s1 as (select i, coalesce(string_agg(nm, ',' order by nm), '') o from con left join obj on r & i = i group by i),
s2 as (select i, coalesce(string_agg(nm, ',' order by nm), '') o from con2 left join less on r & i = i group by i)
select (select count(*) from con) left_nodes, (select count(*) from con2) right_nodes,
       (select count(*) from (from s1 except from s2)) only_left, (select count(*) from (from s2 except from s1)) only_right,
       false equivalent""")
def compare_different(spark, d):
    """The lattice against the one without its first attribute."""
    context = context_of(spark, d, "nation").saved()
    less = from_masks(
        context.objects.withColumn("m0", F.shiftright("m0", 1)), context.attributes[1:]
    )
    graphs = [_through_dot(build_lattice(c), "full") for c in (context, less)]
    return C.compare_graphs(*graphs).summary().select("left_nodes", "right_nodes", "only_left", "only_right", "equivalent")


@register("compare_correspondence", Q.base("nation") + Q.IDS + """,
sig as (select id, n_intent, n_extent,
               list_sort(coalesce((select list(m) from att where (i >> j::int) & 1 = 1), [])) a,
               list_sort(coalesce((select list(nm) from obj where r & i = i), [])) o from num)
select 'C' || row_number() over (order by n_intent, n_extent, a, o) common, id::varchar left_id, 'n' || (100000 - id) right_id from sig""")
def compare_correspondence(spark, d):
    graph = graph_of(spark, d, "nation", "full")
    return C.compare_graphs(graph, renumbered(graph)).correspondence().select("common", "left_id", "right_id")


def _produced(spark, d) -> tuple[DataFrame, DataFrame]:
    """Graphs of two contexts by three producers: both enumerations, and a broken one
    that loses the edges into the top of ``cust_prio``."""
    nodes, edges = [], []
    for source in ("nation", "cust_prio"):
        context = context_of(spark, d, source).saved()

        def keep(producer, graph, source=source):
            tag = [F.lit(source).alias("dataset"), F.lit(producer).alias("producer")]
            nodes.append(graph.nodes.select(*tag, "*"))
            edges.append(graph.edges.select(*tag, "*"))

        for method in ("join", "subtree"):
            graph = _through_dot(build_lattice(context, method), "full", long=True)
            sized = graph.nodes.withColumn("long", F.lit(None).cast(C.LONG_SET))
            if graph.more is not None:
                sets = Scratch(spark, "produced").save(C.long_sets(graph), "long")  # once for all producers of the graph
                sized = graph.nodes.join(F.broadcast(sets), "id", "left")
            graph = G.Graph(sized, graph.edges)
            keep(method, graph)
        cut = graph.edges.where("dst <> '0'") if source == "cust_prio" else graph.edges
        keep("broken", G.Graph(graph.nodes, cut))
    return reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, edges)


_PAIRS_SQL = """
select * from (values ('nation', 'broken', 'join', true), ('nation', 'broken', 'subtree', true), ('nation', 'join', 'subtree', true),
  ('cust_prio', 'broken', 'join', false), ('cust_prio', 'broken', 'subtree', false), ('cust_prio', 'join', 'subtree', true))
  t(dataset, "left", "right", equivalent)"""


@register("pairwise_matrix", _PAIRS_SQL)
def pairwise_matrix(spark, d):
    return C.pairwise(*_produced(spark, d))


def _case_sql(source: str) -> str:
    """Sinks of a lattice, whole and without the edges into its top."""
    return Q.base(source) + Q.COVERS + """, t as (select bit_and(i) top from con)
select p, case when sinks = 1 then 'OK' else 'CONVERSION_FAILED' end status from (
  select 'whole' p, (select count(*) from con where i not in (select child from cov)) sinks
  union all select 'cut', (select count(*) from con where i not in (select child from cov, t where parent <> top)) from t)"""


_CASES_SQL = f"""select 'nation' dataset_id, p algorithm_id, status from ({_case_sql("nation")})
union all select 'cust_prio', p, status from ({_case_sql("cust_prio")})
union all select 'absent', p, 'MISSING_RAW_DOT' from (values ('whole'), ('cut')) t(p)"""


def _case_graphs(spark, d) -> dict[tuple[str, str], G.Graph]:
    """Graphs with reduced labels by dataset and producer; one producer loses the edges into the top."""
    out = {}
    for source in ("nation", "cust_prio"):
        graph = graph_of(spark, d, source, "reduced")
        out[source, "whole"], out[source, "cut"] = graph, G.Graph(graph.nodes, graph.edges.where("dst <> '0'"))
    return out


@register("normalize_cases", _CASES_SQL)
def normalize_cases(spark, d):
    """Status of every dataset with every producer: is there a graph, and does it expand to a full labelling?"""
    found, scratch = [], Scratch(spark, "cases")
    for (source, producer), graph in _case_graphs(spark, d).items():
        checks = G.violations(G.expand(graph))
        bad = reduce(Column.__or__, [F.col(c) != (1 if c in ("sources", "sinks") else 0) for c in checks.columns])
        case = checks.select(F.lit(source).alias("dataset_id"), F.lit(producer).alias("algorithm_id"), bad.alias("failed"))
        # one row, worked out now: the driver holds the plans of one case at a time
        found.append(scratch.save(case, f"{source}-{producer}"))
    datasets = spark.createDataFrame([("nation",), ("cust_prio",), ("absent",)], "dataset_id string")
    both = ["dataset_id", "algorithm_id"]
    cases = R.cases(datasets, ["whole", "cut"]).join(reduce(DataFrame.unionByName, found), both, "left")
    status = R.normalize_status(F.col("failed").isNotNull(), F.lit(False), F.coalesce("failed", F.lit(False)))
    return cases.select(*both, status.alias("status"))


@register("producer_groups", f"""select 'nation' dataset, 3::bigint n_equivalent
union all select 'cust_prio', (case when status = 'OK' then 3 else 2 end)::bigint from ({_case_sql("cust_prio")}) where p = 'cut'""")
def producer_groups(spark, d):
    """Largest group of producers whose lattices agree, from comparisons of their graphs."""
    nodes, edges = _produced(spark, d)
    nodes = Scratch(spark, "producers").save(nodes, "nodes")
    return C.equivalence_group_sizes(nodes.select("dataset", "producer").distinct(), C.pairwise(nodes, edges))


# -- run tables -------------------------------------------------------------------------------


def runs_of(spark, d) -> DataFrame:
    """Stand-ins for run records: every event is one run of its type on a dataset."""
    e = table(spark, d, "events").select("event_id", "event_type", "user_id", "value", "ts")
    status = F.when(F.col("event_id") % 7 == 0, "FAILED").when(F.col("event_id") % 11 == 0, "TIMEOUT").otherwise("OK")
    return e.select(
        F.col("event_type").alias("algorithm_id"),
        F.concat(F.lit("set"), F.col("user_id") % 16).alias("dataset_id"),
        "event_id", status.alias("status"),
        F.floor(F.abs("value") * 1000).cast("bigint").alias("peak_rss_bytes"),
        (F.col("event_id") * 37).alias("total_written_bytes"), "ts",
    )


_ROLLED = ["peak_rss_bytes", "total_written_bytes"]


@register("run_rollup", f"""with {Q.RUNS}
select algorithm_id, count(*) cases, max(coalesce(peak_rss_bytes, 0))::bigint peak_rss_bytes,
       max(total_written_bytes)::bigint total_written_bytes from runs group by algorithm_id""")
def run_rollup(spark, d):
    return R.roll_up(runs_of(spark, d), _ROLLED)


@register("run_rollup_text", f"""with {Q.RUNS},
t as (select algorithm_id, max(total_written_bytes)::bigint b from runs group by 1)
select algorithm_id, case when b is null then 'NA' when b < 1024 then b || ' B'
  when b < 1024 ** 2 then printf('%.2f KiB', b / 1024) when b < 1024 ** 3 then printf('%.2f MiB', b / 1024 ** 2)
  else printf('%.2f GiB', b / 1024 ** 3) end total_written_bytes from t""")
def run_rollup_text(spark, d):
    rolled = R.roll_up(runs_of(spark, d), _ROLLED)
    return R.formatted(rolled, _ROLLED).select("algorithm_id", "total_written_bytes")


@register("latest_per_key", f"""with {Q.RUNS}
select algorithm_id, dataset_id, event_id, status, peak_rss_bytes from last_runs""")
def latest_per_key(spark, d):
    """The newest run of every algorithm on every dataset."""
    runs = runs_of(spark, d).select("algorithm_id", "dataset_id", "ts", "event_id", "status", "peak_rss_bytes")
    return R.latest(runs, ["algorithm_id", "dataset_id"], "ts").drop("ts")



@register("run_pivot", f"""with {Q.RUNS}
select dataset_id, count(*) filter (status = 'OK') ok, count(*) filter (status <> 'OK') failed,
  {", ".join(f"""coalesce(min(case when algorithm_id = '{a}' then case when status = 'OK' then {c}::varchar else 'FAILED' end end), 'n/a') "{t} {a}" """
             for t, c in (("RAM", "peak_rss_bytes"), ("DISK", "total_written_bytes"))
             for a in ("error", "click", "purchase", "signup", "view"))}
from last_runs group by dataset_id""")
def run_pivot(spark, d):
    """Datasets x (metric, algorithm), the algorithms in natural order, one first."""
    runs = R.latest(runs_of(spark, d), ["algorithm_id", "dataset_id"], "ts")
    order = R.algorithm_order(runs, first="error")
    return R.pivot_runs(runs, {"RAM": "peak_rss_bytes", "DISK": "total_written_bytes"}, order)


@register("natural_sort", """
select row_number() over (order by lower(regexp_extract(s_name, '^[^0-9]*')), regexp_extract(s_name, '[0-9]+')::bigint, s_name) - 1 as at, s_name as name
from supplier""")
def natural_sort(spark, d):
    """Names numbered in natural order (digit runs count by value)."""
    names = table(spark, d, "supplier").select(F.col("s_name").alias("name"))
    return number_rows(names, [X.natural_key(F.col("name")), F.col("name")], "at")


@register("report_round_trip", f"""with {Q.RUNS}
select dataset_id "Dataset", algorithm_id "Algo", status "Status", peak_rss_bytes::varchar "RAM max" from last_runs""")
def report_round_trip(spark, d):
    """A run table written as a Markdown report and parsed back."""
    runs = R.latest(runs_of(spark, d), ["algorithm_id", "dataset_id"], "ts")
    titles = {c: reports.EXECUTION_TITLES[c] for c in ("dataset_id", "algorithm_id", "status", "peak_rss_bytes")}
    lines = reports.table_lines(runs, titles, ["line"])
    head = spark.createDataFrame([(-3, f"## {reports.SECTIONS['execution']}")], "at bigint, line string")
    path = f"{Scratch(spark, 'report').path}/report"
    # a report is a small document for people: one row per algorithm and dataset
    head.unionByName(lines).repartition(1).sortWithinPartitions("at").select("line").write.text(path)
    cells = reports.read_tables(spark, path).select("cells")
    return cells.select(*[F.col("cells").getItem(t).alias(t) for t in titles.values()])


# -- streams ----------------------------------------------------------------------------------


def _object_stream(spark, d, source: str, folder: str) -> Context:
    """The context's objects as a folder of files, to be read as a stream."""
    context = context_of(spark, d, source)
    context.objects.select(F.col("obj_id").cast("bigint"), "name", *M.names("m", context.k)).repartition(
        4, "obj_id"
    ).write.parquet(folder)
    return context


def _streamed(spark, d, source: str) -> Lattice:
    base = Scratch(spark, "stream").path
    context = _object_stream(spark, d, source, f"{base}/objects")
    schema = spark.read.parquet(f"{base}/objects").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/objects")
    state = LatticeState(spark, f"{base}/state", context.attributes)
    query = follow(stream, state, f"{base}/checkpoint")
    query.awaitTermination()
    return state.lattice()


@register("stream_concepts", Q.base("docs") + "select i intent_mask, bit_count(i)::bigint n_intent, n_extent from ext")
def stream_concepts(spark, d):
    """The lattice kept current over micro-batches of arriving objects."""
    lattice = _streamed(spark, d, "docs")
    return lattice.concepts().select(F.col("i0").alias("intent_mask"), "n_intent", "n_extent")


@register("stream_covers", Q.base("order_lines") + Q.COVERS + "select child, parent from cov")
def stream_covers(spark, d):
    lattice = _streamed(spark, d, "order_lines")
    return lattice.covers().select(F.col("child0").alias("child"), F.col("parent0").alias("parent"))


@register("run_status", f"""with {Q.RUNS}
select event_id, case when event_id % 13 = 0 then 'MISSING_INPUT' when event_id % 11 = 0 then 'TIMEOUT'
   when event_id % 7 <> 0 then 'OK' else 'FAILED' end status,
   case when event_id % 11 = 0 then 124 else event_id % 7 end code, least(900, 60 + event_id % 2000) as "limit"
from runs""")
def run_status(spark, d):
    e = runs_of(spark, d)
    late = F.col("event_id") % 11 == 0
    code = R.return_code(late, F.when(F.col("event_id") % 7 == 0, F.lit(0)).otherwise(F.col("event_id") % 7))
    ended = F.when(F.col("event_id") % 7 != 0, F.lit(0)).otherwise(F.lit(1))
    return e.select(
        "event_id",
        R.execution_status(F.col("event_id") % 13 != 0, late, ended, F.lit(True)).alias("status"),
        code.cast("bigint").alias("code"),
        R.effective_timeout(F.lit(900), 60 + F.col("event_id") % 2000).cast("bigint").alias("limit"),
    )


@register("equivalent_groups", f"""with recursive {Q.RUNS},
ok as (select distinct dataset_id, algorithm_id from last_runs where status = 'OK'),
lk as (select a.dataset_id, a.algorithm_id x, b.algorithm_id y from last_runs a join last_runs b using (dataset_id)
       join ok p on p.dataset_id = a.dataset_id and p.algorithm_id = a.algorithm_id
       join ok q on q.dataset_id = a.dataset_id and q.algorithm_id = b.algorithm_id
       where a.algorithm_id <> b.algorithm_id and (a.peak_rss_bytes + b.peak_rss_bytes) % 3 = 0),
r as (select dataset_id, algorithm_id x, algorithm_id y from ok
      union select r.dataset_id, r.x, lk.y from r join lk on lk.dataset_id = r.dataset_id and lk.x = r.y),
s as (select dataset_id, x, count(*) n from r group by 1, 2)
select dataset_id dataset, max(n)::bigint n_equivalent from s group by 1""")
def equivalent_groups(spark, d):
    """Largest group of agreeing algorithms per dataset, from pairwise verdicts."""
    runs = R.latest(runs_of(spark, d), ["algorithm_id", "dataset_id"], "ts")
    ok = runs.where("status = 'OK'").select(F.col("dataset_id").alias("dataset"), F.col("algorithm_id").alias("producer"))
    side = lambda s: runs.select(
        F.col("dataset_id").alias("dataset"), F.col("algorithm_id").alias(s), F.col("peak_rss_bytes").alias(f"{s}_b")
    )
    pairs = side("left").join(side("right"), "dataset").where("left < right").select(
        "dataset", "left", "right", ((F.col("left_b") + F.col("right_b")) % 3 == 0).alias("equivalent")
    )
    return C.equivalence_group_sizes(ok, pairs)
