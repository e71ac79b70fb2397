"""SQL statements that answer the registered queries another way.

They enumerate by a recursive ``UNION`` of row intersections, find covers by the
definition (nothing lies between), and never use the engine's own methods.
"""

from __future__ import annotations

from conceptloom.plans.contexts import SOURCES


def base(source: str, concepts: bool = True) -> str:
    """CTEs: att(m, j), obj(g, nm, r), rws(r, n), full_(f), con(i), ext(i, n_extent)."""
    s = SOURCES[source].sql.strip()
    atts = "" if "atts as" in s else ", atts as (select distinct m from inc)"
    wide = source == "nation_month"
    t = "hugeint" if wide else "bigint"
    out = f"""with recursive {s}{atts},
att as (select m, row_number() over (order by m) - 1 j from atts),
obj as (select objs.g, objs.nm, coalesce(bit_or(1::{t} << j::int), 0::{t}) r
        from objs left join inc on objs.g = inc.g left join att on inc.m = att.m group by objs.g, objs.nm),
rws as (select r, count(*) n from obj group by r),
full_ as (select coalesce(sum(1::{t} << j::int), 0)::{t} f from att)"""
    if concepts:
        out += """,
con(i) as (select f i from full_ union select con.i & rws.r from con, rws),
ext as (select i, coalesce(sum(n), 0)::bigint n_extent from con left join rws on rws.r & i = i group by i)"""
    return out


COVERS = """,
cov as (select a.i child, b.i parent from con a join con b on a.i <> b.i and (a.i & b.i) = b.i
        where not exists (select 1 from con c where c.i <> a.i and c.i <> b.i
                          and (a.i & c.i) = c.i and (c.i & b.i) = b.i))"""

# Least closures above each concept: usable where all triples are too many.
COVERS_BY_CLOSURE = """,
cand as (select distinct con.i parent, coalesce(x.d, f) child
         from con cross join full_ join att on (con.i >> j::int) & 1 = 0
         left join (select con.i, j, bit_and(r) d from con join rws on rws.r & con.i = con.i
                    join att on (con.i >> j::int) & 1 = 0 and (r >> j::int) & 1 = 1 group by con.i, j) x
           on x.i = con.i and x.j = att.j),
cov as (select child, parent from cand a where not exists
        (select 1 from cand b where b.parent = a.parent and b.child <> a.child and (a.child & b.child) = b.child))"""

IDS = """,
num as (select i, n_extent, bit_count(i)::bigint n_intent, row_number() over (order by bit_count(i), i) - 1 id from ext)"""

OWN = """,
mu as (select m, j, coalesce(bit_and(r), any_value(f)) i from att cross join full_ left join rws on (r >> j::int) & 1 = 1 group by m, j),
own as (select num.id, num.i, n_intent, n_extent,
               coalesce((select string_agg(m, ',' order by j) from mu where mu.i = num.i), '') own_attrs,
               coalesce((select n from rws where r = num.i), 0)::bigint n_own from num)"""

COLOR = "case when n_own = 0 then 'lightblue' when n_own > 1 then 'orange' end"


def names(mask: str, sep: str = ",") -> str:
    return f"coalesce((select string_agg(m, '{sep}' order by j) from att where ({mask} >> j::int) & 1 = 1), '')"


def escaped(c: str) -> str:
    return f"regexp_replace({c}, '([\\\\\"{{}}|<>])', '\\\\\\1', 'g')"


def dot_node(attr_items: str, obj_items: str) -> str:
    return (
        f"id || ' [shape=record,style=filled' || coalesce(',fillcolor=' || ({COLOR}), '') || ',label=\"{{' || id "
        f"|| ' (I: ' || n_intent || ', E: ' || n_extent || ')|' || {attr_items} || '|' || {obj_items} || '}}\"];'"
    )


OWN_ITEMS = (
    f"coalesce((select string_agg({escaped('m')} || '\\n', '' order by j) from mu where mu.i = own.i), '')",
    f"coalesce((select string_agg({escaped('nm')} || '\\n', '' order by g) from obj where obj.r = own.i), '')",
)
ALL_ITEMS = (
    f"coalesce((select string_agg({escaped('m')} || '\\n', '' order by j) from att where (own.i >> j::int) & 1 = 1), '')",
    f"coalesce((select string_agg({escaped('nm')} || '\\n', '' order by g) from obj where obj.r & own.i = own.i), '')",
)

# Stand-ins for runs: algorithm, dataset and metrics taken from the event stream.
RUNS = """runs as (
  select event_type algorithm_id, 'set' || (user_id % 16) dataset_id, event_id,
         case when event_id % 7 = 0 then 'FAILED' when event_id % 11 = 0 then 'TIMEOUT' else 'OK' end status,
         floor(abs(value) * 1000)::bigint peak_rss_bytes, event_id * 37 total_written_bytes, ts
  from events),
last_runs as (select * from (select *, row_number() over (partition by algorithm_id, dataset_id order by ts desc, event_id desc) k from runs) where k = 1)"""
