"""Contexts over the star-schema tables, each with the SQL that states it.

The SQL of a context defines ``inc(g, m)``, the pairs, ``objs(g, nm)``, all objects
with their names and, where it is not all of ``inc.m``, ``atts(m)``, the attributes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptloom.operators.context import Context, attribute_names, from_columns, from_pairs
from conceptloom.scratch import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nation(spark: SparkSession, d: str) -> Context:
    """Nations x order priority/status, kept when frequent: n * 375 >= all orders."""
    orders = table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderstatus")
    kind = F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("m")
    per_customer = orders.groupBy("o_custkey", kind).agg(F.count(F.lit(1)).alias("n"))
    customers = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    counts = (
        per_customer.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("c_nationkey").alias("g"), "m").agg(F.sum("n").alias("n"))
    )
    total = orders.count()
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("g"), "n_name")
    return from_pairs(counts.where(F.col("n") * 375 >= total), "g", "m", objects=nations, name="n_name")


NATION_SQL = """
inc as (select c_nationkey g, o_orderpriority || '/' || o_orderstatus m
        from orders join customer on o_custkey = c_custkey
        group by all having count(*) * 375 >= (select count(*) from orders)),
objs as (select n_nationkey g, n_name nm from nation)"""


def order_lines(spark: SparkSession, d: str) -> Context:
    """Orders x return flag and line status of their lines."""
    pairs = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("g"), F.concat("l_returnflag", "l_linestatus").alias("m")
    )
    return from_pairs(pairs, "g", "m")


ORDER_LINES_SQL = """
inc as (select distinct l_orderkey g, l_returnflag || l_linestatus m from lineitem),
objs as (select distinct g, g::varchar nm from inc)"""


def docs(spark: SparkSession, d: str) -> Context:
    """Documents x language, source and (where labelled) quality and toxicity."""
    documents = table(spark, d, "documents").select(F.col("doc_id").alias("g"), "lang", "source")
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("g"), "quality", "toxic")
    tags = {t: t for t in ("lang", "source", "quality", "toxic")}
    return from_columns(documents.join(labels, "g", "left"), "g", tags)


DOCS_SQL = """
inc as (select doc_id g, 'lang:' || lang m from documents where lang is not null
        union select doc_id, 'source:' || source from documents where source is not null
        union select doc_id, 'quality:' || quality from labels where doc_id in (select doc_id from documents) and quality is not null
        union select doc_id, 'toxic:' || toxic from labels where doc_id in (select doc_id from documents) and toxic is not null),
objs as (select doc_id g, doc_id::varchar nm from documents)"""


def cust_prio(spark: SparkSession, d: str) -> Context:
    """Customers x priorities of their orders."""
    pairs = table(spark, d, "orders").select(F.col("o_custkey").alias("g"), F.col("o_orderpriority").alias("m"))
    return from_pairs(pairs, "g", "m")


CUST_PRIO_SQL = """
inc as (select distinct o_custkey g, o_orderpriority m from orders),
objs as (select distinct g, g::varchar nm from inc)"""


def brand(spark: SparkSession, d: str) -> Context:
    """Brands x part types and size bands, kept where the brand has more such parts
    than the average brand."""
    parts = table(spark, d, "part").select("p_brand", "p_type", "p_size")
    both = F.array("p_type", F.concat(F.lit("size:"), F.floor((F.col("p_size") - 1) / 5).cast("string")))
    counts = (
        parts.select(F.col("p_brand").alias("g"), F.explode(both).alias("m"))
        .groupBy("g", "m").agg(F.count(F.lit(1)).alias("n"))
    )
    brands = parts.select(F.col("p_brand").alias("g")).distinct()
    totals = counts.groupBy("m").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("brands"))
    kept = counts.join(totals, "m").where(F.col("n") * F.col("brands") > F.col("total"))
    return from_pairs(kept, "g", "m", objects=brands)


BRAND_SQL = """
cnt as (select g, m, count(*) n from (
            select p_brand g, p_type m from part
            union all select p_brand, 'size:' || ((p_size - 1) // 5) from part)
        group by g, m),
inc as (select g, m from (select *, sum(n) over (partition by m) t, count(*) over (partition by m) b from cnt)
        where n * b > t),
objs as (select distinct p_brand g, p_brand nm from part)"""


def supplier_brand(spark: SparkSession, d: str) -> Context:
    """Suppliers x brands they sell more often than their average brand."""
    lines = table(spark, d, "lineitem").select("l_suppkey", "l_partkey")
    parts = table(spark, d, "part").select("p_partkey", "p_brand")
    counts = (
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("l_suppkey").alias("g"), F.col("p_brand").alias("m")).agg(F.count(F.lit(1)).alias("n"))
    )
    counts = Scratch(spark, "pairs").save(counts, "sold")  # once: totals, attributes and rows don't read the lines again
    totals = counts.groupBy("g").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("brands"))
    kept = counts.join(totals, "g").where(F.col("n") * F.col("brands") > F.col("total"))
    return from_pairs(kept, "g", "m")


SUPPLIER_BRAND_SQL = """
cnt as (select l_suppkey g, p_brand m, count(*) n from lineitem join part on l_partkey = p_partkey group by all),
inc as (select g, m from (select *, sum(n) over (partition by g) t, count(*) over (partition by g) b from cnt)
        where n * b > t),
objs as (select distinct g, g::varchar nm from inc)"""


def nation_month(spark: SparkSession, d: str) -> Context:
    """Nations x order months (more than 63) with an outstanding number of orders."""
    orders = table(spark, d, "orders").select("o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("m"))
    per_customer = orders.groupBy("o_custkey", "m").agg(F.count(F.lit(1)).alias("n"))
    customers = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    counts = (
        per_customer.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("c_nationkey").alias("g"), "m").agg(F.sum("n").alias("n"))
    )
    totals = counts.groupBy("g").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("months"))
    kept = counts.join(totals, "g").where(F.col("n") * F.col("months") * 10 > F.col("total") * 11)
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("g"), "n_name")
    months = attribute_names(orders, "m")  # also those in which no nation stands out
    return from_pairs(kept, "g", "m", objects=nations, attributes=months, name="n_name")


NATION_MONTH_SQL = """
cnt as (select c_nationkey g, strftime(o_orderdate, '%Y-%m') m, count(*) n
        from orders join customer on o_custkey = c_custkey group by all),
inc as (select g, m from (select *, sum(n) over (partition by g) t, count(*) over (partition by g) b from cnt)
        where n * b * 10 > t * 11),
atts as (select distinct strftime(o_orderdate, '%Y-%m') m from orders),
objs as (select n_nationkey g, n_name nm from nation)"""


@dataclass(frozen=True)
class Source:
    build: Callable[[SparkSession, str], Context]
    sql: str


SOURCES = {
    "nation": Source(nation, NATION_SQL),
    "order_lines": Source(order_lines, ORDER_LINES_SQL),
    "docs": Source(docs, DOCS_SQL),
    "cust_prio": Source(cust_prio, CUST_PRIO_SQL),
    "brand": Source(brand, BRAND_SQL),
    "supplier_brand": Source(supplier_brand, SUPPLIER_BRAND_SQL),
    "nation_month": Source(nation_month, NATION_MONTH_SQL),
}
