"""The registered queries of this subpackage: name -> Spark query, and SQL answers where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from conceptloom.llm import (
    collocations, decontamination, exact_dedup, language_id, licenses, mixing, odd_sketch_dedup, simhash_dedup, suffix_tree,
    token_alignment, token_counts, toxicity, wrappers,
)
from conceptloom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_counts(spark, d):
    return token_counts.token_counts(table(spark, d, "documents"))


def op2_suffix_tree_scores(spark, d):
    return suffix_tree.scores(spark, table(spark, d, "documents"))


def op3_license_scan(spark, d):
    return licenses.scan(table(spark, d, "documents"))


def op4_decontamination(spark, d):
    return decontamination.matches(spark, table(spark, d, "documents"), table(spark, d, "benchmark"))


def op5_toxicity(spark, d):
    return toxicity.scores(spark, table(spark, d, "documents"), table(spark, d, "labels"))


def op6_mixing(spark, d):
    return mixing.mix(table(spark, d, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "repeats", "position"
    )


def op7_html_main_text(spark, d):
    return wrappers.main_texts(spark, table(spark, d, "pages"))


def op8_simhash_near_dedup(spark, d):
    return simhash_dedup.near_duplicates(spark, table(spark, d, "documents"))


def op9_exact_dedup(spark, d):
    return exact_dedup.classes(spark, table(spark, d, "documents"))


def op10_language_id(spark, d):
    return language_id.languages(spark, table(spark, d, "documents"))


def op11_token_alignment(spark, d):
    return token_alignment.alignment(spark, table(spark, d, "documents"))


def op12_collocations(spark, d):
    return collocations.collocations(spark, table(spark, d, "documents"))


def op13_odd_sketch_near_dedup(spark, d):
    return odd_sketch_dedup.near_duplicates(spark, table(spark, d, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_token_counts, op2_suffix_tree_scores, op3_license_scan, op4_decontamination, op5_toxicity, op6_mixing,
    op7_html_main_text, op8_simhash_near_dedup, op9_exact_dedup, op10_language_id, op11_token_alignment,
    op12_collocations, op13_odd_sketch_near_dedup,
)}
SQL: dict[str, str] = {"op6_mixing": mixing.SQL, "op9_exact_dedup": exact_dedup.SQL, "op12_collocations": collocations.SQL,
                      "op13_odd_sketch_near_dedup": odd_sketch_dedup.SQL}
