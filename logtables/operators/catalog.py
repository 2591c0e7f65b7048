"""The shared catalog of patterns.

A pattern may be held by a third of all lines, so catalogs are always pre-aggregated by pattern
before anything is joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtables.functions.templates import template_key, wildcard_count


def template_catalog(mined: DataFrame, *by: str) -> DataFrame:
    """One row per pattern of mined messages or records: key, token and wildcard counts, first line,
    number of lines. ``by`` names columns to keep apart, such as ``node_id`` for catalogs per node."""
    pattern = F.col("pattern")
    return (
        mined.groupBy(*by, "pattern")
        .agg(F.min("seq").alias("first_seq"), F.count("*").alias("n_lines"))
        .select(
            *by,
            template_key(pattern).alias("template_key"),
            "pattern",
            F.when(pattern == "", 0).otherwise(F.size(F.split(pattern, " "))).alias("token_count"),
            wildcard_count(pattern).alias("n_wildcards"),
            "first_seq",
            "n_lines",
        )
    )


def new_templates(mined: DataFrame, known: DataFrame) -> DataFrame:
    """Catalog rows of the mined patterns whose ``template_key`` the table ``known`` lacks.

    Patterns are distinct before any join, so no key is hot, and keys are joined, not pattern texts. Which of
    them are known is asked by a semi join, as Spark can test a large ``known`` with a Bloom filter of the few
    keys before it moves a row of it; the rest of the work is as small as the mined patterns.
    """
    found = template_catalog(mined)
    met = known.select("template_key").join(found.select("template_key"), "template_key", "left_semi")
    return found.join(met, "template_key", "left_anti")


def merge_catalogs(*catalogs: DataFrame) -> DataFrame:
    """Union of catalogs by exact pattern; ``node_id``, where present, is collected per pattern.

    A table may itself hold the catalogs of many nodes.
    """
    merged = catalogs[0]
    for catalog in catalogs[1:]:
        merged = merged.unionByName(catalog, allowMissingColumns=True)
    nodes = [F.array_sort(F.collect_set("node_id")).alias("nodes")] if "node_id" in merged.columns else []
    return merged.groupBy("pattern").agg(
        F.first("template_key").alias("template_key"),
        F.first("token_count").alias("token_count"),
        F.first("n_wildcards").alias("n_wildcards"),
        F.min("first_seq").alias("first_seq"),
        F.sum("n_lines").alias("n_lines"),
        *nodes,
    )
