"""Size reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtables.operators.query import reconstruct
from logtables.sources.archive import archived_bytes


def raw_size(lines: DataFrame) -> DataFrame:
    """Number of lines and their UTF-8 bytes, one row."""
    return lines.agg(
        F.count("*").alias("n_lines"), F.coalesce(F.sum(F.octet_length("line")), F.lit(0)).alias("raw_bytes")
    )


def size_report(lines: DataFrame, records: DataFrame, path: str) -> DataFrame:
    """One row: lines, raw and archived bytes, their ratio, savings in percent, chunks.

    Archived bytes are those of all files of the archive at ``path``.
    """
    parts = [
        raw_size(lines),
        archived_bytes(lines.sparkSession, path),
        records.agg(F.count_distinct("chunk_id").alias("n_chunks")),
    ]
    names = [name for part in parts for name in part.columns]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    report = rows.agg(*[F.max(name).alias(name) for name in names])
    raw, kept = F.col("raw_bytes"), F.col("archived_bytes")
    return report.withColumns(
        {"ratio": F.round(raw / kept, 2), "savings_percent": F.round((1 - kept / raw) * 100, 1)}
    )


def template_report(records: DataFrame, k: int | None = None) -> DataFrame:
    """Per template: lines, message bytes, bytes of variables, bytes saved by keeping one
    pattern and the variables.

    ``k`` keeps the templates with the most message bytes.
    """
    sized = reconstruct(records).select(
        "template_key",
        "pattern",
        F.octet_length("message").alias("message_bytes"),
        F.aggregate(
            "variables", F.lit(0).cast("bigint"), lambda total, v: total + F.octet_length(v)
        ).alias("variable_bytes"),
    )
    stored = F.col("variable_bytes") + F.octet_length("pattern")
    report = (
        sized.groupBy("template_key", "pattern")
        .agg(
            F.count("*").alias("n_lines"),
            F.sum("message_bytes").alias("message_bytes"),
            F.sum("variable_bytes").alias("variable_bytes"),
        )
        .withColumn("saved_bytes", F.col("message_bytes") - stored)
    )
    return report if k is None else report.orderBy(F.desc("message_bytes"), "template_key").limit(k)


#: Templates that a summary of heavy ones holds. It passes through the driver, so this is a bound, not a share.
HEAVY = 4096


def heavy_state(records: DataFrame, before: DataFrame | None = None, most: int = HEAVY) -> DataFrame:
    """A summary of the templates with most message bytes, of ``records`` and what ``before`` tells of earlier ones.

    Rows ``template_key, weight``: at most ``most`` templates, each with at least ``weight`` bytes. The row without
    a key says how much any template may have beyond its weight, or at all if it is not listed: when more than
    ``most`` would be listed, the weight of the next one is taken off all, which keeps summaries mergeable in any
    order. ``most`` + 1 rows pass through the driver.
    """
    sized = reconstruct(records).groupBy("template_key").agg(F.sum(F.octet_length("message")).alias("weight"))
    sized = sized.where("template_key is not null")
    return merge_heavy(sized if before is None else sized.unionByName(before), most=most)


def merge_heavy(*states: DataFrame, most: int = HEAVY) -> DataFrame:
    """Summaries of several batches or tables as one."""
    together = states[0]
    for state in states[1:]:
        together = together.unionByName(state)
    merged = together.groupBy("template_key").agg(F.sum("weight").alias("weight"))
    # The row without a key comes first.
    listed = merged.orderBy(F.col("template_key").isNotNull(), F.desc("weight"), "template_key").limit(most + 2).collect()
    beyond = sum(r["weight"] for r in listed if r["template_key"] is None)
    listed = [r for r in listed if r["template_key"] is not None]
    cut = listed[most]["weight"] if len(listed) > most else 0
    rows = [(None, beyond + cut), *[(r["template_key"], r["weight"] - cut) for r in listed[:most] if r["weight"] > cut]]
    return together.sparkSession.createDataFrame(rows, "template_key string, weight long")


def heavy_templates(records: DataFrame, state: DataFrame, k: int) -> DataFrame:
    """The ``k`` templates with the most message bytes, as :func:`template_report` gives them, from the summary
    ``state`` of all ``records``.

    Only templates that can be among them are read, by a test that reaches the sorted files. If the summary
    cannot tell them apart from templates that it does not list, all are read.
    """
    rows = state.collect()
    beyond = sum(r["weight"] for r in rows if r["template_key"] is None)
    weights = sorted((r["weight"] for r in rows if r["template_key"] is not None), reverse=True)
    least = weights[k - 1] if 0 < k <= len(weights) else 0
    if beyond and least <= beyond:
        return template_report(records, k)
    wanted = [r["template_key"] for r in rows if r["template_key"] is not None and r["weight"] + beyond >= least]
    return template_report(records.where(F.col("template_key").isin(wanted)), k)
