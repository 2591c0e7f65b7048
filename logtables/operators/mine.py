"""Template mining per chunk, and the records that result from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logtables.functions.templates import (
    THRESHOLD,
    mined_group,
    template_key,
    variables_of,
)
from logtables.functions.text import once, tokens


def tokenize(messages: DataFrame) -> DataFrame:
    """Add ``tokens`` and ``token_count``."""
    return messages.withColumn("tokens", tokens(F.col("message"))).withColumn("token_count", F.size("tokens"))


def mine_templates(messages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Give each message the template it ends up in.

    ``messages`` has ``chunk_id``, ``seq`` (unique within a chunk) and ``message``; all columns are
    kept. Added: ``tokens``, ``token_count``, ``pattern``, ``pattern_tokens``, ``template_key`` and
    ``opened_seq``, the ``seq`` of the line that opened the template.

    One shuffle, by chunk and token count. The whole message travels with it, so the result needs
    no join back. A group never exceeds the chunk size.
    """
    if "template_key" in messages.columns:
        raise ValueError("messages are mined already")
    payload = ["seq", "tokens"] + [c for c in messages.columns if c not in ("seq", "chunk_id")]
    # Rows are dealt before they are gathered: gathered first, whole tasks would be sorted and their arrays moved.
    groups = (
        tokenize(messages)
        .repartition("chunk_id", "token_count")
        .groupBy("chunk_id", "token_count")
        .agg(F.sort_array(F.collect_list(F.struct(*payload))).alias("lines"))
        .withColumn("mined", mined_group(F.col("lines"), threshold))
    )
    lines = F.col("lines")

    def named(template: Column) -> Column:
        return F.struct(
            template["tokens"].alias("pattern_tokens"),
            F.array_join(template["tokens"], " ").alias("pattern"),
            F.get(lines, template["opened"])["seq"].alias("opened_seq"),
        )

    def keyed(template: Column) -> Column:
        return template.withField("template_key", template_key(template["pattern"]))

    templates = F.transform(F.transform(F.col("mined")["templates"], named), keyed)
    groups = groups.withColumn("templates", templates)
    members = F.transform(
        F.col("mined")["assigned"],
        lambda k, i: F.struct(F.get(lines, i).alias("line"), F.get(F.col("templates"), k).alias("template")),
    )
    # The outer form, as the inner one would test the size of the array by folding it a second time.
    mined = groups.select("chunk_id", "token_count", F.inline_outer(members))
    kept = [F.col("chunk_id") if c == "chunk_id" else F.col("line")[c].alias(c) for c in messages.columns]
    return mined.select(
        *kept,
        F.col("line")["tokens"].alias("tokens"),
        "token_count",
        *[F.col("template")[c].alias(c) for c in ("pattern", "pattern_tokens", "template_key", "opened_seq")],
    )


def extract_variables(mined: DataFrame) -> DataFrame:
    """Records: the message text is replaced by its template and the tokens at its wildcards."""
    variables = variables_of(F.col("tokens"), F.col("pattern_tokens"))
    return mined.withColumn("variables", once(variables)).drop("message", "tokens", "pattern_tokens")


def chunk_template_ids(mined: DataFrame, imported: DataFrame | None = None) -> DataFrame:
    """Dense template numbers per chunk: ``chunk_id, template_id, pattern``.

    Numbers follow token count, then opening order; equal patterns share one. ``imported``
    (``chunk_id, pattern, position``) lists patterns known before the chunk was mined; those come
    first, in order of position.
    """
    own = mined.select(
        "chunk_id",
        "pattern",
        F.struct(F.lit(1).alias("own"), F.col("token_count").cast("bigint").alias("major"), "opened_seq").alias("rank"),
    )
    if imported is not None:
        known = imported.select(
            "chunk_id",
            "pattern",
            F.struct(
                F.lit(0).alias("own"),
                F.col("position").cast("bigint").alias("major"),
                F.lit(0).cast("bigint").alias("opened_seq"),
            ).alias("rank"),
        )
        own = own.unionByName(known)
    number = F.row_number().over(W.partitionBy("chunk_id").orderBy("rank")) - 1
    return (
        own.groupBy("chunk_id", "pattern")
        .agg(F.min("rank").alias("rank"))
        .select("chunk_id", number.alias("template_id"), "pattern")
    )
