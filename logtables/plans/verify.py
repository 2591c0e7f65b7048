"""Compare an archive with the messages it was made of, without joining rows that agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtables.operators.query import compared_counts, compared_rows
from logtables.sources.scratch import scratch_dir

#: Numbers in one span. A span of a node is the same size however many rows the node has.
SPAN = 1 << 16


def span_sums(rows: DataFrame, keys: list[str], side: str, span: int = SPAN) -> DataFrame:
    """Per node and span of numbers: rows, and the sums of both halves of the rows' hashes.

    Sums do not depend on the order and, other than an exclusive or, tell repeated rows. Halves keep them far
    from the limits of a long.
    """
    places = [name for name in keys if name != "seq"]
    mark = F.xxhash64(*keys, "content")
    return rows.groupBy(*places, F.expr(f"seq div {span}").alias("span")).agg(
        F.count("*").alias(f"n_{side}"),
        F.sum(mark.bitwiseAND(F.lit(0xFFFFFFFF))).alias(f"low_{side}"),
        F.sum(F.shiftright(mark, 32)).alias(f"high_{side}"),
    )


def compare_spans(messages: DataFrame, records: DataFrame, span: int = SPAN) -> DataFrame:
    """Per node and span: ``n_sent`` messages, ``n_kept`` records, and whether they are the ``same``.

    Each side is combined before the shuffle, which moves one row per span and task.
    """
    sent, kept, keys = compared_rows(messages, records)
    places = [*(name for name in keys if name != "seq"), "span"]
    both = span_sums(sent, keys, "sent", span).join(span_sums(kept, keys, "kept", span), places, "full")
    equal = F.lit(True)
    for name in ("n", "low", "high"):
        equal = equal & (F.col(f"{name}_sent") == F.col(f"{name}_kept"))
    count = [F.coalesce(f"n_{side}", F.lit(0)).alias(f"n_{side}") for side in ("sent", "kept")]
    return both.select(*places, *count, F.coalesce(equal, F.lit(False)).alias("same"))


def verify_archive(messages: DataFrame, records: DataFrame, span: int = SPAN) -> DataFrame:
    """The counts of :func:`logtables.operators.query.roundtrip_check`, one row.

    Spans are compared first, by sums of hashes; only the rows of spans that differ are joined. If all agree,
    no row moves at all. Rows without a number never agree. Both sides are read a second time if a span differs.
    """
    spark = messages.sparkSession
    path = scratch_dir(spark, "spans")
    compared = compare_spans(messages, records, span)
    compared.write.parquet(path)
    spans = spark.read.schema(compared.schema).parquet(path)
    total = spans.agg(F.coalesce(F.sum("n_sent"), F.lit(0)).alias("n_messages"), F.coalesce(F.sum("n_kept"), F.lit(0)).alias("n_records"))
    wrong = spans.where("not same")
    if wrong.isEmpty():
        return total.select("*", *[F.lit(0).cast("long").alias(name) for name in ("n_duplicate", "n_missing", "n_extra", "n_different")])
    sent, kept, keys = compared_rows(messages, records)
    places = [*(name for name in keys if name != "seq"), "span"]
    asked = wrong.select(*[F.col(name).alias(f"_{name}") for name in places]).distinct()

    def of_wrong(rows: DataFrame) -> DataFrame:
        spanned = rows.withColumn("span", F.expr(f"seq div {span}"))
        matches = F.lit(True)
        for name in places:
            matches = matches & F.col(name).eqNullSafe(F.col(f"_{name}"))
        return spanned.join(asked, matches, "left_semi").drop("span")

    counts = compared_counts(of_wrong(sent), of_wrong(kept), keys).drop("n_messages", "n_records")
    both = total.unionByName(counts, allowMissingColumns=True)
    return both.agg(*[F.max(name).alias(name) for name in both.columns])
