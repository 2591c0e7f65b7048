"""Queries over records: filter, reconstruct, search, render. No shuffle, unless a catalog is joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtables.functions.syslog import iso_time, short_time
from logtables.functions.templates import UNKNOWN, filled
from logtables.functions.text import contains_ignoring_case, tokens
from logtables.operators.encode import MISSING


def filter_template(records: DataFrame, template_key: str) -> DataFrame:
    """Records of one template. The test reaches the Parquet scan, whose files are sorted by key."""
    return records.where(F.col("template_key") == template_key)


def reconstruct(records: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """Add ``message``: the pattern with the variables put back, whitespace runs as single blanks.

    Archived records carry their pattern. For records without, ``templates`` is looked up by key;
    an unknown key gives ``UNKNOWN``. No hint on that join: Spark broadcasts a catalog whose size
    allows it and otherwise splits hot keys, which a left join permits.
    """
    if templates is not None:
        patterns = templates.select("template_key", "pattern").dropDuplicates(["template_key"])
        records = records.drop("pattern").join(patterns, "template_key", "left")
        records = records.withColumn("pattern", F.coalesce("pattern", F.lit(UNKNOWN)))
    return records.withColumn("message", filled(F.col("pattern"), F.col("variables")))


def _shown(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(MISSING))


def search(records: DataFrame, text: str) -> DataFrame:
    """Reconstructed records that contain ``text``, ignoring case, anywhere in header or message."""
    # The searched columns, in order, joined by blanks.
    searched = ["hostname", "app_name", "procid", "msgid", "structured_data", "message", "priority", "node_id"]
    return records.where(contains_ignoring_case(F.concat_ws(" ", *map(_shown, searched)), text))


def render(records: DataFrame) -> DataFrame:
    """Add ``rendered``: a reconstructed record as a syslog line behind its node, times in UTC."""
    # Times have millisecond precision, as archived.
    when = F.timestamp_millis(F.unix_millis("event_ts"))
    priority = F.col("priority").cast("string")
    head = [F.lit("["), _shown("node_id"), F.lit("] <"), priority, F.lit(">")]
    rest = ["hostname", "app_name", "procid", "msgid"]
    structured = F.concat(
        *head,
        F.lit("1 "),
        F.concat_ws(
            " ",
            F.concat(iso_time(when), F.lit("+00:00")),
            *map(_shown, rest),
            F.concat(F.lit("["), _shown("structured_data"), F.lit("]")),
            F.col("message"),
        ),
    )
    plain = F.concat(
        *head, F.concat_ws(" ", short_time(when), _shown("hostname"), F.col("message"))
    )
    return records.withColumn("rendered", F.when(F.col("is_rfc5424"), structured).otherwise(plain))


#: Header fields that a message and its record are compared by, beside time and text.
COMPARED = ["priority", "hostname", "app_name", "procid", "msgid", "structured_data", "is_rfc5424"]


def compared_rows(messages: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Messages and reconstructed records as keys and a hash of their content (``content``), and the names of
    the keys: node, seq and, if both sides have it, ``batch_id``."""
    keys = ["node", "seq", *(["batch_id"] if "batch_id" in messages.columns and "batch_id" in records.columns else [])]

    def hashed(rows: DataFrame, text: Column) -> DataFrame:
        # A hash skips nulls, so it also gets the flags that tell which fields are null.
        missing = [F.col(name).isNull().alias(f"no_{name}") for name in COMPARED]
        content = F.struct(*COMPARED, *missing, F.unix_millis("event_ts").alias("ms"), text.alias("text"))
        return rows.select(F.coalesce("node_id", F.lit(MISSING)).alias("node"), *keys[1:], F.xxhash64(content).alias("content"))

    sent = hashed(messages, F.array_join(tokens(F.col("message")), " "))
    return sent, hashed(reconstruct(records), F.col("message")), keys


def compared_counts(sent: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """One row of counts that compares the two sides of :func:`compared_rows`, joined by key."""

    def by_key(rows: DataFrame, side: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.max("content").alias(side), F.min("content").alias(f"other_{side}"), F.count("*").alias(f"n_{side}"))

    both = by_key(sent, "sent").join(by_key(kept, "kept"), keys, "full")
    differs = (F.col("sent") != F.col("kept")) | (F.col("other_sent") != F.col("other_kept"))
    extra = F.greatest(F.lit(0), F.col("n_kept") - F.coalesce("n_sent", F.lit(1)))
    return both.agg(
        F.coalesce(F.sum("n_sent"), F.lit(0)).alias("n_messages"),
        F.coalesce(F.sum("n_kept"), F.lit(0)).alias("n_records"),
        F.coalesce(F.sum(extra), F.lit(0)).alias("n_duplicate"),
        F.count_if(F.col("kept").isNull()).alias("n_missing"),
        F.count_if(F.col("sent").isNull()).alias("n_extra"),
        F.count_if(differs).alias("n_different"),
    )


def roundtrip_check(messages: DataFrame, records: DataFrame) -> DataFrame:
    """One row of counts that compares messages with reconstructed records, joined on node and seq (and
    ``batch_id``, if both sides have it). ``n_duplicate`` counts records beyond one per message.

    A message equals its record if header fields and event time (in milliseconds) agree and the
    texts agree up to whitespace. :func:`logtables.plans.verify.verify_archive` gives the same for large archives.
    """
    return compared_counts(*compared_rows(messages, records))
