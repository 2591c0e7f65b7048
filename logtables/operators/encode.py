"""The dictionary and difference encodings of a chunk as tables.

Everything here is per chunk, so one shuffle by ``chunk_id`` serves all windows and groupings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The fields that share one string pool, in order of first use within a record.
POOLED_FIELDS = ["hostname", "app_name", "procid", "msgid", "structured_data", "node_id"]
MISSING = "-"


def stored_order(records: DataFrame) -> DataFrame:
    """Add ``row_pos``, the 0-based position in the chunk: token count, template opening, arrival."""
    window = W.partitionBy("chunk_id").orderBy("token_count", "opened_seq", "seq")
    return records.withColumn("row_pos", F.row_number().over(window) - 1)


def _chunk_pools(records: DataFrame) -> DataFrame:
    """One row per chunk: its records in stored order and ``pool``, its distinct strings by first use.

    Strings are numbered by first use: over the rows in stored order, and within a row by field. A chunk is one
    array, bounded by the chunk size, so a task holds each record once and sorts no rows per field.
    """
    stored = F.sort_array(F.collect_list(F.struct("token_count", "opened_seq", "seq", *POOLED_FIELDS)))
    fields = F.flatten(F.transform("stored", lambda r: F.array(*[r[name] for name in POOLED_FIELDS])))
    chunks = records.groupBy("chunk_id").agg(stored.alias("stored"))
    return chunks.withColumn("pool", F.array_distinct(F.array_compact(fields)))


def string_pool(records: DataFrame) -> DataFrame:
    """``chunk_id, string_id, value``: the distinct strings of each chunk."""
    return _chunk_pools(records).select("chunk_id", F.posexplode("pool").alias("string_id", "value"))


def encode_strings(records: DataFrame) -> DataFrame:
    """``chunk_id, seq, row_pos`` and the number of the string of each pooled field; null stays null."""

    def numbered(r: Column, k: Column) -> Column:
        numbers = [
            (F.array_position("pool", r[name]) - 1).cast("int").alias(f"{name}_id") for name in POOLED_FIELDS
        ]
        return F.struct(r["seq"].alias("seq"), k.alias("row_pos"), *numbers)

    return _chunk_pools(records).select("chunk_id", F.inline(F.transform("stored", numbered)))


def resolve_strings(encoded: DataFrame, strings: DataFrame) -> DataFrame:
    """Put texts in place of string numbers, ``-`` for a null or unknown number.

    The pool of a chunk has at most six strings per record of the chunk. It is joined once, as an
    array, and indexed six times.
    """
    numbered = F.sort_array(F.collect_list(F.struct("string_id", "value")))
    pools = strings.groupBy("chunk_id").agg(F.transform(numbered, lambda s: s["value"]).alias("pool"))
    others = [c for c in encoded.columns if not (c.endswith("_id") and c[:-3] in POOLED_FIELDS)]
    texts = [
        F.coalesce(F.get("pool", F.col(f"{name}_id")), F.lit(MISSING)).alias(name) for name in POOLED_FIELDS
    ]
    return encoded.join(pools, "chunk_id", "left").select(*others, *texts)


def arrival_gaps(records: DataFrame) -> DataFrame:
    """Event time in milliseconds and its difference to the row before, per chunk in stored order.

    The first row of a chunk keeps its time.
    """
    timed = stored_order(records).withColumn("event_ms", F.unix_millis("event_ts"))
    before = F.lag("event_ms", 1, 0).over(W.partitionBy("chunk_id").orderBy("row_pos"))
    return timed.select("chunk_id", "seq", "row_pos", "event_ms", (F.col("event_ms") - before).alias("gap_ms"))


def times_from_gaps(gaps: DataFrame) -> DataFrame:
    """The inverse of ``arrival_gaps``."""
    running = W.partitionBy("chunk_id").orderBy("row_pos").rowsBetween(W.unboundedPreceding, 0)
    return gaps.withColumn("event_ms", F.sum("gap_ms").over(running))
