"""Chunk assignment: which messages are mined together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logtables.functions.text import with_value

# Messages per chunk in continuous collection, and in a bulk load.
LIVE_CHUNK = 10
BULK_CHUNK = 1000

SPAN_BITS = 16
# A long marks 64 order values, so a span has 1,024 of them.
WORD_BITS = 6


def _total_before(amount: str, keys: list[str], order: str) -> Column:
    window = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.sum(amount).over(window), F.lit(0))


def _span_offsets(counts: DataFrame, key: str) -> DataFrame:
    """The rows before each span, of ``_n`` rows, and all rows of its key; summed in two levels."""
    counts = counts.withColumn("_block", F.shiftright("_span", SPAN_BITS))
    blocks = counts.groupBy(key, "_block").agg(F.sum("_n").alias("_m"))
    blocks = blocks.select(
        key,
        "_block",
        _total_before("_m", [key], "_block").alias("_ahead"),
        F.sum("_m").over(W.partitionBy(key)).alias("_total"),
    )
    return (
        counts.withColumn("_within", _total_before("_n", [key, "_block"], "_span"))
        .join(blocks, [key, "_block"])
        .select(key, "_span", (F.col("_ahead") + F.col("_within")).alias("_offset"), "_total")
    )


def position_within(rows: DataFrame, key: str, order: str, name: str, total: str | None = None) -> DataFrame:
    """Exact 0-based position of each row among the rows of its key, by the unique long ``order``.

    A plain ``row_number`` over the key would put a whole key into one task. Here rows are numbered
    within spans of 65,536 order values, which bounds every group whatever the skew, and the rows
    before each span are added from a small table of span counts, itself summed in two levels.
    ``total`` names a further column for the number of rows of the key.
    """
    # The coalesce makes the span non-null, so both uses of the counts get one plan and run once.
    marked = rows.withColumn("_span", F.coalesce(F.shiftright(order, SPAN_BITS), F.lit(0)))
    offsets = _span_offsets(marked.groupBy(key, "_span").agg(F.count("*").alias("_n")), key)
    local = F.row_number().over(W.partitionBy(key, "_span").orderBy(order)) - 1
    totals = [F.col("_total").alias(total)] if total else []
    return (
        marked.withColumn("_local", local)
        .join(offsets, [key, "_span"])
        .select(*rows.columns, (F.col("_offset") + F.col("_local")).alias(name), *totals)
    )


def position_by_bits(rows: DataFrame, key: str, order: str, name: str, staging: str) -> DataFrame:
    """The positions of :func:`position_within`, for an ``order`` that has no null and no value twice in a key; no
    row is moved or sorted for them.

    The values of a span become 1,024 longs with a bit for each value, and the rows ahead of each long. That is some
    12 KB per 65,536 values, written to ``staging``; Spark, which knows its size, chooses the join. A row's
    position is what lies ahead of its span and its long, and the lower bits of that long.
    """
    spark = rows.sparkSession
    bit = F.expr(f"shiftleft(1L, int({order} & 63))")
    words = rows.groupBy(key, F.shiftright(order, WORD_BITS).alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    words.write.mode("overwrite").parquet(f"{staging}/words")
    words = spark.read.schema(words.schema).parquet(f"{staging}/words")
    counted = words.withColumn("_span", F.shiftright("_word", SPAN_BITS - WORD_BITS)).withColumn("_n", F.bit_count("_bits").cast("long"))
    place = F.expr(f"int(_word & {(1 << (SPAN_BITS - WORD_BITS)) - 1})")
    ahead = _total_before("_n", [key, "_span"], "_word").cast("int")
    listed = F.sort_array(F.collect_list(F.struct("_place", "_bits", "_ahead")))
    spans = (
        counted.withColumn("_place", place)
        .withColumn("_ahead", ahead)
        .groupBy(key, "_span")
        .agg(listed.alias("_words"))
        .withColumn("_words", _without_gaps(F.col("_words")))
        .select(key, "_span", F.col("_words")["_bits"].alias("_bits"), F.col("_words")["_ahead"].alias("_aheads"))
    )
    offsets = _span_offsets(counted.groupBy(key, "_span").agg(F.sum("_n").alias("_n")), key).drop("_total")
    spans = spans.join(offsets, [key, "_span"])
    spans.write.mode("overwrite").parquet(f"{staging}/spans")
    spans = spark.read.schema(spans.schema).parquet(f"{staging}/spans")
    at = F.expr(f"int(shiftright({order}, {WORD_BITS}) & {(1 << (SPAN_BITS - WORD_BITS)) - 1})")
    lower = F.bit_count(F.get("_bits", at).bitwiseAND(F.expr(f"~shiftleft(-1L, int({order} & 63))")))
    return (
        rows.withColumn("_span", F.shiftright(order, SPAN_BITS))
        .join(spans, [key, "_span"])
        .select(*rows.columns, (F.col("_offset") + F.get("_aheads", at) + lower).alias(name))
    )


def _without_gaps(words: Column) -> Column:
    """Sorted ``words`` with each at its place. What fills a gap is never read, as no row has that word."""

    def filled(by_place: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.get(words, F.size(words) - 1)["_place"]), lambda k: F.element_at(by_place, k))

    by_place = F.map_from_entries(F.transform(words, lambda w: F.struct(w["_place"], w)))
    no_gap = F.get(words, F.size(words) - 1)["_place"] == F.size(words) - 1
    return F.when(no_gap, words).otherwise(with_value(by_place, filled))


def assign_chunks(messages: DataFrame, n: int = LIVE_CHUNK) -> DataFrame:
    """Close a chunk after every ``n`` accepted messages of a node; the last one may be partial.

    ``seq`` must be unique within a node. ``chunk_id`` is ``<node>/<number>``.
    """
    keyed = messages.withColumn("_node", F.coalesce("node_id", F.lit("-")))
    chunk = F.concat_ws("/", "_node", F.expr(f"string(_position div {n})"))
    return (
        position_within(keyed, "_node", "seq", "_position")
        .withColumn("chunk_id", chunk)
        .select(*messages.columns, "chunk_id")
    )


def assign_numbered_chunks(messages: DataFrame, staging: str, n: int = LIVE_CHUNK) -> DataFrame:
    """The chunks of :func:`assign_chunks` for messages that ``number_lines`` has numbered: no ``seq`` is null or comes
    twice in a node. Only tables of spans are written, to ``staging``; the messages stay where they are."""
    # A node called "-" shares its chunks with lines of no node, whose numbers are its own.
    order = F.when(F.col("_node") == "-", F.col("seq") * 2 + F.col("node_id").isNull().cast("int")).otherwise(F.col("seq"))
    keyed = messages.withColumn("_node", F.coalesce("node_id", F.lit("-"))).withColumn("_order", order)
    chunk = F.concat_ws("/", "_node", F.expr(f"string(_position div {n})"))
    return (
        position_by_bits(keyed, "_node", "_order", "_position", staging)
        .withColumn("chunk_id", chunk)
        .select(*messages.columns, "chunk_id")
    )


def chunk_by_line(messages: DataFrame, n: int = BULK_CHUNK) -> DataFrame:
    """Close a chunk after every ``n`` input lines, for sources that number their lines; no shuffle."""
    return messages.withColumn("chunk_id", F.expr(f"seq div {n}"))
