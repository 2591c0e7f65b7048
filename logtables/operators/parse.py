"""Lines table -> messages table, rejects table and quality table.

Native column expressions only. A line is judged by one regular expression; the reason of a reject
is worked out only for lines that failed it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtables.functions import syslog
from logtables.functions.text import once, trimmed

TO_END = 2147483647


def _read_fields(lines: DataFrame) -> DataFrame:
    """Add ``text`` (the trimmed line), ``is_rfc5424`` and ``field`` (the cut line)."""
    text = F.col("text")
    fields = F.when(F.col("is_rfc5424"), syslog.fields_5424(text)).otherwise(syslog.fields_3164(text))
    return (
        lines.withColumn("text", trimmed(F.col("line")))
        .withColumn("is_rfc5424", syslog.is_structured(text))
        .withColumn("field", once(fields))
    )


def _accepted() -> Column:
    field = F.col("field")
    return (
        field[0].startswith(syslog.MATCHED)
        & syslog.fits_octet(F.substring(field[0], 2, TO_END))
        & (~F.col("is_rfc5424") | syslog.fits_octet(field[1]))
    )


def _reason() -> Column:
    """Why a line was rejected."""
    text = F.col("text")
    priority = F.regexp_extract(text, syslog.PRIORITY, 1)
    version = F.regexp_extract(text, syslog.RFC5424_HEADER, 2)
    return (
        F.when(text == "", "empty")
        .when(~text.rlike(syslog.PRIORITY), "bad_pri")
        .when(~syslog.fits_octet(priority), "pri_range")
        .when(~F.col("is_rfc5424") | ~text.rlike(syslog.RFC5424_HEADER), "bad_header")
        .when(~syslog.fits_octet(version), "version_range")
        .otherwise("bad_sd")
    )


def _protocol() -> Column:
    return F.when(F.col("is_rfc5424"), "rfc5424").when(F.col("text") != "", "rfc3164")


def _parsed() -> list[Column]:
    """The columns of an accepted line."""
    structured = F.col("is_rfc5424")

    def field(position: int) -> Column:
        return F.get("field", F.lit(position))  # a rejected line may have fewer

    rest = field(7)
    has_data = structured & rest.startswith("[")

    def header(position: int) -> Column:
        return F.when(structured, syslog.nil_to_null(field(position)))

    message = (
        F.when(has_data, F.substring(rest, F.instr(rest, "]") + 1, F.lit(TO_END)))
        .when(structured, F.substring(rest, 2, TO_END))
        .otherwise(field(2))
    )
    return [
        F.substring(field(0), 2, TO_END).try_cast("int").alias("priority"),
        F.when(structured, field(2)).alias("time_text"),
        F.when(structured, syslog.nil_to_null(field(3))).otherwise(field(1)).alias("hostname"),
        header(4).alias("app_name"),
        header(5).alias("procid"),
        header(6).alias("msgid"),
        F.when(has_data, F.substring(F.substring_index(rest, "]", 1), 2, TO_END)).alias("structured_data"),
        message.alias("message"),
        "is_rfc5424",
    ]


def parse_lines(lines: DataFrame) -> DataFrame:
    """Messages of the accepted lines. Columns of ``lines`` other than ``line`` are kept."""
    kept = [name for name in lines.columns if name != "line"]
    return _read_fields(lines).where(_accepted()).select(*kept, *_parsed())


def judge_lines(lines: DataFrame) -> DataFrame:
    """All lines with the columns of a parsed one, ``protocol`` and ``reason``, which is null for accepted lines.

    For jobs that need both messages and rejects: written once, no line is parsed a second time. What the
    columns of a rejected line hold is of no meaning.
    """
    reason = F.when(~_accepted(), _reason()).alias("reason")
    return _read_fields(lines).select(*lines.columns, *_parsed(), _protocol().alias("protocol"), reason)


def judged_messages(judged: DataFrame) -> DataFrame:
    """The messages among judged lines, as :func:`to_messages` gives them."""
    accepted = judged.where(F.col("reason").isNull()).drop("line", "protocol", "reason")
    return event_time(decode_priority(accepted))


def judged_rejects(judged: DataFrame, *columns: str) -> DataFrame:
    """The rejects among judged lines, with ``columns`` of the lines."""
    return judged.where(F.col("reason").isNotNull()).select(*columns, "protocol", "reason")


def decode_priority(messages: DataFrame) -> DataFrame:
    """Add facility (upper bits) and severity (lower three bits) of the priority."""
    priority = F.col("priority")
    return messages.withColumn("facility", F.shiftright(priority, 3)).withColumn(
        "severity", priority.bitwiseAND(7)
    )


def severity_label(messages: DataFrame) -> DataFrame:
    return messages.withColumn("severity_name", syslog.severity_name(F.col("severity")))


def event_time(messages: DataFrame) -> DataFrame:
    """Replace ``time_text`` by ``event_ts`` and ``ts_source``.

    A missing or unreadable header time, and every RFC 3164 time, becomes the arrival time.
    """
    return (
        messages.withColumn("header_ts", syslog.rfc3339_time(F.col("time_text")))
        .withColumn("event_ts", F.coalesce("header_ts", F.col("received_at").cast("timestamp")))
        .withColumn("ts_source", F.when(F.col("header_ts").isNull(), "received").otherwise("header"))
        .drop("header_ts", "time_text")
    )


def to_messages(lines: DataFrame) -> DataFrame:
    """Parse, decode the priority and settle the event time."""
    return event_time(decode_priority(parse_lines(lines)))


def quarantine(lines: DataFrame) -> DataFrame:
    """Rejected lines, unchanged, with protocol and reason."""
    return (
        _read_fields(lines)
        .where(~_accepted())
        .select(*lines.columns, _protocol().alias("protocol"), _reason().alias("reason"))
    )


def parse_quality(lines: DataFrame) -> DataFrame:
    """Lines and bytes per node, protocol and outcome (``ok`` or the reject reason)."""
    return (
        _read_fields(lines)
        .select(
            "node_id",
            _protocol().alias("protocol"),
            F.when(_accepted(), "ok").otherwise(_reason()).alias("outcome"),
            F.octet_length("line").alias("bytes"),
        )
        .groupBy("node_id", "protocol", "outcome")
        .agg(F.count("*").alias("n_lines"), F.sum("bytes").alias("n_bytes"))
    )


def tag_node(messages: DataFrame, node_id: str) -> DataFrame:
    """Stamp every message with the collector's node id."""
    return messages.withColumn("node_id", F.lit(node_id))


def tag_nodes(messages: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """Stamp each message with the node that ``sources`` names for its ``key``.

    ``sources`` has one row per key. No hint: Spark broadcasts it when its size allows, and splits
    hot keys of a sort-merge join otherwise.
    """
    stamped = sources.select(key, F.col("node_id").alias("_node"))
    joined = messages.join(stamped, key, "left")
    return joined.withColumn("node_id", F.coalesce("_node", "node_id")).drop("_node")
