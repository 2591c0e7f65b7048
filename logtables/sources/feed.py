"""The live feed: messages as JSON objects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtables.functions.syslog import iso_time
from logtables.functions.text import once

# The fields of a feed object, in order.
FEED_FIELDS = [
    "priority",
    "facility",
    "severity",
    "timestamp",
    "hostname",
    "app_name",
    "procid",
    "msgid",
    "structured_data",
    "message",
    "is_rfc5424",
    "node_id",
]


def known_time(messages: DataFrame) -> DataFrame:
    """Add ``shown_ts``: the event time, but null for an RFC 5424 line without one."""
    unknown = F.col("is_rfc5424") & (F.col("ts_source") == "received")
    return messages.withColumn("shown_ts", once(F.when(~unknown, F.col("event_ts"))))


def to_json_feed(messages: DataFrame) -> DataFrame:
    """One column ``value``: each message as a JSON object with every field, null ones included."""
    timestamp = F.concat(iso_time(F.col("shown_ts")), F.lit("Z"))
    shown = known_time(messages).withColumn("timestamp", timestamp)
    return shown.select(F.to_json(F.struct(*FEED_FIELDS), {"ignoreNullFields": "false"}).alias("value"))
