"""Tables of lines and messages derived from the sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_lines(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """Syslog lines of all ``events``: both formats, some junk, some with a bad priority.

    ``dealt``: partitions are ranges of ``seq``; made of events, so that finding the ranges makes no line.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events = events.repartitionByRange("event_id") if dealt else events
    k = "get_json_object(props, '$.k')"
    amount = "cast(cast(value as decimal(12,2)) as string)"
    text = f"""CASE event_type
        WHEN 'error' THEN concat('Request ', event_id, ' failed with code ', {k}, ' after ', {amount}, ' ms')
        WHEN 'purchase' THEN concat('User user', user_id, ' paid ', {amount}, ' for cart ', {k})
        ELSE concat('User user', user_id, ' did ', event_type, ' from IP 192.168.1.', event_id % 255) END"""
    severity = "CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 5 ELSE 6 END"
    stamped = events.selectExpr("*", f"{text} AS msg", f"8 * (user_id % 24) + {severity} AS pri")
    time = "CASE WHEN event_id % 40 = 0 THEN '-' ELSE date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\") END"
    procid = "CASE WHEN event_id % 6 = 0 THEN '-' ELSE string(1000 + event_id % 10) END"
    data = f"CASE WHEN event_id % 4 = 0 THEN '-' ELSE concat('[ev@32473 k=\"', {k}, '\"]') END"
    line = f"""CASE
        WHEN event_id % 50 = 7 THEN concat('junk line ', event_id)
        WHEN event_id % 50 = 8 THEN concat('<300>1 bad priority ', event_id)
        WHEN event_id % 10 = 3
        THEN concat('<', pri, '>', date_format(ts, 'MMM dd HH:mm:ss'), ' host', user_id % 17, ' ', event_type, ': ', msg)
        ELSE concat('<', pri, '>1 ', {time}, ' host', user_id % 17, ' ', event_type, ' ', {procid}, ' ID47 ', {data}, ' ', msg)
        END"""
    return stamped.selectExpr(
        "event_id AS seq",
        "cast(ts AS timestamp) AS received_at",
        "concat('node-', user_id % 3) AS node_id",
        f"{line} AS line",
    )


def document_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` as messages, whole texts."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return documents.select(F.col("doc_id").alias("seq"), F.col("source").alias("node_id"), F.col("text").alias("message"))


def conversation_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns of ``conversations`` as multi-line messages, in order of conversation and turn."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return turns.select(
        (F.shiftleft(F.col("conv_id").cast("bigint"), 32) + F.col("turn")).alias("seq"), F.col("role").alias("node_id"), F.col("text").alias("message")
    )


def land_lines(lines: DataFrame, path: str, dealt: bool = False) -> None:
    """Write lines as text below ``node_id=<node>/``, in order of ``seq`` within and across files. ``dealt`` lines have
    ranges of ``seq`` as partitions."""
    ranges = lines if dealt else lines.repartitionByRange("seq")
    (
        ranges.sortWithinPartitions("node_id", "seq")
        .select("node_id", "line")
        .write.partitionBy("node_id")
        .option("lineSep", "\n")
        .text(path)
    )
