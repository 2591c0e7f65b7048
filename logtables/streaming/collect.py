"""Continuous collection: a stream of lines into the archive.

Every micro-batch writes only folders that carry its number, and reads only those of earlier ones.
A batch that is run again, after a failure at any point, therefore replaces its own output.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logtables.operators.chunks import LIVE_CHUNK, position_within
from logtables.operators.parse import judged_messages
from logtables.plans.ingest import judged_lines, records_of, rejected_lines
from logtables.sources.archive import REJECTS, batch_path, write_archive, write_batch
from logtables.sources.keys import EVERY, add_keys, compact, known_keys, rest_of
from logtables.sources.lines import BY_TIME, number_lines, with_position
from logtables.sources.scratch import remove
from logtables.streaming.live import ALL_LANDED

LINES, MESSAGES, PROGRESS, FLUSHED, KEYS = "lines", "messages", "progress", "flushed", "keys"


def _batch(spark: SparkSession, path: str, batch_id: int | str, schema) -> DataFrame | None:
    """The table of one batch, or None if that batch never wrote it."""
    try:
        return spark.read.schema(schema).parquet(f"{path}/batch_id={batch_id}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _flushed(spark: SparkSession, work: str, batch_id: int) -> bool:
    return _batch(spark, f"{work}/{FLUSHED}", batch_id, "node string") is not None


def _numbered(batch: DataFrame, batch_id: int, work: str, file_order: list[str], framed: bool) -> DataFrame:
    """Judged lines of a batch, numbered per node on from the batches before. This is where lines are parsed.

    The table of next numbers has one row per node.
    """
    spark = batch.sparkSession
    lines = number_lines(judged_lines(with_position(batch), framed), batch_path(f"{work}/{LINES}", batch_id), file_order)
    node = F.coalesce("node_id", F.lit("-")).alias("node")
    seen = lines.groupBy(node).agg(F.count("*").alias("next_seq"))
    before = _batch(spark, f"{work}/{PROGRESS}", batch_id - 1, seen.schema)
    if before is not None:
        seen = seen.unionByName(before).groupBy("node").agg(F.sum("next_seq").alias("next_seq"))
        first = before.withColumnRenamed("next_seq", "first_seq")
        lines = lines.withColumn("node", node).join(first, "node", "left")
        lines = lines.withColumn("seq", F.col("seq") + F.coalesce("first_seq", F.lit(0))).drop("node", "first_seq")
    write_batch(seen, f"{work}/{PROGRESS}", batch_id)
    return lines


def _with_waiting(messages: DataFrame, batch_id: int, work: str, n: int) -> DataFrame:
    """Add the messages that earlier batches left waiting, and tell which ones fill whole chunks."""
    spark = messages.sparkSession
    columns = messages.columns
    staged = messages.withColumn("chunk_id", F.lit("")).withColumn("whole", F.lit(False))
    before = _batch(spark, f"{work}/{MESSAGES}", batch_id - 1, staged.schema)
    if before is not None and not _flushed(spark, work, batch_id - 1):
        messages = messages.unionByName(before.where(~F.col("whole")).select(*columns))
    keyed = messages.withColumn("node", F.coalesce("node_id", F.lit("-")))
    chunk = F.concat_ws("/", "node", F.lit(str(batch_id)), F.expr(f"string(position div {n})"))
    return (
        position_within(keyed, "node", "seq", "position", total="total")
        .withColumn("chunk_id", chunk)
        .withColumn("whole", F.col("position") < F.expr(f"(total div {n}) * {n}"))
        .select(*columns, "chunk_id", "whole")
    )


def collect_batch(
    batch: DataFrame,
    batch_id: int,
    archive: str,
    work: str,
    n: int = LIVE_CHUNK,
    file_order: list[str] = BY_TIME,
    framed: bool = False,
    every: int = EVERY,
) -> None:
    """Parse a batch of lines, archive every ``n`` accepted messages of a node, keep the rest waiting.

    Less than ``n`` messages per node wait. New patterns are those that no earlier batch published, by the
    key table (:mod:`logtables.sources.keys`). A batch reads what the one before left in ``work``; what is
    older goes.
    """
    spark = batch.sparkSession
    if _flushed(spark, work, batch_id - 1):
        # Once more, as it may have been cut short; it only replaces its own output.
        flush_waiting(spark, archive, work, batch_id - 1, every)
    compact(spark, f"{work}/{KEYS}", batch_id, every)
    lines = _numbered(batch, batch_id, work, file_order, framed)
    write_batch(rejected_lines(lines), f"{archive}/{REJECTS}", batch_id)
    staged = _with_waiting(judged_messages(lines), batch_id, work, n)
    write_batch(staged, f"{work}/{MESSAGES}", batch_id, ["whole"])
    ready = _batch(spark, f"{work}/{MESSAGES}", batch_id, staged.schema)
    known = known_keys(spark, f"{work}/{KEYS}", batch_id - 1, every)
    write_archive(records_of(ready.where("whole").drop("whole")), archive, batch_id, known)
    add_keys(spark, f"{work}/{KEYS}", archive, batch_id)
    remove(spark, batch_path(f"{work}/{LINES}", batch_id))
    if batch_id > 1:
        remove(spark, *[batch_path(f"{work}/{table}", batch_id - 2) for table in (MESSAGES, PROGRESS, FLUSHED)])


def flush_waiting(spark: SparkSession, archive: str, work: str, batch_id: int, every: int = EVERY) -> None:
    """On shutdown, close a partial chunk with the messages that batch ``batch_id``, the last, left waiting."""
    try:
        staged = spark.read.parquet(f"{work}/{MESSAGES}/batch_id={batch_id}")
    except AnalysisException as error:  # no message was accepted, so none waits
        if error.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        return
    waiting = staged.where(~F.col("whole")).drop("whole")
    # From here on these messages belong to the flush and no later batch takes them.
    nodes = waiting.select(F.col("node_id").alias("node")).distinct()
    write_batch(nodes, f"{work}/{FLUSHED}", batch_id)
    published = _batch(spark, f"{work}/{KEYS}/added", batch_id, "template_key string")
    before = known_keys(spark, f"{work}/{KEYS}", batch_id - 1, every)
    write_archive(records_of(waiting), archive, rest_of(batch_id), before.unionByName(published))
    add_keys(spark, f"{work}/{KEYS}", archive, rest_of(batch_id))


def stream_archive(
    lines: DataFrame,
    archive: str,
    work: str,
    n: int = LIVE_CHUNK,
    file_order: list[str] = BY_TIME,
    framed: bool = False,
    trigger: dict | None = None,
    every: int = EVERY,
) -> StreamingQuery:
    """Archive a stream of lines; without ``trigger`` it ends when all landed files are read. Run it
    again to go on. ``framed`` strips octet counts, for lines as TCP collectors land them; ``every`` says after
    how many batches the keys of all patterns are written as one table.

    ``archive`` and ``work`` belong to this stream: batch numbers come from its checkpoint.
    """

    def collect(batch: DataFrame, batch_id: int) -> None:
        collect_batch(batch, batch_id, archive, work, n, file_order, framed, every)

    return (
        lines.writeStream.foreachBatch(collect)
        .option("checkpointLocation", f"{work}/checkpoint")
        .trigger(**(trigger or ALL_LANDED))
        .start()
    )
