"""Live views of a stream of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logtables.operators.live import TAIL, live_rows, live_search, liveness_state, liveness_view, merge_liveness, newest
from logtables.operators.parse import to_messages
from logtables.operators.report import HEAVY, heavy_state
from logtables.sources.archive import batch_path, write_batch
from logtables.sources.feed import to_json_feed
from logtables.sources.lines import with_position
from logtables.sources.scratch import remove


# Ends when all landed files are read; {"processingTime": "10 seconds"} goes on.
ALL_LANDED = {"availableNow": True}


def _started(rows: DataFrame, kind: str, path: str, checkpoint: str, trigger: dict | None) -> StreamingQuery:
    return (
        rows.writeStream.format(kind)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or ALL_LANDED))
        .start()
    )


def stream_feed(lines: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Write every message as a JSON object to text files."""
    return _started(to_json_feed(to_messages(lines)), "text", path, checkpoint, trigger)


def stream_search(lines: DataFrame, text: str, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Write the lines that contain ``text`` to Parquet. No state."""
    return _started(live_search(to_messages(lines), text), "parquet", path, checkpoint, trigger)


def _state(spark: SparkSession, path: str, batch_id: int, schema) -> DataFrame | None:
    """What a batch left, None before the first."""
    return spark.read.schema(schema).parquet(batch_path(path, batch_id)) if batch_id >= 0 else None


def _replace_state(spark: SparkSession, state: DataFrame, path: str, batch_id: int) -> None:
    """Write the state of a batch. That of the one before stays, as this batch may be run again; older ones go."""
    write_batch(state, path, batch_id)
    if batch_id > 1:
        remove(spark, batch_path(path, batch_id - 2))


def stream_tail(lines: DataFrame, path: str, checkpoint: str, n: int = TAIL, trigger: dict | None = None) -> StreamingQuery:
    """Keep the ``n`` newest messages below ``path``: batch by batch, the newest of those kept and those arrived.

    Once ``n`` are kept, lines that arrived before the oldest of them are left out ahead of parsing. ``path``
    holds the states of the last two batches; :func:`tail_of` shows the newest.
    """
    numbered = "seq" in lines.columns

    def keep(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        arrived = batch if numbered else with_position(batch)
        schema = to_messages(arrived).schema
        before = _state(spark, path, batch_id - 1, schema)
        if before is not None:
            oldest, kept = before.agg(F.min("received_at"), F.count("*")).first()
            if kept >= n:
                arrived = arrived.where(F.col("received_at") >= F.lit(oldest))
        rows = newest(to_messages(arrived), n)
        if before is not None:
            rows = newest(rows.unionByName(before), n)
        _replace_state(spark, rows, path, batch_id)

    return _each_batch(lines, keep, checkpoint, trigger)


def tail_of(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """The displayed rows that :func:`stream_tail` kept as of a batch."""
    return live_rows(spark.read.parquet(batch_path(path, batch_id)))


def stream_liveness(records: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Last arrival, lines and distinct templates of each node, from a stream of mined records.

    The state is a row per node, merged batch by batch; distinct templates are a sketch of fixed size, as an
    exact set would grow without end. ``path`` holds the states of the last two batches; :func:`liveness_of`
    shows the newest.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        state = liveness_state(batch)
        before = _state(batch.sparkSession, path, batch_id - 1, state.schema)
        _replace_state(batch.sparkSession, state if before is None else merge_liveness(before, state), path, batch_id)

    return _each_batch(records, merge, checkpoint, trigger)


def liveness_of(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """The liveness of all nodes that :func:`stream_liveness` kept as of a batch."""
    return liveness_view(spark.read.parquet(batch_path(path, batch_id)))


def stream_heavy(records: DataFrame, path: str, checkpoint: str, most: int = HEAVY, trigger: dict | None = None) -> StreamingQuery:
    """Summarise which templates have most message bytes, from a stream of mined records.

    The state has at most ``most`` templates, merged batch by batch, however many the stream brings. ``path``
    holds the states of the last two batches; :func:`logtables.operators.report.heavy_templates` gives the exact
    report from the newest (:func:`heavy_of`).
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        before = _state(batch.sparkSession, path, batch_id - 1, "template_key string, weight long")
        _replace_state(batch.sparkSession, heavy_state(batch, before, most), path, batch_id)

    return _each_batch(records, merge, checkpoint, trigger)


def heavy_of(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """The summary that :func:`stream_heavy` kept as of a batch."""
    return spark.read.parquet(batch_path(path, batch_id))


def _each_batch(rows: DataFrame, handle, checkpoint: str, trigger: dict | None) -> StreamingQuery:
    writer = rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or ALL_LANDED)).start()
