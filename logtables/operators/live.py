"""What the live view shows: newest lines, a search over them, nodes and when they were last seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtables.functions.syslog import iso_time, severity_name
from logtables.functions.text import contains_ignoring_case
from logtables.operators.encode import MISSING
from logtables.sources.feed import known_time

ARRIVAL = ["received_at", "source", "block", "position"]

# The number of lines kept in view, the cells of a line in order.
TAIL = 1000
CELLS = ["ts", "node", "severity_name", "host", "app", "message"]


def _cell(value: Column) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(MISSING))


def live_rows(messages: DataFrame) -> DataFrame:
    """The displayed cells of each message, ``-`` for missing ones, behind its number and place of arrival."""
    order = [name for name in ("seq", *ARRIVAL) if name in messages.columns]
    return known_time(messages).select(
        *order,
        _cell(F.concat(iso_time(F.col("shown_ts")), F.lit("Z"))).alias("ts"),
        _cell(F.col("node_id")).alias("node"),
        severity_name(F.col("severity")).alias("severity_name"),
        _cell(F.col("hostname")).alias("host"),
        _cell(F.col("app_name")).alias("app"),
        "message",
    )


def newest(messages: DataFrame, n: int = TAIL) -> DataFrame:
    """The ``n`` newest messages: by arrival, then number or place in the file. Each task keeps only its own."""
    order = [name for name in ("received_at", "seq", "source", "block", "position", "node_id") if name in messages.columns]
    return messages.orderBy(*map(F.desc, order)).limit(n)


def live_tail(messages: DataFrame, n: int = TAIL) -> DataFrame:
    """The ``n`` newest lines. They are taken first, so only they get cells."""
    return live_rows(newest(messages, n))


def live_search(messages: DataFrame, text: str) -> DataFrame:
    """Lines whose cells, put together without separators, contain ``text``, ignoring case."""
    return live_rows(messages).where(contains_ignoring_case(F.concat(*CELLS), text))


def node_liveness(messages: DataFrame, exact: bool = True) -> DataFrame:
    """Per node: last arrival and number of lines and, for mined messages, of templates."""
    columns = [F.max("received_at").alias("last_seen"), F.count("*").alias("n_lines")]
    if "template_key" in messages.columns:
        count = F.count_distinct if exact else F.approx_count_distinct
        columns.append(count("template_key").alias("n_templates"))
    return messages.groupBy("node_id").agg(*columns)


#: Logarithm of the registers of a template sketch: with 4,096 of them, estimates are mostly within 2 percent.
SKETCH_BITS = 12


def liveness_state(records: DataFrame) -> DataFrame:
    """What :func:`node_liveness` tells, in a form that can be merged: templates are a sketch of distinct keys."""
    return records.groupBy("node_id").agg(
        F.max("received_at").alias("last_seen"),
        F.count("*").alias("n_lines"),
        F.hll_sketch_agg("template_key", F.lit(SKETCH_BITS)).alias("templates"),
    )


def merge_liveness(*states: DataFrame) -> DataFrame:
    """States of several batches or tables as one. The order of merging may move an estimate within its error."""
    together = states[0]
    for state in states[1:]:
        together = together.unionByName(state)
    return together.groupBy("node_id").agg(
        F.max("last_seen").alias("last_seen"), F.sum("n_lines").alias("n_lines"), F.hll_union_agg("templates").alias("templates")
    )


def liveness_view(state: DataFrame) -> DataFrame:
    """A state as people read it; ``n_templates`` is an estimate."""
    return state.withColumn("n_templates", F.hll_sketch_estimate("templates")).drop("templates")
