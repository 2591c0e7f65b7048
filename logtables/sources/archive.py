"""The archive: an append-only pair of Parquet tables, ``records`` and ``templates``.

Every run writes its own ``batch_id`` folder and replaces only that, so other runs stay, and a run
that is repeated under its own name adds nothing. Records carry their pattern: sorted by template it costs next to nothing in
Parquet, and queries over the whole archive need no join.
"""

from __future__ import annotations

import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtables.functions.syslog import utc_date
from logtables.operators.catalog import new_templates, template_catalog
from logtables.sources.manifest import BATCH, COMPACTED, live_folders, names_in, read_copies, read_manifest

# Compression of the archive, columns of a record.
CODEC = {
    "compression": "zstd",
    "parquet.compression.codec.zstd.level": "3",
    "parquet.writer.version": "PARQUET_2_0",
}
STORED = [
    "chunk_id",
    "seq",
    "event_ms",
    "ts_source",
    "priority",
    "hostname",
    "app_name",
    "procid",
    "msgid",
    "structured_data",
    "node_id",
    "is_rfc5424",
    "template_key",
    "pattern",
    "variables",
]

RECORDS, TEMPLATES, REJECTS = "records", "templates", "rejects"

# The tables as they are read. Nothing is inferred: "01" stays apart from "1", and no footer is opened.
SCHEMAS = {
    RECORDS: "chunk_id string, seq long, event_ms long, ts_source string, priority int, hostname string, app_name string, "
    "procid string, msgid string, structured_data string, node_id string, is_rfc5424 boolean, template_key string, "
    "pattern string, variables array<string>, batch_id string, date date",
    TEMPLATES: "template_key string, pattern string, token_count int, n_wildcards int, first_seq long, n_lines long, batch_id string",
    REJECTS: "seq long, received_at timestamp, node_id string, line string, protocol string, reason string, batch_id string",
}

# Fixed value: names that are the same as a folder, in a path and in a column.
PLAIN_NAME = r"[A-Za-z0-9][A-Za-z0-9._-]*"


def new_batch() -> str:
    """A name that no other batch has."""
    return f"b-{uuid.uuid4().hex}"


def batch_path(path: str, batch_id: int | str) -> str:
    """The folder of one batch. Names that a folder would change or hide are refused."""
    if not re.fullmatch(PLAIN_NAME, str(batch_id)):
        raise ValueError(f"not a plain name for a batch: {batch_id!r}")
    return f"{path.rstrip('/')}/batch_id={batch_id}"


def write_batch(table: DataFrame, path: str, batch_id: int | str, partition_by: list[str] | None = None) -> None:
    """Replace the folder of one batch."""
    writer = table.write.mode("overwrite").options(**CODEC)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(batch_path(path, batch_id))


def write_records(records: DataFrame, path: str, batch_id: int | str) -> None:
    """Write records by day of arrival, sorted by template; event times in milliseconds, chunk ids as text.

    ``rebalance`` gathers a day, so that a batch writes few files, and lets Spark split a day that
    holds most rows.
    """
    named = records.withColumn("chunk_id", F.col("chunk_id").cast("string"))
    stored = named.withColumn("event_ms", F.unix_millis("event_ts")).select(
        utc_date(F.col("received_at")).alias("date"), *STORED
    )
    sorted_records = stored.hint("rebalance", "date").sortWithinPartitions("date", "template_key", "seq")
    write_batch(sorted_records, f"{path}/{RECORDS}", batch_id, ["date"])


def write_archive(
    records: DataFrame, path: str, batch_id: int | str | None = None, known: DataFrame | None = None
) -> None:
    """Write the records of a batch, then add the patterns whose key ``known`` lacks to the catalog.

    Without ``batch_id`` the records are added under a new name; give one if the run may be repeated.
    The catalog is taken from the written records, so whatever made them runs once.
    """
    batch_id = new_batch() if batch_id is None else batch_id
    write_records(records, path, batch_id)
    written = records.sparkSession.read.schema("seq long, pattern string").parquet(
        f"{path}/{RECORDS}/batch_id={batch_id}"
    )
    templates = template_catalog(written) if known is None else new_templates(written, known)
    write_batch(templates.hint("rebalance"), f"{path}/{TEMPLATES}", batch_id)


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table of the archive, empty if nothing has been written to it; ``batch_id`` is text.

    Of batches that were compacted (:mod:`logtables.plans.compact`) the copies are read.
    """
    passed, folders = (set(), {}) if table == REJECTS else live_folders(spark, path, RECORDS)
    if folders:
        base = f"{path}/{table}"
        own = [n for n in names_in(spark, base) if n.startswith(BATCH) and n.removeprefix(BATCH) not in passed]
        rows = read_copies(spark, base, SCHEMAS[table], folders)
        if own:
            rows.append(spark.read.schema(SCHEMAS[table]).option("basePath", base).parquet(*[f"{base}/{n}" for n in own]))
        together = rows[0]
        for more in rows[1:]:
            together = together.unionByName(more)
        return together
    try:
        return spark.read.schema(SCHEMAS[table]).parquet(f"{path}/{table}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMAS[table])


def with_times(records: DataFrame) -> DataFrame:
    """Stored records with their event time."""
    return records.withColumn("event_ts", F.timestamp_millis("event_ms")).drop("event_ms")


def read_archive(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``records`` and ``templates`` of all batches."""
    return with_times(read_table(spark, path, RECORDS)), read_table(spark, path, TEMPLATES)


def archived_bytes(spark: SparkSession, path: str) -> DataFrame:
    """Total size of the archive's data files, from their listing; no file is opened. Copies and what they replace
    both count, until it is removed."""
    copies = [f"{path}/{table}/{COMPACTED}/{name}" for table in (RECORDS, TEMPLATES) for name in read_manifest(spark, path)[1]]
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
        .load([*(f"{path}/{table}" for table in (RECORDS, TEMPLATES)), *copies])
    )
    return files.agg(F.sum("length").alias("archived_bytes"), F.count("*").alias("n_files"))
