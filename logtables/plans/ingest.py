"""Ingest: lines -> archive, catalog and rejects, as one batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtables.operators.chunks import LIVE_CHUNK, assign_numbered_chunks
from logtables.operators.mine import extract_variables, mine_templates
from logtables.operators.parse import judge_lines, judged_messages, judged_rejects
from logtables.sources.archive import REJECTS, TEMPLATES, batch_path, read_table, write_archive, write_batch
from logtables.sources.lines import BY_TIME, SKIPPED, classify_lines, number_lines, read_lines
from logtables.sources.scratch import remove

LINE = ["seq", "received_at", "node_id", "line"]


def records_of(chunked: DataFrame) -> DataFrame:
    """Records of messages that have their ``chunk_id``."""
    return extract_variables(mine_templates(chunked))


def batch_of(spark: SparkSession, landing: str) -> str:
    """A name for the files below ``landing``: the same for the same paths, sizes and times. No file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(landing)
    mark = F.xxhash64("path", "length", F.unix_micros("modificationTime"))
    found = files.agg(F.coalesce(F.bit_xor(mark), F.lit(0)).alias("mark"), F.count("*").alias("n")).first()
    return f"b-{found['mark'] & (1 << 64) - 1:016x}-{found['n']}"


def ingest_batch(
    spark: SparkSession,
    landing: str,
    archive: str,
    work: str,
    n: int = LIVE_CHUNK,
    batch_id: int | str | None = None,
    file_order: list[str] = BY_TIME,
    framed: bool = False,
) -> None:
    """Archive all text files below ``landing``, beside what the archive has.

    Without ``batch_id`` the batch is named after its files, so the same load repeated replaces itself
    and any other adds to the archive; land each load in a folder of its own. Numbers ``seq`` count
    within a batch, and chunk ids begin with it. Patterns that other batches have published are not
    published again. ``framed`` strips octet counts, for lines as TCP collectors land them.

    Each line is parsed once: judged lines are written to ``work`` and numbered from there, which messages,
    rejects and chunks are then taken from. What a load has written to ``work`` goes when it is archived.
    """
    batch_id = batch_of(spark, landing) if batch_id is None else batch_id
    staging = batch_path(f"{work}/lines", batch_id)
    lines = number_lines(judged_lines(read_lines(spark, landing), framed), staging, file_order)
    write_batch(rejected_lines(lines), f"{archive}/{REJECTS}", batch_id)
    known = read_table(spark, archive, TEMPLATES).where(F.col("batch_id") != str(batch_id))
    chunked = assign_numbered_chunks(judged_messages(lines), staging, n).withColumn("chunk_id", F.concat_ws("/", F.lit(str(batch_id)), "chunk_id"))
    write_archive(records_of(chunked), archive, batch_id, known)
    remove(spark, staging)


def judged_lines(lines: DataFrame, framed: bool) -> DataFrame:
    """Lines with all that parsing tells. Of framed lines the octet count goes; empty ones stay, with the reason
    ``skipped``, until they are numbered."""
    if not framed:
        return judge_lines(lines)
    judged = judge_lines(classify_lines(lines))
    return judged.withColumn("reason", F.when(F.col("kind") == SKIPPED, SKIPPED).otherwise(F.col("reason"))).drop("kind")


def rejected_lines(judged: DataFrame) -> DataFrame:
    """The rejects table of judged lines."""
    return judged_rejects(judged, *LINE).where(F.col("reason") != SKIPPED)
