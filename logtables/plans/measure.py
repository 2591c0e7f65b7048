"""Measure what the archive saves."""

from __future__ import annotations

from pyspark.sql import DataFrame

from logtables.operators.chunks import BULK_CHUNK, chunk_by_line
from logtables.operators.parse import to_messages
from logtables.operators.report import size_report
from logtables.plans.ingest import records_of
from logtables.sources.archive import read_archive, write_archive


def measure_archive(lines: DataFrame, archive: str, n: int = BULK_CHUNK) -> DataFrame:
    """Archive numbered lines in chunks of ``n`` input lines and report sizes."""
    write_archive(records_of(chunk_by_line(to_messages(lines), n)), archive)
    records, _ = read_archive(lines.sparkSession, archive)
    return size_report(lines, records, archive)
