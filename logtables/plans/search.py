"""Query an archive: filter by template, search, render."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtables.operators.query import filter_template, reconstruct, render, search
from logtables.sources.archive import read_archive, with_times
from logtables.sources.index import read_records_for


def query_archive(
    spark: SparkSession,
    archive: str,
    template_key: str | None = None,
    text: str | None = None,
    since: date | None = None,
    until: date | None = None,
    indexed: bool = False,
) -> DataFrame:
    """Reconstructed and rendered records; all conditions are optional and must all hold.

    ``indexed`` opens only files that can hold the template and the text, by the index of
    :mod:`logtables.sources.index`; files that it lacks are read as well.

    One stage without a shuffle. The template test is pushed to the scan; of days of arrival (UTC)
    outside ``since`` to ``until``, both included, no file is listed or read.
    """
    records = with_times(read_records_for(spark, archive, template_key, text)) if indexed else read_archive(spark, archive)[0]
    if since is not None:
        records = records.where(F.col("date") >= F.lit(since))
    if until is not None:
        records = records.where(F.col("date") <= F.lit(until))
    if template_key is not None:
        records = filter_template(records, template_key)
    found = reconstruct(records)
    if text is not None:
        found = search(found, text)
    return render(found)
