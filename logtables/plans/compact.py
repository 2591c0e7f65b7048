"""Compaction of an archive: many small batches become one folder, while loads and readers go on."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from logtables.sources.archive import CODEC, RECORDS, SCHEMAS, TEMPLATES
from logtables.sources.manifest import BATCH, COMPACTED, batch_marks, live_folders, names_in, publish, read_manifest
from logtables.sources.scratch import file_system, remove

#: Batches with fewer bytes of records are small.
SMALL = 128 << 20


def compact_archive(spark: SparkSession, archive: str, below: int = SMALL) -> list[str]:
    """Copy the records and patterns of all batches with less than ``below`` bytes of records into one folder, and
    let that count in their place. The names of these batches; none, and nothing is done, if there are fewer than two.

    Copies are laid out as a batch is: by day, sorted by template. Old folders stay until :func:`vacuum_archive`,
    so readers that have listed them go on. If a batch is written anew meanwhile, nothing is published.
    """
    base = f"{archive}/{RECORDS}"
    passed, _ = live_folders(spark, archive, RECORDS)
    marks = batch_marks(spark, base)
    small = sorted(b for b, (size, _) in marks.items() if size < below and b not in passed)
    if len(small) < 2:
        return []
    version, folders = read_manifest(spark, archive)
    name = f"{version + 1:012}-{uuid.uuid4().hex[:8]}"
    for table, order, days in ((RECORDS, ["date", "template_key", "batch_id", "seq"], ["date"]), (TEMPLATES, ["template_key"], [])):
        there = {n.removeprefix(BATCH) for n in names_in(spark, f"{archive}/{table}")}
        paths = [f"{archive}/{table}/{BATCH}{b}" for b in small if b in there]
        rows = spark.read.schema(SCHEMAS[table]).option("basePath", f"{archive}/{table}").parquet(*paths)
        rows = rows.hint("rebalance", *days).sortWithinPartitions(*order)
        rows.write.options(**CODEC).partitionBy(*days).parquet(f"{archive}/{table}/{COMPACTED}/{name}")
    now = batch_marks(spark, base)
    if any(now.get(b) != marks[b] for b in small):
        remove(spark, *[f"{archive}/{table}/{COMPACTED}/{name}" for table in (RECORDS, TEMPLATES)])
        return []
    publish(spark, archive, version + 1, {**folders, name: {b: marks[b][1] for b in small}})
    return small


def vacuum_archive(spark: SparkSession, archive: str) -> None:
    """Remove the folders of batches whose copies count, and copies that no version of the manifest lists.

    Run it when no compaction is at work and readers that listed the old folders are done. A folder is first
    renamed, in one step, to a name that readers pass over: a run cut short leaves no half of a batch.
    """
    passed, folders = live_folders(spark, archive, RECORDS)
    for table in (TEMPLATES, RECORDS):
        base = f"{archive}/{table}"
        there = names_in(spark, base)
        for batch in sorted(passed):
            if f"{BATCH}{batch}" in there:
                path, files = file_system(spark, f"{base}/{BATCH}{batch}")
                old, _ = file_system(spark, f"{base}/_old-{uuid.uuid4().hex}")
                files.rename(path, old)
        unlisted = [f"{COMPACTED}/{n}" for n in names_in(spark, f"{base}/{COMPACTED}") if n not in folders]
        remove(spark, *[f"{base}/{n}" for n in (*unlisted, *(n for n in names_in(spark, base) if n.startswith("_old-")))])
