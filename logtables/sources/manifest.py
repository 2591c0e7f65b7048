"""Which folders of an archive count.

Batches write folders of their own and need no manifest. Compaction copies small batches into one folder and then
publishes a new version of the manifest: one file, that lists each such folder with its batches and, for each, a
mark of the files that were copied. From then on a batch folder with that mark is passed over. A batch that is
written anew has another mark and counts again, in place of its copy. A version that was cut short is not read, so
a run that ends between any two steps changes nothing that a reader sees.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtables.sources.scratch import file_system

#: The folder of the versions, and that of copies below a table, which readers of the whole table pass over.
MANIFEST, COMPACTED = "manifest", "_compacted"
BATCH = "batch_id="

Folders = dict[str, dict[str, int]]


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder, in order; none if it is not there."""
    path, files = file_system(spark, folder)
    return sorted(s.getPath().getName() for s in files.listStatus(path)) if files.exists(path) else []


def read_manifest(spark: SparkSession, archive: str) -> tuple[int, Folders]:
    """The number of the newest version, and what the newest whole one lists: folders, their batches and marks."""
    names = [n for n in names_in(spark, f"{archive}/{MANIFEST}") if n.endswith(".json")]
    for name in reversed(names):
        try:
            lines = spark.read.text(f"{archive}/{MANIFEST}/{name}", wholetext=True).collect()
            return int(names[-1][:-5]), json.loads("".join(r["value"] for r in lines))
        except json.JSONDecodeError:
            continue
    return int(names[-1][:-5]) if names else 0, {}


def publish(spark: SparkSession, archive: str, version: int, folders: Folders) -> None:
    """Write a version of the manifest; fails if another run has published that number."""
    path, files = file_system(spark, f"{archive}/{MANIFEST}/{version:012}.json")
    out = files.create(path, False)
    try:
        out.write(bytearray(json.dumps(folders).encode()))
    finally:
        out.close()


def batch_marks(spark: SparkSession, table: str) -> dict[str, tuple[int, int]]:
    """Bytes and a mark of the files of each batch below ``table``, from their listing; one row per batch."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(table)
    inside = F.regexp_extract("path", rf"/{BATCH}([^/]+/.*)$", 1)
    listed = files.select(inside.alias("file"), "length").where("file != ''")
    marks = listed.groupBy(F.substring_index("file", "/", 1).alias("batch")).agg(
        F.sum("length").alias("bytes"), F.bit_xor(F.xxhash64("file", "length")).alias("mark")
    )
    return {r["batch"]: (r["bytes"], r["mark"]) for r in marks.collect()}


def live_folders(spark: SparkSession, archive: str, table: str) -> tuple[set[str], dict[str, list[str]]]:
    """The batches whose folder is passed over, and each folder of copies with the batches of it that no longer count.

    ``table`` is the one that marks were taken of. Without a manifest both are empty, after one listing.
    """
    _, folders = read_manifest(spark, archive)
    if not folders:
        return set(), {}
    newest = {batch: (name, mark) for name in sorted(folders) for batch, mark in folders[name].items()}
    base = f"{archive}/{table}"
    present = {n.removeprefix(BATCH) for n in names_in(spark, base)} & newest.keys()
    marks = batch_marks(spark, base) if present else {}
    # A folder without files is that of a batch written anew only if it is complete.
    present = {b for b in present if b in marks or "_SUCCESS" in names_in(spark, f"{base}/{BATCH}{b}")}
    passed = {b for b in present if b in marks and marks[b][1] == newest[b][1]}
    anew = present - passed
    return passed, {name: sorted(b for b in of if newest[b][0] != name or b in anew) for name, of in folders.items()}


def read_copies(spark: SparkSession, table: str, schema: str, folders: dict[str, list[str]]) -> list[DataFrame]:
    """The rows of folders of copies, without batches that no longer count."""
    found = []
    for name, gone in sorted(folders.items()):
        rows = spark.read.schema(schema).parquet(f"{table}/{COMPACTED}/{name}")
        found.append(rows.where(~F.col("batch_id").isin(gone)) if gone else rows)
    return found
