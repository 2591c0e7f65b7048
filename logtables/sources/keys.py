"""Keys of all published patterns, for collectors that ask in every batch which patterns are new.

Log-structured: each batch adds a folder with the keys that it published, and every ``EVERY`` batches all keys
so far are written anew as one snapshot. A batch reads the last snapshot and the few folders since, whose names
follow from its number, so neither listings nor reads grow with the number of batches.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from logtables.sources.archive import TEMPLATES, batch_path, write_batch
from logtables.sources.scratch import remove

#: Batches from one snapshot to the next.
EVERY = 16
ADDED, SNAPSHOTS = "added", "snapshots"
KEYS = "template_key string"


def rest_of(batch: int) -> str:
    """The name of the flush that follows a batch."""
    return f"{batch}-rest"


def _read(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(KEYS).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], KEYS)


def _added(path: str, first: int, last: int) -> str:
    """One pattern for the folders of some batches and their flushes, which may not be there."""
    names = ",".join(f"{name}" for k in range(first, last + 1) for name in (k, rest_of(k)))
    return f"{path}/{ADDED}/batch_id={{{names}}}"


def known_keys(spark: SparkSession, path: str, last: int, every: int = EVERY) -> DataFrame:
    """All keys that the batches from 0 up to ``last`` and their flushes have published."""
    if last < 0:
        return spark.createDataFrame([], KEYS)
    start = last // every * every
    keys = _read(spark, _added(path, start, last))
    return keys.unionByName(_read(spark, batch_path(f"{path}/{SNAPSHOTS}", start - 1))) if start else keys


def add_keys(spark: SparkSession, path: str, archive: str, batch_id: int | str) -> None:
    """Note the keys that a batch has just published in the catalog of ``archive``."""
    published = spark.read.schema(KEYS).parquet(batch_path(f"{archive}/{TEMPLATES}", batch_id))
    write_batch(published.hint("rebalance"), f"{path}/{ADDED}", batch_id)


def compact(spark: SparkSession, path: str, batch: int, every: int = EVERY) -> None:
    """Before batch number ``batch``, where one is due, write the snapshot of all keys before it.

    A batch that is run again writes it again from the same folders, as these go only with the snapshot after
    the next: at that time no batch that needs them can be run again.
    """
    if batch == 0 or batch % every:
        return
    before = batch - every
    keys = _read(spark, _added(path, before, batch - 1))
    if before:
        keys = keys.unionByName(_read(spark, batch_path(f"{path}/{SNAPSHOTS}", before - 1)))
    # Ranges of keys, so that files and row groups without a wanted key are passed over.
    ordered = keys.distinct().repartitionByRange("template_key").sortWithinPartitions("template_key")
    write_batch(ordered, f"{path}/{SNAPSHOTS}", batch - 1)
    if before:
        old = [batch_path(f"{path}/{ADDED}", name) for k in range(before - every, before) for name in (k, rest_of(k))]
        remove(spark, *old, *([batch_path(f"{path}/{SNAPSHOTS}", before - every - 1)] if before > every else []))
