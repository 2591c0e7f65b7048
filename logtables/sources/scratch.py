"""Where intermediate tables go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTING = "spark.checkpoint.dir"


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder below the shared folder that the session names in ``spark.checkpoint.dir``.

    Without that setting a local session gets a temporary folder; on a cluster executors could not
    read one another's folders, so this fails instead.
    """
    shared = spark.conf.get(SETTING, None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {SETTING} to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="logtables-")
        spark.conf.set(SETTING, shared)
    return f"{shared.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str) -> tuple:
    """A path and the file system that holds it."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders that are no longer needed, in whatever store they are; missing ones are passed over."""
    for path in paths:
        folder, files = file_system(spark, path)
        files.delete(folder, True)
