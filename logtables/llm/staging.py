"""Tables between the steps of an operator, row ranks and connected components."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logtables.sources.scratch import scratch_dir

#: Arrow batches end at this many rows, so that a batch of long texts fits in a Python worker.
BATCH_ROWS = 500
#: Spark's option to remove the shuffle files of a query at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Bytes in the shuffle of a partition that is held for lookups. Spark's advisory size of a partition, as less has no effect.
HASHED = 64 << 20


@contextmanager
def _option(spark: SparkSession, option: str, value: str) -> Iterator[None]:
    before = spark.conf.get(option)
    spark.conf.set(option, value)
    try:
        yield
    finally:
        spark.conf.set(option, before)


def arrow_rows(spark: SparkSession, rows: int) -> AbstractContextManager[None]:
    """Arrow batches of at most ``rows`` rows, for jobs that run within."""
    return _option(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shuffles_removed(spark: SparkSession) -> AbstractContextManager[None]:
    """The shuffle files of each query that runs within go at its end."""
    return _option(spark, CLEANUP, "true")


def session_of(df: DataFrame) -> SparkSession:
    """The session of ``df``, with Arrow batches small enough for long texts."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def hash_joins(spark: SparkSession) -> AbstractContextManager[None]:
    """Joins that run within look up rows instead of sorting both sides where no partition of a side has more than
    ``HASHED`` bytes; Spark sees that from the shuffle, and sorts otherwise."""
    return _option(spark, "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", str(HASHED))


def stage(df: DataFrame, purpose: str, **options: str) -> DataFrame:
    """``df`` written once, with these options, to the shared folder and read back: later steps see the same rows,
    and a lost executor costs no earlier step."""
    path = scratch_dir(df.sparkSession, purpose)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc32_of_id(doc_id: str = "doc_id") -> Column:
    """CRC-32 of the id as text; a missing id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


def range_sums(df: DataFrame, group: str, order: list[str], value: Column, purpose: str) -> DataFrame:
    """``df`` with ``_before``: the sum of the whole number ``value`` over the rows of the same
    ``group`` that come earlier by ``order``, then by all other columns.

    Rows are dealt by range of group and order, so a large group is spread over many tasks. Within
    a task the sum is a window; what earlier tasks hold of the group comes from one row per group
    and task. Null groups and order values are like any other, first in order.
    """
    from pyspark.sql import Window

    keys = [group, *order, *[c for c in df.columns if c not in (group, *order)]]
    dealt = df.withColumn("_value", value).repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys])
    staged = stage(dealt.withColumn("_task", F.spark_partition_id()), purpose)
    tasks = staged.groupBy(group, "_task").agg(F.sum("_value").alias("_sum"))
    earlier = Window.partitionBy(group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tasks.select(
        F.col(group).alias("_group"), F.col("_task").alias("_of"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset")
    )
    inside = (
        Window.partitionBy("_task", group)
        .orderBy(*[F.col(k).asc_nulls_first() for k in keys[1:]])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = staged.withColumn("_local", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    joined = local.join(offsets, (F.col("_task") == F.col("_of")) & F.col(group).eqNullSafe(F.col("_group")))
    summed = joined.withColumn("_before", F.col("_local") + F.col("_offset"))
    return summed.drop("_task", "_of", "_group", "_offset", "_local", "_value")


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node it is connected with) for each node of ``edges``
    (bigints ``u``, ``v``) with a smaller one in its component; a node that is missing is its own root.

    Large and small stars in turn: every round links the neighbours of a node to the smallest of
    them. Rounds grow as the logarithm of the size; each is one table in the shared folder. Minima
    are combined before each shuffle, so a node with many edges does not land in one task.
    """
    now = stage(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = mark
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(smallest, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stage(moved.union(smallest.select("u", F.col("m").alias("v"))).distinct(), "stars")
