"""Sources of lines: landed text files, in batch and as a stream.

Collectors land their text below ``node_id=<node>/`` folders. Lines end at LF only, so a bare CR
stays inside its line, and invalid UTF-8 is replaced, not rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Order of a node's files: by time, or by name where names are numbered or dated.
BY_TIME = ["received_at", "source"]
BY_NAME = ["source"]

# The kind of a framed line that holds nothing.
SKIPPED = "skipped"

# Fixed value: what the folder of a missing node is called.
NO_NODE = "__HIVE_DEFAULT_PARTITION__"


def _unescaped(text: Column) -> Column:
    """``%3A`` and the like undone; a plus sign is one, and what is no escape stays."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def _line_columns() -> list[Column]:
    # The folder escapes some characters, and its URI escapes the result.
    escaped = F.nullif(F.regexp_extract("_metadata.file_path", r"/node_id=([^/]+)/", 1), F.lit(NO_NODE))
    node = _unescaped(_unescaped(escaped))
    return [
        F.col("_metadata.file_modification_time").alias("received_at"),
        F.nullif(node, F.lit("")).alias("node_id"),
        F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_block_start").alias("block"),
        F.make_valid_utf8("value").alias("line"),
    ]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all text files below ``path``.

    ``source, block, position`` give the order within a file; ``number_lines`` turns them into ``seq``.
    """
    raw = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path)
    return with_position(raw.select(*_line_columns()))


def stream_lines(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The same lines as a stream of newly landed files."""
    reader = spark.readStream.option("lineSep", "\n").option("recursiveFileLookup", "true")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.text(path).select(*_line_columns())


def with_position(lines: DataFrame) -> DataFrame:
    """Add ``position``, which grows with the line within each block of a file."""
    return lines.withColumn("position", F.monotonically_increasing_id())


def number_lines(lines: DataFrame, staging: str, file_order: list[str] = BY_TIME) -> DataFrame:
    """Give the lines of each node consecutive numbers ``seq`` in arrival order: by file, then line.

    Block positions are only comparable within one evaluation of the source, so the lines are
    written once to the table ``staging`` and numbered from there. The offsets, one row per block of a
    file (128 MB by default), are written beside it, and Spark, which knows their size, chooses the
    join. Blocks are summed within ranges of them and then over the ranges of a node, so a node with
    many files is spread over many tasks. All columns but the place in the file are kept.
    """
    spark = lines.sparkSession
    kept = [name for name in lines.columns if name not in ("source", "block", "position")]
    lines.write.mode("overwrite").parquet(f"{staging}/lines")
    staged = spark.read.schema(lines.schema).parquet(f"{staging}/lines")
    blocks = staged.groupBy("node_id", "received_at", "source", "block").agg(
        F.count("*").alias("n"), F.min("position").alias("first")
    )
    dealt = blocks.repartitionByRange("node_id", *file_order, "block").withColumn("range", F.spark_partition_id())
    dealt.write.mode("overwrite").parquet(f"{staging}/blocks")
    blocks = spark.read.schema(dealt.schema).parquet(f"{staging}/blocks")

    def before(amount: str, window: W) -> Column:
        return F.coalesce(F.sum(amount).over(window.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))

    node = F.struct("node_id").alias("node")  # a missing node is one as well
    ranges = blocks.groupBy(node, "range").agg(F.sum("n").alias("m"))
    ranges = ranges.select("node", "range", before("m", W.partitionBy("node").orderBy("range")).alias("ahead"))
    within = before("n", W.partitionBy("node", "range").orderBy(*file_order, "block"))
    placed = blocks.withColumn("node", node).withColumn("within", within).join(ranges, ["node", "range"])
    offsets = placed.select("source", "block", (F.col("ahead") + F.col("within") - F.col("first")).alias("offset"))
    offsets.write.mode("overwrite").parquet(f"{staging}/offsets")
    offsets = spark.read.schema(offsets.schema).parquet(f"{staging}/offsets")
    return staged.join(offsets, ["source", "block"]).select((F.col("offset") + F.col("position")).alias("seq"), *kept)


def classify_lines(lines: DataFrame) -> DataFrame:
    """Add the framing ``kind`` of each TCP line and strip an octet count from ``line``.

    ``octet``: a count that matches the rest of the line, with or without its LF.
    ``octet_partial``: any other line that starts with a digit. ``delimited``: starts with ``<``.
    ``skipped``: nothing but CR. ``junk``: the rest.
    """
    body = F.ltrim("line", F.lit("\r"))
    rest = F.regexp_extract("body", r"(?s)^[0-9]+ (.*)$", 1)
    count = F.regexp_extract("body", r"^([0-9]+) ", 1).try_cast("bigint")
    fits = F.coalesce((count == F.octet_length(rest)) | (count == F.octet_length(rest) + 1), F.lit(False))
    kind = (
        F.when(F.col("body") == "", SKIPPED)
        .when(F.col("body").startswith("<"), "delimited")
        .when(~F.col("body").rlike("^[0-9]"), "junk")
        .when(fits, "octet")
        .otherwise("octet_partial")
    )
    return (
        lines.withColumn("body", body)
        .withColumn("kind", kind)
        .withColumn("line", F.when(F.col("kind") == "octet", rest).otherwise(F.col("line")))
        .drop("body")
    )


def unframed(lines: DataFrame) -> DataFrame:
    """Lines without their octet counts, empty ones left out."""
    return classify_lines(lines).where(F.col("kind") != SKIPPED).drop("kind")


def count_kinds(lines: DataFrame) -> DataFrame:
    return classify_lines(lines).groupBy("node_id", "kind").agg(F.count("*").alias("n_lines"))
