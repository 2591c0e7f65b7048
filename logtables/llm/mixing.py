"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtables.llm.staging import range_sums, stage

MAX_COPIES = 3
#: Weights of the sources by code point, null last, repeating.
WEIGHTS = (1, 2, 3)
SEED = 17
#: Expected copies are whole numbers of this part, so that their sums do not depend on the order.
UNIT = 1 << 24


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """``source_size``, ``target`` per ``source`` for rows (``source``, ``size``).

    Sources by code point, null last, have ``weights`` in turn and share the sum of all sizes by them.
    A target stops at ``max_copies`` times the size of its source, and what is above is shared again by
    weight among the others until none is above: in each round all that are above the common level are
    fixed, and the level is computed from the rest. Only single sums reach the driver.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = by_source.repartitionByRange(F.col("source").asc_nulls_last())
    ordered = stage(ordered.withColumn("_task", F.spark_partition_id()), "sources")
    tasks = ordered.groupBy("_task").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(F.lit(1)).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)  # a row per task
    offsets = tasks.select("_task", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"))
    place = F.row_number().over(Window.partitionBy("_task").orderBy(F.col("source").asc_nulls_last())) - 1 + F.col("_first")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    weighed = ordered.join(offsets, "_task").select("source", "source_size", weight.alias("weight"))
    weighed = stage(weighed.withColumn("cap", F.col("source_size") * max_copies), "weights")

    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level, capped = None, None
    while True:
        if level is None:
            fixed, rest = 0, weighed.agg(F.sum("weight")).first()[0] or 0
        else:
            above = F.col("weight") * F.lit(level) > F.col("cap")
            sums = weighed.agg(F.sum(F.when(above, F.col("cap"))), F.sum(F.when(~above, F.col("weight"))), F.count_if(above)).first()
            fixed, rest, now = sums[0] or 0, sums[1] or 0, sums[2]
            if now == capped:
                break
            capped = now
        if not rest:
            break
        level, capped = (total - fixed) / rest, capped or 0
    target = F.when(F.lit(level is None), F.lit(0.0)).otherwise(F.least(F.col("weight") * F.lit(level or 0.0), F.col("cap").cast("double")))
    return weighed.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: Sequence[int] = WEIGHTS, max_copies: int = MAX_COPIES, seed: int = SEED, size: Column | None = None) -> DataFrame:
    """``docs`` with ``size`` (words of the whole text, if not given as a whole number), ``source_size``,
    ``target``, ``copies`` and ``taken``.

    Every document of a source expects target / source_size copies, at most ``max_copies``. In order of
    size, then id, then a hash of the whole row, expected copies are summed within the source from one random
    offset, and a document is taken once for each whole number that its share crosses. Neighbours in
    that order are of similar size, so the words taken come near the target. Sums are of whole numbers
    and the offset is a hash of seed and source: reruns agree.

    A null text has size 0; a null source is a source of its own, last in order; rows without id come
    first. Documents of a source without words have no copies. Repeated rows count each. Columns of
    ``docs`` by the new names are replaced, others may have any name. An empty table gives an empty one.
    """
    words = word_count(text) if size is None else F.coalesce(size, F.lit(0)).cast("long")
    rows = docs.select(
        F.col(source).alias("_source"), words.alias("_size"), F.col(doc_id).alias("_id"),
        F.monotonically_increasing_id().alias("_place"), F.struct(*docs.columns).alias("_doc"),
    )
    # Whole rows are written once and move once, to meet their copies; ranks are made of slim rows.
    rows = stage(rows.withColumn("_hash", F.xxhash64("_doc")), "rows")
    sized = rows.select("_source", "_size", "_id", "_hash", "_place")
    targets = stage(source_targets(sized.select(F.col("_source").alias("source"), F.col("_size").alias("size")), weights, max_copies), "targets")
    expected = F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size") * UNIT)).otherwise(0).cast("long")
    # Ranks first, targets after: a row's sum is its rank times what each row of the source expects.
    ranked = range_sums(sized, "_source", ["_size", "_id", "_hash"], F.lit(1), "ranked")
    joined = ranked.join(targets, F.col("_source").eqNullSafe(F.col("source"))).withColumn("_expected", expected)
    # Six hex digits: below one unit.
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("_source").cast("string"), F.lit("")))), 1, 6)
    before = F.col("_before") * F.col("_expected") + F.conv(digits, 16, 10).cast("long")
    copies = F.floor((before + F.col("_expected")) / F.lit(UNIT)) - F.floor(before / F.lit(UNIT))
    own = [F.col("_doc")[c].alias(c) for c in docs.columns if c not in ("size", "source_size", "target", "copies", "taken")]
    counted = joined.select("_place", "source_size", "target", copies.cast("int").alias("copies"))
    copies, joined = F.col("copies"), rows.join(counted, "_place")
    return joined.select(*own, F.col("_size").alias("size"), "source_size", "target", copies, (copies * F.col("_size")).alias("taken"))


def emit(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """The rows of ``docs`` as often as :func:`mix` takes them, with their own columns."""
    whole = docs.select(F.struct(*docs.columns).alias("_row"))
    mixed = mix(whole, f"_row.{text}", f"_row.{doc_id}", f"_row.{source}").where("copies > 0")
    return mixed.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")
