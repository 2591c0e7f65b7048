"""SimHash near-duplicates: fingerprints of word shingles, linked by a generalised pigeonhole.

The 64 bits are dealt into parts of correlated bits. A pair within ``max_distance`` bits is, for any
thresholds t of the parts with sum(t + 1) = max_distance + 1, within t bits in at least one part
(t = -1 skips a part). So every fingerprint may choose its own thresholds: a dynamic programme picks
those with the fewest expected candidates, from counts of part values over all fingerprints. It
probes the values within its thresholds, and each candidate is verified over all 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtables.llm.staging import connected_components, session_of, stage

SEED = 42
BITS = 64
#: Counters per part in the table of expected candidates; their number does not grow with the data.
COUNTERS = 1 << 16
#: What probing one value costs, in candidates.
PROBE_COST = 0.5
#: From this many fingerprints on, two parts of 32 bits instead of three: fewer candidates, more probes.
#: Either way all pairs are found.
TWO_PARTS_FROM = 1 << 23


def fingerprint_of(text: str | None, shingle: int) -> int:
    """The fingerprint as a signed number."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, width = b" ".join(words), min(shingle, len(words))
    stops = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    starts = [0, *[s + 1 for s in stops[:-1]]]
    digest, count = xxhash.xxh64_intdigest, len(words) - width + 1
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops[width - 1 :])), np.uint64, count)
    votes = np.zeros(BITS, np.int64)
    for at in range(0, count, 1 << 15):
        part = hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > count, bitorder="little").view(np.int64)[0])


def fingerprint_column(text: str, shingle: int):
    @F.arrow_udf("long")
    def fingerprint(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint_of(t, shingle) for t in texts.to_pylist()], pa.int64())

    return fingerprint.asNondeterministic()(F.col(text))


def _bits(numbers: np.ndarray) -> np.ndarray:
    return np.unpackbits(numbers.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _common_bits(prints: DataFrame) -> np.ndarray:
    """How many fingerprints have bits i and j set, for all i and j."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            bits = _bits(batch.column(0).to_numpy(zero_copy_only=False)).astype(np.float32)
            total += np.rint(bits.T @ bits).astype(np.int64)
        cell = np.arange(BITS * BITS, dtype=np.int32)
        yield pa.record_batch([pa.array(cell), pa.array(total.ravel())], names=["cell", "n"])

    cells = prints.select("fp").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    table = cells.toArrow()  # 4096 rows
    common = np.zeros(BITS * BITS, np.int64)
    common[table["cell"].to_numpy()] = table["n"].to_numpy()
    return common.reshape(BITS, BITS)


def group_bits(common: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of about equal size, correlated bits together."""
    share = np.diag(common) / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    related = np.abs((common / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread))
    np.fill_diagonal(related, 0)
    free, groups = set(range(BITS)), []
    for k in range(parts):
        size = BITS * (k + 1) // parts - BITS * k // parts
        pool = sorted(free)
        group = [max(pool, key=lambda b: (related[b, pool].sum(), -b))]
        while len(group) < size:
            rest = [b for b in pool if b not in group]
            group.append(max(rest, key=lambda b: (related[b, group].sum(), -b)))
        groups.append(sorted(group))
        free -= set(group)
    return groups


def _value(bits: np.ndarray, group: list[int]) -> np.ndarray:
    return bits[:, group].astype(np.int64) @ (np.int64(1) << np.arange(len(group), dtype=np.int64))


def _counter(values: np.ndarray) -> np.ndarray:
    return ((values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)


def _flips(width: int, radius: int) -> np.ndarray:
    """Masks of exactly ``radius`` of ``width`` bits."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(width), radius)], np.int64)


def allocate(values: list[np.ndarray], widths: list[int], counts: np.ndarray, n: int, units: int) -> np.ndarray:
    """For each row the units (threshold + 1) of each part: their sum is ``units`` and the expected
    candidates and probes are fewest, by dynamic programming over the parts."""
    rows, parts = len(values[0]), len(values)
    cost = np.zeros((parts, units + 1, rows))
    for k, (value, width) in enumerate(zip(values, widths)):
        for t in range(1, units + 1):
            if t == 1:
                found = counts[k][_counter(value)].astype(float)
            elif t == 2:
                found = sum(counts[k][_counter(value ^ f)].astype(float) for f in _flips(width, 1))
            else:  # too many values to look up: their mean
                found = np.full(rows, math.comb(width, t - 1) * n / 2.0**width)
            cost[k, t] = cost[k, t - 1] + found + PROBE_COST * math.comb(width, t - 1)
    best, choice = cost[0], np.zeros((parts, units + 1, rows), np.int64)
    choice[0] = np.arange(units + 1)[:, None]
    for k in range(1, parts):
        options = np.full((units + 1, units + 1, rows), np.inf)
        for total in range(units + 1):
            for t in range(total + 1):
                options[total, t] = best[total - t] + cost[k, t]
        choice[k] = options.argmin(axis=1)
        best = options.min(axis=1)
    chosen, left, at = np.zeros((parts, rows), np.int64), np.full(rows, units), np.arange(rows)
    for k in range(parts - 1, -1, -1):
        chosen[k] = choice[k, left, at]
        left = left - chosen[k]
    return chosen


def near_pairs(prints: DataFrame, max_distance: int) -> DataFrame:
    """Pairs ``u`` < ``v`` of the distinct fingerprints ``fp`` that differ in 1 to ``max_distance`` bits.

    A pair may come more than once. An empty input has no pairs.
    """
    n = prints.count()
    groups = group_bits(_common_bits(prints), n, 2 if n >= TWO_PARTS_FROM else 3)
    widths = [len(g) for g in groups]
    rows_schema = "part int, value long, fp long"

    def rows(parts: list[np.ndarray], values: list[np.ndarray], prints: list[np.ndarray]) -> pa.RecordBatch:
        columns = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (parts, values, prints)]
        return pa.record_batch([pa.array(columns[0].astype(np.int32)), pa.array(columns[1]), pa.array(columns[2])], names=["part", "value", "fp"])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            bits = _bits(fp)
            yield rows([np.full(len(fp), k) for k in range(len(groups))], [_value(bits, g) for g in groups], [fp] * len(groups))

    indexed = prints.select("fp").mapInArrow(index, rows_schema)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(groups), COUNTERS), np.int64)
        for batch in batches:
            bits = _bits(batch.column(0).to_numpy(zero_copy_only=False))
            for k, g in enumerate(groups):
                total[k] += np.bincount(_counter(_value(bits, g)), minlength=COUNTERS)
        cell = np.flatnonzero(total)
        yield pa.record_batch([pa.array(cell), pa.array(total.ravel()[cell])], names=["cell", "n"])

    table = prints.select("fp").mapInArrow(tally, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(groups) * COUNTERS, np.int64)
    counts[table["cell"].to_numpy()] = table["n"].to_numpy()
    shared = prints.sparkSession.sparkContext.broadcast(counts.reshape(len(groups), COUNTERS))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            if not len(fp):
                continue
            bits = _bits(fp)
            values = [_value(bits, g) for g in groups]
            chosen = allocate(values, widths, shared.value, n, max_distance + 1)
            parts, probes, owners = [], [], []
            for k, value in enumerate(values):
                for radius in range(max_distance + 1):
                    at = np.flatnonzero(chosen[k] > radius)
                    masks = _flips(widths[k], radius)
                    probes.append((value[at][:, None] ^ masks[None, :]).ravel())
                    owners.append(np.repeat(fp[at], len(masks)))
                    parts.append(np.full(len(at) * len(masks), k))
            yield rows(parts, probes, owners)

    probed = prints.select("fp").mapInArrow(probe, rows_schema).withColumnRenamed("fp", "asker")
    near = (F.col("fp") < F.col("asker")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("asker"))) <= max_distance)
    found = probed.join(indexed, ["part", "value"]).where(near)
    return found.select(F.col("fp").alias("u"), F.col("asker").alias("v"))


def link_fingerprints(prints: DataFrame, max_distance: int) -> DataFrame:
    """``fp``, ``component_id`` for (``fp``, ``first_id``) rows, one per distinct fingerprint:
    the smallest ``first_id`` among the fingerprints that are connected with it."""
    roots = connected_components(near_pairs(prints, max_distance))
    placed = prints.join(roots, prints["fp"] == roots["node"], "left")
    placed = stage(placed.select("fp", "first_id", F.coalesce("root", "fp").alias("root")), "components")
    # Most components are one fingerprint: only the others need to meet.
    joined = placed.where("root != fp").groupBy("root").agg(F.min("first_id").alias("other"))
    least = placed.where("root = fp").join(joined, "root", "left").select("root", F.least("first_id", "other").alias("component_id"))
    return placed.select("fp", "root").join(least, "root").select("fp", "root", "component_id")


def simhash_near_dedup(docs: DataFrame, shingle: int = 3, max_distance: int = 2, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with ``fingerprint`` (16 hex digits), ``component_id`` and ``kept``.

    Texts are lower-cased in A-Z and cut at ASCII blanks; shingles count with repeats. A text of fewer
    words is one shingle; an empty or null text has fingerprint zero, linked like any other.
    ``component_id`` is the smallest id reachable by links of at most ``max_distance`` bits (ids that
    are null do not count; null if there is no other). ``kept`` is true for one row of each component:
    the one with that id, any one of those if rows are repeated. Columns of ``docs`` by the new names
    are replaced, ``_fp`` and ``_row`` are left out. An empty table gives an empty one.
    """
    session_of(docs)
    own = [c for c in docs.columns if c not in ("fingerprint", "component_id", "kept", "_fp", "_row")]
    printed = docs.select(*own, fingerprint_column(text, shingle).alias("_fp"), F.monotonically_increasing_id().alias("_row"))
    printed = stage(printed, "fingerprints")
    prints = stage(printed.groupBy("_fp").agg(F.min(doc_id).alias("first_id")).withColumnRenamed("_fp", "fp"), "prints")
    linked = link_fingerprints(prints, max_distance)
    placed = stage(
        printed.select("_row", "_fp", F.col(doc_id).alias("_id")).join(linked, F.col("_fp") == F.col("fp"))
        .select("_row", "_id", "root", "component_id"), "placed"
    )
    # Rows with the id of their component, which are several only if rows are repeated.
    first = placed.where(F.col("_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("_row").alias("_row"))
    marked = placed.join(first.select("_row", F.lit(True).alias("_first")), "_row", "left")
    marked = marked.select("_row", "component_id", F.coalesce("_first", F.lit(False)).alias("kept"))
    digits = F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint")
    return printed.join(marked, "_row").select(*own, digits, "component_id", "kept")


def one_of_each(docs: DataFrame, shingle: int = 3, max_distance: int = 2, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that :func:`simhash_near_dedup` keeps, with their own columns."""
    whole = docs.select(F.struct(*docs.columns).alias("_doc"))
    found = simhash_near_dedup(whole, shingle, max_distance, f"_doc.{text}", f"_doc.{doc_id}")
    return found.where("kept").select("_doc.*")
