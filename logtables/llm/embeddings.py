"""Near-duplicate vectors: an exact join by cosine over subspaces.

Unit vectors with a cosine of at least c are within squared distance 2 - 2c. They are rotated and cut
into blocks of few dimensions, each with its share of that distance. By the pigeonhole, a pair within
the whole distance is within the share of at least one block, so it is enough to join by range within
each block and to verify what is found over all dimensions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtables.llm.staging import connected_components, session_of, stage

MIN_COSINE = 0.95
BLOCK_DIMS = 8
SEED = 11
#: Each block is cut into cells of about so many vectors. The cuts are medians of a bounded sample of
#: vectors; they decide which rows meet where, never which pairs are found.
CELL_ROWS = 4096
SAMPLE = 20_000
#: At most so many rows of each side meet in one group; a larger cell becomes several groups.
GROUP_ROWS = 2048
#: Rounding that candidates and shares of a distance may differ by.
SLACK = 1e-6


def _rotation(dims: int) -> np.ndarray:
    turned, _ = np.linalg.qr(np.random.default_rng(SEED).normal(size=(dims, dims)))
    return turned


def _units(raw: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    return (raw / np.linalg.norm(raw, axis=1, keepdims=True)) @ rotation


class Cells:
    """Boxes of a block: halves of halves, each cut at the sample's median of its widest dimension."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.low, self.high = [], []
        dims = sample.shape[1]
        todo = [(sample, np.full(dims, -np.inf), np.full(dims, np.inf), cells)]
        while todo:
            rows, low, high, n = todo.pop()
            axis = int(np.argmax(rows.max(0) - rows.min(0))) if len(rows) > 1 else 0
            if n <= 1 or len(rows) < 4 or rows[:, axis].max() == rows[:, axis].min():
                self.low.append(low)
                self.high.append(high)
                continue
            at = np.median(rows[:, axis])
            below = rows[:, axis] < at
            if not below.any():
                below = rows[:, axis] <= at
                at = np.nextafter(at, np.inf)
            for side, part in ((True, rows[below]), (False, rows[~below])):
                new_low, new_high = low.copy(), high.copy()
                (new_high if side else new_low)[axis] = at
                todo.append((part, new_low, new_high, (n + side) // 2))
        self.low, self.high = np.array(self.low), np.array(self.high)

    def own(self, rows: np.ndarray) -> np.ndarray:
        inside = ((rows[:, None, :] >= self.low) & (rows[:, None, :] < self.high)).all(axis=2)
        return inside.argmax(axis=1)

    def near(self, rows: np.ndarray, own: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """Row and cell for every cell after a row's own that is within ``reach``."""
        gap = np.maximum(0, np.maximum(self.low - rows[:, None, :], rows[:, None, :] - self.high))
        close = ((gap**2).sum(axis=2) <= reach) & (np.arange(len(self.low)) > own[:, None])
        return np.nonzero(close)


def _union(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index connected with each of ``n``."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _links(left: np.ndarray, right: np.ndarray, same: bool, block: int, cuts: list[slice], shares: list[float], min_cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of ``left`` and ``right`` with the cosine asked for, whose first block within its share is ``block``."""
    here, first, second = cuts[block], [], []
    squares = (right[:, here] ** 2).sum(axis=1)
    for at in range(0, len(left), 256):
        rows = left[at : at + 256]
        apart = (rows[:, here] ** 2).sum(axis=1)[:, None] + squares - 2 * rows[:, here] @ right[:, here].T
        near = apart <= shares[block] + SLACK
        if same:
            near &= np.arange(len(right)) > (np.arange(len(rows)) + at)[:, None]
        if not near.any():
            continue
        i, j = np.nonzero(near)
        for k in range(0, len(i), 1 << 15):
            x, y = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
            a, b = rows[x], right[y]
            linked = np.einsum("ij,ij->i", a, b) >= min_cosine
            x, y, gap = x[linked], y[linked], (a[linked] - b[linked]) ** 2
            within = np.stack([gap[:, c].sum(axis=1) <= s for c, s in zip(cuts, shares)])
            counted = within[block] & ~within[:block].any(axis=0)
            first.append(x[counted] + at)
            second.append(y[counted])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *first]), np.concatenate([none, *second])


def link_vectors(vectors: DataFrame, dims: int, n: int, min_cosine: float) -> tuple[DataFrame, DataFrame]:
    """For distinct vectors (``rep``, ``vec``: doubles, ``weight``): links (``rep``, ``n``: sum of the weights of
    other vectors it is linked with) and ``edges`` (``u``, ``v``) that connect all that are linked.

    Every pair is counted in one block and one group only, so counts add up and no pair leaves its group.
    """
    spark = vectors.sparkSession
    distance = 2 - 2 * min_cosine
    cuts = [slice(at, min(at + BLOCK_DIMS, dims)) for at in range(0, dims, BLOCK_DIMS)]
    shares = [distance * (c.stop - c.start) / dims + 1e-9 for c in cuts]
    rotation = _rotation(dims)
    every = max(1, -(-n // SAMPLE))
    sample = vectors.where(F.pmod(F.xxhash64("rep"), F.lit(every)) == 0).select("vec").limit(2 * SAMPLE).toArrow()
    drawn = np.array(sample["vec"].to_pylist(), dtype=np.float64).reshape(-1, dims)
    shared = spark.sparkContext.broadcast([Cells(_units(drawn, rotation)[:, c], max(1, n // CELL_ROWS)) for c in cuts])

    schema = "block int, cell int, home boolean, rep long, weight long, unit binary"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            units = _units(np.array(batch.column(1).to_pylist(), dtype=np.float64), rotation)
            packed = pa.array([u.tobytes() for u in units], pa.binary())
            for block, (cells, cut) in enumerate(zip(shared.value, cuts)):
                own = cells.own(units[:, cut])
                rows, others = cells.near(units[:, cut], own, shares[block] + SLACK)
                at = pa.array(np.concatenate([np.arange(len(units)), rows]))
                cell = np.concatenate([own, others]).astype(np.int32)
                home = pa.array(np.arange(len(cell)) < len(units))
                yield pa.record_batch(
                    [pa.array(np.full(len(cell), block, np.int32)), pa.array(cell), home, batch.column(0).take(at), batch.column(2).take(at), packed.take(at)],
                    names=["block", "cell", "home", "rep", "weight", "unit"],
                )

    placed = stage(vectors.select("rep", "vec", "weight").mapInArrow(place, schema), "cells")
    # Cells with many rows are cut into parts; each part of the homes meets each part of the homes and of the visitors.
    sizes = placed.groupBy("block", "cell").agg(F.count_if("home").alias("homes"), F.count_if(~F.col("home")).alias("visitors"))
    parts = sizes.select(
        "block", "cell", F.greatest(F.lit(1), F.ceil(F.col("homes") / GROUP_ROWS)).cast("int").alias("p"),
        F.ceil(F.col("visitors") / GROUP_ROWS).cast("int").alias("q"),
    ).where("p > 0")
    dealt = placed.join(parts, ["block", "cell"])
    mine = F.when(F.col("home"), F.pmod(F.xxhash64("rep"), F.col("p"))).otherwise(F.pmod(F.xxhash64("rep"), F.greatest(F.lit(1), F.col("q")))).cast("int")
    dealt = dealt.withColumn("part", mine)
    # A group is (a, b): homes of part a with homes of part b >= a, or, from p on, with visitors of part b - p.
    as_left = F.when(F.col("home"), F.transform(F.sequence(F.col("part"), F.col("p") + F.col("q") - 1), lambda b: F.struct(F.col("part").alias("a"), b.alias("b"), F.lit(True).alias("left"))))
    as_right = F.when(
        F.col("home"),
        F.when(F.col("part") > 0, F.transform(F.sequence(F.lit(0), F.col("part") - 1), lambda a: F.struct(a.alias("a"), F.col("part").alias("b"), F.lit(False).alias("left")))),
    ).otherwise(F.transform(F.sequence(F.lit(0), F.col("p") - 1), lambda a: F.struct(a.alias("a"), (F.col("part") + F.col("p")).alias("b"), F.lit(False).alias("left"))))
    groups = dealt.select("block", "cell", "rep", "weight", "unit", F.explode(F.flatten(F.array_compact(F.array(as_left, as_right)))).alias("g"))
    groups = groups.select("block", "cell", "g.a", "g.b", "g.left", "rep", "weight", "unit")

    def compare(table: pa.Table) -> pa.Table:
        block, same = table["block"][0].as_py(), table["a"][0].as_py() == table["b"][0].as_py()
        rep = table["rep"].to_numpy()
        weight = table["weight"].to_numpy()
        units = np.frombuffer(b"".join(table["unit"].to_pylist()), np.float64).reshape(-1, dims)
        left = np.flatnonzero(table["left"].to_numpy())
        right = left if same else np.flatnonzero(~table["left"].to_numpy())
        i, j = _links(units[left], units[right], same, block, cuts, shares, min_cosine)
        i, j = left[i], right[j]
        n = np.bincount(i, weight[j], len(rep)) + np.bincount(j, weight[i], len(rep))
        root = _union(len(rep), i, j)
        some = np.flatnonzero(n)
        return pa.table({"rep": rep[some], "n": n[some].astype(np.int64), "root": rep[root[some]]})

    found = stage(groups.groupBy("block", "cell", "a", "b").applyInArrow(compare, "rep long, n long, root long"), "links")
    links = found.groupBy("rep").agg(F.sum("n").alias("n"))
    return links, found.where("rep != root").select(F.col("rep").alias("u"), F.col("root").alias("v"))


def embedding_near_dedup(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", min_cosine: float = MIN_COSINE) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` for each row of ``vectors``.

    ``n_links`` counts the other rows with a cosine of at least ``min_cosine`` (0 < ``min_cosine`` < 1);
    ``component_id`` is the smallest id reachable by such links, itself included, and ``kept`` tells
    whether that is the own id (repeated ids of one component are all kept; a null id is larger than
    any other, and never kept if there is another). Null or zero vectors and those with null or
    non-finite components link with nothing. Vectors of different lengths do not link. Equal vectors
    are compared once. Other columns are ignored. An empty table gives an empty one.
    """
    session_of(vectors)
    vec = F.col(embedding).cast("array<double>")
    rows = vectors.select(F.col(vec_id).alias("vec_id"), vec.alias("vec"), F.monotonically_increasing_id().alias("_row"))
    sound = F.coalesce(
        F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0), F.lit(False)
    )
    rows = stage(rows.withColumn("sound", sound).withColumn("dims", F.size("vec")), "vectors")
    # Adding 0.0 makes minus zero plus zero: equal numbers are equal bytes.
    equal = rows.where("sound").groupBy(F.transform("vec", lambda x: x + F.lit(0.0)).alias("vec"))
    distinct = stage(equal.agg(F.min("_row").alias("rep"), F.min("vec_id").alias("first"), F.count("*").alias("weight")), "distinct")
    links, edges = None, None
    for dims, n in distinct.groupBy(F.size("vec").alias("dims")).count().orderBy("dims").collect():  # one row per length of vector
        some = link_vectors(distinct.where(F.size("vec") == dims), dims, n, min_cosine)
        links, edges = (some if links is None else (links.union(some[0]), edges.union(some[1])))
    if links is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    roots = connected_components(edges)
    classes = distinct.select("vec", "rep", "first", "weight").join(links, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left")
    classes = stage(classes.select("vec", "first", F.coalesce("root", "rep").alias("root"), (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")), "classes")
    least = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    known = classes.join(least, "root").select("vec", "n_links", "component_id")
    linked = rows.where("sound").select("vec_id", F.transform("vec", lambda x: x + F.lit(0.0)).alias("vec")).join(known, "vec")
    linked = linked.select("vec_id", "n_links", "component_id")
    other = rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(other).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
