"""Merkle manifest of a table: a hash for each row, a tree for each language, proofs for all rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtables.llm.staging import range_sums, stage

#: Nodes that become one node of the level above.
FAN = 8
#: Leaves that are proved together: a whole subtree of so many levels, 4,096 leaves.
BLOCK_LEVELS = 4
#: What a leaf is made of, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

#: A tree: that of a language, or the one over all languages.
TREE = "struct<top:boolean,of:string>"
NODE = f"_tree {TREE}, _level int, _place long, _hash string, _count long"
PROVED = "doc_id {id}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _tree(top: bool, of: Column) -> Column:
    return F.struct(F.lit(top).alias("top"), of.cast("string").alias("of"))


def leaf_hash(fields: list[Column]) -> Column:
    """SHA-256 in hex of the fields: ``-`` for null, else the number of UTF-8 bytes, a colon and the value."""

    def framed(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(framed, fields)), 256)


def digest(parts: str) -> str:
    return hashlib.sha256(parts.encode()).hexdigest()


def level_above(hashes: list[str]) -> list[str]:
    return [digest("".join(hashes[k : k + FAN])) for k in range(0, len(hashes), FAN)]


def siblings(place: int, nodes: list[str]) -> tuple[str, str]:
    """The other nodes of the run of ``place``: those before it and those after it."""
    first = place - place % FAN
    return "".join(nodes[first:place]), "".join(nodes[place + 1 : first + FAN])


def fold(node: str, path: list[tuple[str, str]]) -> str:
    for before, after in path:
        node = digest(before + node + after)
    return node


def _levels(nodes: DataFrame, purpose: str) -> DataFrame:
    """``nodes`` (see ``NODE``: places of a tree from 0, ``_count`` its nodes on that level) and all levels above
    them, up to one node a tree.

    A level is one aggregation of groups of eight, so no tree is ever gathered, and an eighth of the level below.
    """
    found = level = stage(nodes, purpose)
    while (level.agg(F.max("_count")).first()[0] or 0) > 1:
        members = F.sort_array(F.collect_list(F.struct("_place", "_hash")))
        runs = level.where("_count > 1").groupBy("_tree", (F.col("_level") + 1).alias("_level"), F.expr(f"_place div {FAN}").alias("_place"))
        above = runs.agg(
            F.sha2(F.array_join(members["_hash"], ""), 256).alias("_hash"),
            F.expr(f"(first(_count) + {FAN - 1}) div {FAN}").alias("_count"),  # the same for all nodes of a level
        )
        level = stage(above, purpose)
        found = found.unionByName(level)
    return found


def _placed(docs: DataFrame, now: Column, doc_id: str, lang: str, text: str, fields: tuple[str, ...], block: int) -> DataFrame:
    """A row per leaf: its tree, id, hash, hash with the text as it is ``now``, place, block and the leaves of its tree."""
    own = [F.col(f) for f in fields]
    changed = leaf_hash([now if f == text else F.col(f) for f in fields])
    leaves = docs.select(
        _tree(False, F.col(lang)).alias("_tree"), F.col(doc_id).alias("_id"), leaf_hash(own).alias("_leaf"),
        F.when(~now.eqNullSafe(F.col(text)), changed).alias("_changed"),
    )
    placed = range_sums(leaves, "_tree", ["_id", "_leaf"], F.lit(1), "leaves").withColumnRenamed("_before", "_place")
    return stage(placed.withColumn("_block", F.expr(f"_place div {block}")), "placed")


def _blocks(placed: DataFrame) -> DataFrame:
    """A row per block of leaves: ``leaves`` in order and ``_leaves``, the number of leaves of the tree."""
    counts = placed.groupBy("_tree").agg(F.count("*").alias("_leaves"))
    leaves = F.sort_array(F.collect_list(F.struct("_place", "_leaf", "_id", "_changed"))).alias("leaves")
    return placed.groupBy("_tree", "_block").agg(leaves).join(counts, "_tree")


def _inside(leaves: list[str], count: int, most: int) -> tuple[list[list[str]], int]:
    """The levels (at most ``most`` above the leaves) of a block of a tree of ``count`` leaves, and the nodes of the tree on the last of them."""
    levels = [leaves]
    while len(levels) <= most and count > 1:
        levels.append(level_above(levels[-1]))
        count = -(-count // FAN)
    return levels, count


def _block_roots(blocks: DataFrame, most: int) -> DataFrame:
    """The root of each block; a tree of at most one block ends with its own root."""

    def rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for hashes, count in zip(batch.column("hashes").to_pylist(), batch.column("_leaves").to_pylist()):
                levels, left = _inside(hashes, count, most)
                found.append((len(levels) - 1, levels[-1][0], left))
            at, hashes, counts = zip(*found) if found else ((), (), ())
            columns = [batch.column("_tree"), pa.array(at, pa.int32()), batch.column("_block"), pa.array(hashes, pa.string()), pa.array(counts, pa.int64())]
            yield pa.record_batch(columns, names=["_tree", "_level", "_place", "_hash", "_count"])

    return blocks.select("_tree", "_block", "_leaves", F.col("leaves")["_leaf"].alias("hashes")).mapInArrow(rooted, NODE)


def _path(level: str, place: str, count: str) -> Column:
    """From a node up to the root of its tree, a struct per level: the node's place there and the last place."""
    scale = f"cast(power({FAN}, k) as bigint) as s, cast(power({FAN}, greatest(k - 1, 0)) as bigint) as below"
    # While the level below has more than one node.
    there = f"filter(transform(sequence(0, 17), k -> struct(k, {scale})), x -> x.k = 0 or ({count} + x.below - 1) div x.below > 1)"
    return F.expr(f"transform({there}, x -> struct({level} + x.k as level, {place} div x.s as own, ({count} + x.s - 1) div x.s - 1 as last))")


def _missing(roots: DataFrame, ranks: DataFrame) -> DataFrame:
    """The coordinates of all nodes that a block needs and cannot derive from its own leaves: the others of each
    run on its way up, and the roots of both trees. All leaves of a block share them, so each is listed once."""
    asked = roots.select("_tree", F.col("_place").alias("_block"), _path("_level", "_place", "_count").alias("own"))
    asked = asked.join(ranks, "_tree").select(
        "_tree", "_block",
        F.explode(F.array(
            F.struct(F.col("_tree").alias("tree"), F.col("own").alias("path")),
            F.struct(_tree(True, F.lit(None)).alias("tree"), _path("0", "_rank", "_ranks").alias("path")),
        )).alias("way"),
    )
    asked = asked.select("_tree", "_block", F.col("way.tree").alias("_of"), F.explode("way.path").alias("at"))
    first = F.col("at.own") - F.col("at.own") % FAN
    run = F.sequence(first, F.least(first + (FAN - 1), F.col("at.last")))
    asked = asked.select("_tree", "_block", "_of", "at", F.explode(run).alias("_at"))
    side = F.when(F.col("at.last") == 0, 0).otherwise(F.signum(F.col("_at") - F.col("at.own"))).cast("int")
    return asked.where("_at != at.own or at.last = 0").select("_tree", "_block", "_of", F.col("at.level").cast("int").alias("_on"), "_at", side.alias("side"))


def manifest(
    docs: DataFrame, now: Column | None = None, doc_id: str = "doc_id", lang: str = "lang", text: str = "text", fields: tuple[str, ...] = FIELDS,
    block_levels: int = BLOCK_LEVELS,
) -> DataFrame:
    """One row per row of ``docs``: its id, ``leaf``, the ``subroot`` of its language, the ``root`` of all,
    ``proof_sha256`` (of its siblings on the way to the root, concatenated), ``folded_root`` (what that way makes of the
    row with the text as it is ``now``) and ``verified``: both roots agree.

    Leaves of a language ascend by id, null first, rows of equal id by their hash; equal rows are leaves each.
    Languages ascend by their bytes, null first. A null field differs from an empty one. An empty table
    gives an empty one; other columns change nothing.

    Every block of leaves (4,096, a subtree of ``block_levels``) lists the nodes it lacks, fetches them in one join, derives the nodes between
    from its own leaves and expands the proofs of its leaves. Leaves move without their texts; places come from
    sums over ranges, so a language that holds most rows is spread over many tasks.
    """
    now = F.col(text) if now is None else now
    kind = docs.schema[doc_id].dataType.simpleString()
    blocks = _blocks(_placed(docs, now, doc_id, lang, text, fields, FAN**block_levels))
    roots = stage(_block_roots(blocks, block_levels), "block-roots")
    nodes = _levels(roots, "tree")
    subroots = nodes.where("_count = 1").select("_tree", "_hash", F.lit(0).alias("_one"))
    ranks = range_sums(subroots, "_one", ["_tree"], F.lit(1), "languages").withColumnRenamed("_before", "_rank")
    ranks = stage(ranks.join(ranks.groupBy("_one").agg(F.count("*").alias("_ranks")), "_one"), "ranks")
    top = ranks.select(_tree(True, F.lit(None)).alias("_tree"), F.lit(0).alias("_level"), F.col("_rank").alias("_place"), "_hash", F.col("_ranks").alias("_count"))
    nodes = nodes.unionByName(_levels(top, "top"))

    known = nodes.select(F.col("_tree").alias("_of"), F.col("_level").alias("_on"), F.col("_place").alias("_at"), "_hash")
    fetched = _missing(roots, ranks.drop("_one", "_hash")).join(known, ["_of", "_on", "_at"])
    order = F.struct(F.col("_of.top").alias("top"), F.col("_on").alias("level"), F.col("_at").alias("at"), "side", F.col("_hash").alias("hash"))
    fetched = fetched.groupBy("_tree", "_block").agg(F.sort_array(F.collect_list(order)).alias("fetched"))

    def proved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                leaves = batch.column("leaves")[k].values
                rows = _expanded(
                    leaves.field("_leaf").to_pylist(), leaves.field("_changed").to_pylist(), batch.column("_leaves")[k].as_py(), batch.column("fetched")[k].as_py(),
                    block_levels,
                )
                columns = [leaves.field("_id"), *[pa.array(c, pa.bool_() if n == 6 else pa.string()) for n, c in enumerate(zip(*rows), 1)]]
                yield pa.record_batch(columns, names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    schema = PROVED.format(id=kind)
    found = blocks.join(fetched, ["_tree", "_block"]).select("leaves", "_leaves", "fetched").mapInArrow(proved, schema)
    return found.withColumnRenamed("doc_id", doc_id)


def _expanded(leaves: list[str], changed: list[str | None], count: int, fetched: list[dict], most: int) -> list[tuple]:
    """Leaf, subroot, root, hash of the proof, folded root and whether they agree, for each leaf of a block."""
    levels, _ = _inside(leaves, count, most)
    roots = {n["top"]: n for n in fetched if n["side"] == 0}
    subroot, root = roots[False]["hash"], roots[True]["hash"]
    # A node may be alone in its run and still has a level above.
    ways = [(top, level) for top, first in ((False, len(levels) - 1), (True, 0)) for level in range(first, roots[top]["level"])]
    above: dict[tuple, list[str]] = {way: ["", ""] for way in ways}
    for n in fetched:
        if n["side"]:
            above[n["top"], n["level"]][n["side"] > 0] += n["hash"]
    upper = [tuple(pair) for pair in above.values()]
    rest = "".join(map("".join, upper)).encode()
    # Nodes on the way are shared by many leaves: each pair is made once.
    shared = [[siblings(k, nodes) for k in range(len(nodes))] for nodes in levels[:-1]]
    rows = []
    for k, leaf in enumerate(leaves):
        path = [pairs[k // FAN**level] for level, pairs in enumerate(shared)]
        proof = hashlib.sha256("".join(map("".join, path)).encode())
        proof.update(rest)
        folded = fold(changed[k] or leaf, path + upper)
        rows.append((leaf, subroot, root, proof.hexdigest(), folded, folded == root))
    return rows
