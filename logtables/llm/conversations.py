"""Repair of conversation structure: the cheapest edits after which turns alternate.

A conversation is well formed if the initials of its roles read ``(s?(ua)+)?``. Rows are judged (blank,
duplicate, truncated), their order is cut into segments, and a segment is one string of symbols, a symbol for
each role and fault. Runs of equal symbols advance the costs by binary powers of one min-plus matrix.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from logtables.llm.staging import range_sums, stage

#: Rows of a conversation whose symbols form one segment.
SEGMENT = 16_384

KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
#: What a truncated row costs that is not deleted.
TRUNCATED = 3
NEVER = 1 << 60

#: What has been read so far: nothing, the system row, up to a user row, up to an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: The state after a row of the other kind of turn: the only one that an inserted or reroled row may have.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
INITIAL = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: Costs of what is still to be inserted at the end, by state.
AT_END = (0, 2 * INSERT, INSERT, 0)

#: A symbol is the initial of the role (``-`` for others), in upper case (``_``) if the row is truncated; ``x`` must go.
GONE, OTHER = "x", "-"
WHITE = "".join(map(chr, (32, *range(9, 14))))


def edits(symbol: str) -> list[tuple[str, int, tuple[int, ...]]]:
    """The edits of a row in order of their initials: initial, cost, and the state after it by the state before
    (-1: not possible)."""
    stay = tuple(STATES)
    if symbol == GONE:
        return [("D", DELETE, stay)]
    extra = TRUNCATED if symbol.isupper() or symbol == "_" else 0
    kept = INITIAL.get(symbol.lower(), {})
    return [("D", DELETE, stay), ("K", KEEP + extra, tuple(kept.get(q, -1) for q in STATES)), ("R", REROLE + extra, NEXT)]


def product(a: tuple, b: tuple) -> tuple:
    return tuple(tuple(min(a[i][k] + b[k][j] for k in STATES) for j in STATES) for i in STATES)


def advance(matrix: tuple, costs: tuple) -> tuple:
    """Costs to the end before a step, from those after it."""
    return tuple(min(row[j] + costs[j] for j in STATES) for row in matrix)


@lru_cache(maxsize=None)
def power(symbol: str, k: int) -> tuple:
    """The min-plus matrix of ``2**k`` rows of one symbol, insertions before each row included."""
    if k:
        half = power(symbol, k - 1)
        return product(half, half)
    rows = []
    for q in STATES:
        row, at, spent = [NEVER] * 4, q, 0
        for _ in range(3):  # more than two insertions come back to the same state
            for _, cost, after in edits(symbol):
                if after[at] >= 0:
                    row[after[at]] = min(row[after[at]], spent + cost)
            at, spent = NEXT[at], spent + INSERT
        rows.append(tuple(row))
    return tuple(rows)


def runs_of(symbols: str) -> list[tuple[str, int]]:
    return [(symbol, sum(1 for _ in run)) for symbol, run in groupby(symbols)]


def _powers(symbol: str, n: int) -> list[tuple]:
    return [power(symbol, k) for k in range(n.bit_length()) if n >> k & 1]


def before_run(symbol: str, n: int, costs: tuple) -> tuple:
    """Costs to the end before ``n`` rows of one symbol."""
    for matrix in _powers(symbol, n):
        costs = advance(matrix, costs)
    return costs


def matrix_of(symbols: str) -> tuple:
    """The matrix of a whole segment."""
    found = tuple(tuple(0 if i == j else NEVER for j in STATES) for i in STATES)
    for symbol, n in runs_of(symbols):
        for matrix in _powers(symbol, n):
            found = product(found, matrix)
    return found


def unroll(symbols: str, costs: tuple, start: int, last: bool) -> tuple[str, int, int]:
    """The cheapest edits of a segment, ties by the least initials, the state after it and the cost to the end.

    ``costs`` are those to the end of the conversation after the segment, by state; the ``last`` segment has
    the insertions at the end as well. Rows of a run are walked one by one only here, as each has its initial.
    """
    runs, ends = runs_of(symbols), [costs]
    for symbol, n in reversed(runs):
        ends.append(before_run(symbol, n, ends[-1]))
    total, out, q = ends.pop()[start], [], start
    for symbol, n in runs:
        ahead = [ends.pop()]  # costs after each row of the run, the last row first
        for _ in range(n):
            ahead.append(advance(power(symbol, 0), ahead[-1]))
        now, choices = ahead.pop(), edits(symbol)
        while ahead:
            rest = ahead.pop()
            used = False
            while not used:
                best = [(i, to[q]) for i, cost, to in choices if to[q] >= 0 and cost + rest[to[q]] == now[q]]
                if INSERT + now[NEXT[q]] == now[q]:
                    best.append(("I", NEXT[q]))
                edit, q = min(best)
                out.append(edit)
                used = edit != "I"
            now = rest
    while last and AT_END[q]:
        out.append("I")
        q = NEXT[q]
    return "".join(out), q, total


class Repairer:
    """The rows of one conversation, edited as they pass. Edits come piece by piece, ahead of their rows."""

    def __init__(self) -> None:
        self.pieces: deque[str] = deque()
        self.at, self.state = 0, START

    def _next(self) -> str | None:
        while self.pieces and self.at == len(self.pieces[0]):
            self.pieces.popleft()
            self.at = 0
        if not self.pieces:
            return None
        self.at += 1
        return self.pieces[0][self.at - 1]

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """Edit, role and text of rows inserted before this one and, unless it is deleted, of this one."""
        while (edit := self._next()) == "I":
            yield self._new(edit, text="")
        if edit == "K":
            self.state = INITIAL[role[:1]][self.state]
            yield edit, role, text
        elif edit == "R":
            yield self._new(edit, text)

    def end(self) -> Iterator[tuple[str, str, str]]:
        while (edit := self._next()) is not None:
            yield self._new(edit, text="")

    def _new(self, edit: str, text: str) -> tuple[str, str, str]:
        self.state = NEXT[self.state]
        return edit, ROLE[self.state], text


# Tables


def judged(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A slim row per row: its conversation, turn, role, MD5 of the text, exact place in the conversation, first fault
    (``blank``, ``duplicate``, ``truncated`` or null), symbol and initial.

    Order is by turn, null first, then role, then MD5 of the text. Null roles and texts are one space.
    """
    said = F.coalesce(F.col(text), F.lit(" "))
    body = F.btrim(said, F.lit(WHITE))
    slim = rows.select(
        F.struct(F.col(conv_id).alias("of")).alias("_conv"), F.col(turn).cast("long").alias("_turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("_role"), F.unhex(F.md5(said)).alias("_mark"),
        F.when(body == "", "blank").when(~F.right(body, F.lit(1)).isin(*".!?"), "truncated").alias("_fault"),
    )
    placed = stage(range_sums(stage(slim, "turns"), "_conv", ["_turn", "_role", "_mark"], F.lit(1), "places").withColumnRenamed("_before", "_place"), "placed")
    said_twice = placed.groupBy("_conv", "_role", "_mark").agg(F.min("_place").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    found = placed.join(said_twice, ["_conv", "_role", "_mark"], "left")
    fault = F.when(F.col("_fault") == "blank", "blank").when(F.col("_place") > F.col("_first"), "duplicate").otherwise(F.col("_fault"))
    first = F.substring("_role", 1, 1)
    initial = F.when(first.isin("s", "u", "a"), first).otherwise(OTHER)
    symbol = F.when(F.col("_fault").isin("blank", "duplicate"), GONE).when(F.col("_fault") == "truncated", F.translate("_initial", "sua-", "SUA_"))
    return (
        found.withColumn("_fault", fault).drop("_first").withColumn("_initial", initial)
        .withColumn("_symbol", symbol.otherwise(F.col("_initial"))).withColumn("_segment", F.expr(f"_place div {SEGMENT}"))
    )


def segments(rows: DataFrame) -> DataFrame:
    """A row per segment of :func:`judged` rows: ``symbols``, ``initials`` (behind the last one of the segment before),
    the key of its first row, counts of faults and the segments of the conversation."""
    members = F.sort_array(F.collect_list(F.struct("_place", "_symbol", "_initial")))
    cut = rows.groupBy("_conv", "_segment").agg(
        F.array_join(members["_symbol"], "").alias("symbols"), F.array_join(members["_initial"], "").alias("initials"),
        F.min_by(F.struct("_turn", "_role", "_mark"), "_place").alias("_key"),
        *[F.count_if(F.col("_fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")],
    )
    conv = Window.partitionBy("_conv")  # a row per segment
    before = F.coalesce(F.lag(F.right("initials", F.lit(1))).over(conv.orderBy("_segment")), F.lit(""))
    return stage(cut.withColumn("initials", F.concat(before, "initials")).withColumn("_segments", F.count("*").over(conv)), "segments")


def _in_order(rows: DataFrame, *order: Column) -> DataFrame:
    return rows.repartition("_conv").sortWithinPartitions("_conv", *order)


def _streamed(rows: DataFrame, step, schema: str) -> DataFrame:
    """``step`` of each row in order, with the state that the row before in the same conversation left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                if last is None or row["_conv"] != last:
                    last, state = row["_conv"], None
                out, state = step(row, state)
                found.append(out)
            if found:
                names = found[0].keys()
                yield pa.record_batch([batch.column("_conv"), *[pa.array([f[n] for f in found]) for n in names]], names=["_conv", *names])

    return rows.mapInArrow(run, schema)


def starts(cut: DataFrame) -> DataFrame:
    """State before and costs after each segment of the conversations that have several.

    Costs pass backward through the matrices of the segments, then states forward. Only a row per segment of
    16,384 rows moves, and one is held at a time.
    """
    conv = cut.schema["_conv"].dataType.simpleString()
    many = cut.where("_segments > 1").select("_conv", "_segment", "symbols", (F.col("_segment") == F.col("_segments") - 1).alias("last"))

    def back(row: dict, costs: tuple | None) -> tuple[dict, tuple]:
        after = AT_END if costs is None else costs
        found = {"_segment": row["_segment"], "symbols": row["symbols"], "last": row["last"], "costs": list(after)}
        return found, advance(matrix_of(row["symbols"]), after)

    def forth(row: dict, state: int | None) -> tuple[dict, int]:
        start = START if state is None else state
        return {"_segment": row["_segment"], "costs": row["costs"], "start": start}, unroll(row["symbols"], tuple(row["costs"]), start, row["last"])[1]

    costed = _streamed(_in_order(many, F.desc("_segment")), back, f"_conv {conv}, _segment long, symbols string, last boolean, costs array<long>")
    return _streamed(_in_order(costed, F.asc("_segment")), forth, f"_conv {conv}, _segment long, costs array<long>, start long")


def solved(cut: DataFrame) -> DataFrame:
    """:func:`segments` with ``edits`` (initials), ``cost`` (to the end of the conversation) and ``illegal`` (neighbours)."""

    @F.arrow_udf("edits string, cost long, illegal long")
    def edited(symbols: pa.Array, initials: pa.Array, costs: pa.Array, start: pa.Array, last: pa.Array) -> pa.Array:
        found = []
        for of, roles, after, q, end in zip(*(c.to_pylist() for c in (symbols, initials, costs, start, last))):
            letters, _, cost = unroll(of, tuple(after) if after else AT_END, q or START, end)
            found.append((letters, cost, sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))))
        columns = list(zip(*found)) or [(), (), ()]
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()))], names=["edits", "cost", "illegal"])

    known = cut.join(starts(cut), ["_conv", "_segment"], "left")
    last = F.col("_segment") == F.col("_segments") - 1
    found = known.withColumn("_found", edited.asNondeterministic()(F.col("symbols"), F.col("initials"), F.col("costs"), F.col("start"), last))
    return stage(found.select(*cut.columns, "_found.*"), "edits")


def _passed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows and pieces of edits in order, as (conversation, (edit, role, text)); None in place of these ends a conversation."""
    current, repairer = None, None
    for batch in batches:
        for row in batch.to_pylist():
            if row["_conv"] != current:
                if repairer is not None:
                    yield from ((current, new) for new in repairer.end())
                    yield current, None
                current, repairer = row["_conv"], Repairer()
            if row["_segment"] is not None:
                repairer.pieces.append(row["_text"])
            else:
                yield from ((current, new) for new in repairer.row(row["_role"], row["_text"]))
    if repairer is not None:
        yield from ((current, new) for new in repairer.end())
        yield current, None


#: A batch of results ends at so many characters or rows.
BATCH_SIZE = 4_000_000
BATCH_ROWS = 10_000


def _mapped(ordered: DataFrame, rows_of, schema: str) -> DataFrame:
    """``rows_of`` the passing rows, as a table with ``_conv`` and ``schema``; sizes of batches are bounded."""
    conv = ordered.schema["_conv"].dataType
    kinds = to_arrow_schema(StructType([StructField("_conv", conv), *StructType.fromDDL(schema).fields]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for row in rows_of(_passed(batches)):
            found.append(row)
            size += len(row[-1])
            if size > BATCH_SIZE or len(found) > BATCH_ROWS:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found), kinds.types)], schema=kinds)
                found, size = [], 0
        if found:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found), kinds.types)], schema=kinds)

    return ordered.mapInArrow(run, f"_conv {conv.simpleString()}, {schema}")


def _with_edits(rows: DataFrame, pieces: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """Whole rows and, ahead of those of each segment, its edits, by conversation and in order."""
    said = F.coalesce(F.col(text), F.lit(" "))
    own = rows.select(
        F.struct(F.col(conv_id).alias("of")).alias("_conv"), F.col(turn).cast("long").alias("_turn"), F.coalesce(F.col(role), F.lit(" ")).alias("_role"),
        F.unhex(F.md5(said)).alias("_mark"), F.lit(None).cast("long").alias("_segment"), said.alias("_text"),
    )
    ahead = pieces.select("_conv", "_key.*", "_segment", F.col("edits").alias("_text"))
    order = [F.asc_nulls_first("_turn"), F.asc("_role"), F.asc("_mark"), F.asc_nulls_last("_segment")]
    return _in_order(own.unionByName(ahead), *order).select("_conv", "_role", "_segment", "_text")


def repaired_rows(rows: DataFrame, pieces: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired conversations: id, ``place`` (from 0), ``edit`` (``K``, ``R`` or ``I``), role and text of each row.
    ``pieces`` is what :func:`solved` found for the same rows."""

    def numbered(passing: Iterator[tuple]) -> Iterator[tuple]:
        place = 0
        for conv, new in passing:
            if new is None:
                place = 0
            else:
                yield conv, place, *new
                place += 1

    found = _mapped(_with_edits(rows, pieces, conv_id, turn, role, text), numbered, "place long, edit string, role string, text string")
    return found.select(F.col("_conv.of").alias(conv_id), "place", "edit", F.col("role").alias(role), F.col("text").alias(text))


def digests(rows: DataFrame, pieces: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``_conv`` and ``repaired_sha256`` of its repaired rows as ``role:text``, joined by line feeds.

    A SHA-256 is sequential, so the rows of one conversation pass through one task, one at a time.
    """

    def hashed(passing: Iterator[tuple]) -> Iterator[tuple]:
        mark, between = hashlib.sha256(), ""
        for conv, new in passing:
            if new is None:
                yield conv, mark.hexdigest()
                mark, between = hashlib.sha256(), ""
            else:
                mark.update(f"{between}{new[1]}:{new[2]}".encode())
                between = "\n"

    return _mapped(_with_edits(rows, pieces, conv_id, turn, role, text), hashed, "repaired_sha256 string")


def repair_report(
    original: DataFrame, rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per conversation of ``original``, judged and repaired as ``rows`` have it.

    Columns: id, ``gaps`` in the turns, rows by first fault (``blank``, ``duplicate``, ``truncated``), ``illegal``
    neighbours, least ``cost``, ``audit`` (initials of the edits, ties by the least) and ``repaired_sha256``. A
    conversation without rows gets zeros, an empty audit and the hash of the empty text; the null id is one
    conversation. Repeated rows are rows each, the later ones duplicates; null turns come first. An empty table
    gives an empty one.

    Rows are placed by sums over ranges and cut into segments of 16,384, so a conversation that holds most rows
    is spread over many tasks; only its audit and its hash, which are one value, come together, from edits and
    from rows that pass one at a time.
    """
    turns = judged(rows, conv_id, turn, role, text)
    pieces = solved(segments(turns))
    counted = pieces.groupBy("_conv").agg(
        *[F.sum(name).alias(name) for name in ("blank", "duplicate", "truncated", "illegal")],
        F.max(F.when(F.col("_segment") == 0, F.col("cost"))).alias("cost"),
        F.array_join(F.sort_array(F.collect_list(F.struct("_segment", "edits")))["edits"], "").alias("audit"),
    )
    spans = turns.groupBy("_conv").agg((F.max("_turn") - F.min("_turn") + 1 - F.count_distinct("_turn")).alias("gaps"))
    all_convs = original.select(F.struct(F.col(conv_id).alias("of")).alias("_conv")).distinct()
    found = all_convs.join(spans, "_conv", "left").join(counted, "_conv", "left").join(digests(rows, pieces, conv_id, turn, role, text), "_conv", "left")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    nothing = hashlib.sha256(b"").hexdigest()
    return found.select(
        F.col("_conv.of").alias(conv_id), *[F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n) for n in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"),
    )


def damaged(rows: DataFrame) -> DataFrame:
    """The rows of ``conversations`` with planted damage, by a checksum of conversation and turn: some dropped, emptied,
    without sentence ends, repeated or given the role ``user``. Nulls count as one space."""
    number = F.crc32(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])) % 20
    text, role = (F.coalesce(F.col(c), F.lit(" ")) for c in ("text", "role"))
    return rows.select(
        "conv_id", "turn", F.when(number == 4, "user").otherwise(role).alias("role"),
        F.when(number == 1, "").when(number == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(number == 3, 2).otherwise(1))).alias("copy"), number.alias("number"),
    ).where("number != 0").drop("copy", "number")
