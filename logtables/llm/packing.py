"""Best-fit packing of tokenized documents into sequences of fixed length, with few open bins."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtables.llm.staging import session_of
from logtables.llm.tokens import encode, tokenizer_path

SEQUENCE = 2048
#: Bins that a task keeps open; another closes the fullest.
OPEN_BINS = 512
END = (0).to_bytes(4, "little")
#: Sequences of one task are numbered from its number times this.
PER_TASK = 1 << 36

SCHEMA = "piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class Packer:
    """Online best fit with a bounded number of open bins.

    Open bins are listed by free space. A bit for each free space that occurs makes the best fit one
    operation on whole numbers: the lowest bit that is not below the length. A full bin is closed at
    once; if there are too many, the fullest closes, which is the lowest bit of all.
    """

    def __init__(self, sequence: int, open_bins: int, first_id: int):
        self.sequence, self.open_bins, self.next_id = sequence, open_bins, first_id
        self.by_free: list[list[int]] = [[] for _ in range(sequence + 1)]
        self.bits = 0
        self.n_open = 0

    def _take(self, free: int) -> int:
        found = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits &= ~(1 << free)
        self.n_open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """The sequence and the offset for a piece of ``length`` tokens, 1 to the sequence's length."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            bin_id = self._take(free)
        else:
            free, bin_id = self.sequence, self.next_id
            self.next_id += 1
        left = free - length
        if left:
            if self.n_open >= self.open_bins:
                fullest = (self.bits & -self.bits).bit_length() - 1
                if left <= fullest:  # the new one is the fullest
                    return bin_id, self.sequence - free
                self._take(fullest)
            self.by_free[left].append(bin_id)
            self.bits |= 1 << left
            self.n_open += 1
        return bin_id, self.sequence - free


def cut(n: int, sequence: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of ``n`` tokens: all full but the first, which has the rest."""
    first = n % sequence or sequence
    return [(0, first), *[(s, sequence) for s in range(first, n, sequence)]]


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", tokenizer: str | None = None, sequence: int = SEQUENCE, open_bins: int = OPEN_BINS) -> DataFrame:
    """One row per piece of each row of ``docs``: its id, ``piece``, ``start``, ``length``, ``ids_crc32``,
    ``sequence_id`` and ``offset``.

    A document is the ids of its text and id 0; an empty or null text is one piece of id 0. Only
    documents longer than a sequence are cut. Rows that are repeated or have no id are packed like any
    other. Every task packs the rows it reads by itself: no row moves, memory holds one batch and the
    open bins, and a repeated task gives the same numbers. What a task leaves open at its end is at
    most ``open_bins`` sequences, most of them nearly full. An empty table gives an empty one.
    """
    session_of(docs)
    path = tokenizer_path(tokenizer)
    kind = docs.schema[doc_id].dataType.simpleString()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = Packer(sequence, open_bins, TaskContext.get().partitionId() * PER_TASK)
        for batch in batches:
            at: list[int] = []
            rows: list[tuple] = []
            for k, body in enumerate(batch.column(1).to_pylist()):
                ids = encode(body, path) + END
                for piece, (start, length) in enumerate(cut(len(ids) // 4, sequence)):
                    sequence_id, offset = packer.place(length)
                    at.append(k)
                    rows.append((piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), sequence_id, offset))
            if rows:
                columns = list(zip(*rows))
                kinds = [pa.int32(), *[pa.int64()] * 5]
                yield pa.record_batch(
                    [batch.column(0).take(pa.array(at)), *[pa.array(c, t) for c, t in zip(columns, kinds)]],
                    names=[doc_id, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
                )

    return docs.select(F.col(doc_id), F.col(text).alias("_text")).mapInArrow(packed, f"`{doc_id}` {kind}, {SCHEMA}")
