"""Best-fit packing of tokenised documents into sequences by a bounded-space online algorithm.

A document's ids are its tokens and one end id. Documents of at most `capacity` ids are one piece; longer ones are cut
into pieces of `capacity` ids, of which the first holds the remainder. Pieces arrive one at a time, long ones first; each
goes to the open bin with the least free space that holds it, found in one step in a bitset keyed by free space. A fixed
number of bins is open; when one more is opened, the fullest closes.

Only (id, piece, length, checksum) rows are dealt to the packing tasks, never tokens, and every task packs its own
share, so the number of tasks follows the number of pieces and no group meets in one task. The dealing is a function of
identifier and piece, and the order within a task is total, so a task that runs again packs the same way.

Defined results. Null and empty texts are one piece that holds the end id. Rows with null identifier are packed like
others; an identifier that is no number becomes null. Repeated rows are packed once each. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import tidy, written
from sheaf.llm.tokens import token_ids

CAPACITY = 1024
END_ID = 2
#: Open bins of a task.
OPEN_BINS = 65_536
#: Pieces of one packing task.
TASK_PIECES = 131_072

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; the first piece may be shorter."""
    first = total - (max(total, 1) - 1) // capacity * capacity
    return [(0, first)] + [(start, capacity) for start in range(first, total, capacity)]


def _pieces(capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = np.array([end_id], dtype="<u4")
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(ids, texts, strict=True):
                tokens = np.concatenate([token_ids(text.as_py()).astype("<u4"), tail])
                for k, (start, length) in enumerate(cut(len(tokens), capacity)):
                    crc = zlib.crc32(tokens[start : start + length].tobytes())
                    for column, value in zip(out, (doc, k, start, length, crc), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)

    return run


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    return docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), "text").mapInArrow(tidy("packing", _pieces(capacity, end_id)), PIECE_SCHEMA)


class OpenBins:
    """Bins that are still open, keyed by free space; a bit of `mask` is set where some bin has that much free."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.mask, self.open, self.made = 0, 0, 0
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        number = self.at[free].pop()
        if not self.at[free]:
            self.mask ^= 1 << free
        self.open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """The number of the bin that a piece goes to, and its offset there."""
        fits = self.mask >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            free, number = self.capacity, self.made
            self.made += 1
        rest = free - length
        if rest:
            if self.open == self.limit:  # the fullest closes, be it the bin at hand
                fullest = (self.mask & -self.mask).bit_length() - 1
                if rest <= fullest:
                    return number, self.capacity - free
                self._take(fullest)
            self.at[rest].append(number)
            self.mask |= 1 << rest
            self.open += 1
        return number, self.capacity - free


def _pack(capacity: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        bins = OpenBins(capacity, limit)
        for batch in batches:
            placed = [bins.place(n) for n in batch.column("length").to_pylist()]
            sequence = pa.array([base + n for n, _ in placed], pa.int64())
            offset = pa.array([o for _, o in placed], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, sequence, offset], names=[*batch.schema.names, "sequence_id", "offset"])

    return run


def best_fit(
    found: DataFrame, count: int, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, task_pieces: int = TASK_PIECES
) -> DataFrame:
    """Add sequence_id and offset to `count` rows of pieces."""
    tasks = max(1, -(-count // task_pieces))
    dealt = found.repartition(tasks, F.xxhash64("doc_id", "piece", "ids_crc32"))
    dealt = dealt.sortWithinPartitions(F.desc("length"), "doc_id", "piece", "ids_crc32")
    return dealt.mapInArrow(tidy("packing", _pack(capacity, open_bins)), f"{PIECE_SCHEMA}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, open_bins: int = OPEN_BINS) -> DataFrame:
    found = written(pieces(docs, capacity, end_id), "packing-pieces")
    return best_fit(found, found.count(), capacity, open_bins)
