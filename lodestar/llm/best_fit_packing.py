"""Packing token sequences by bounded-space online best-fit.

A fixed number of bins is open. A bitset keyed by free space finds the fullest bin that still holds a piece; where none
does and all places are taken, the fullest bin closes. Each task packs what it reads in the order in which it comes,
without a shuffle; only the bins that are open at its end are packed once more, as wholes, by the same rule and bound
over groups of tasks.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import arrow_rows, cut, release_memory
from lodestar.llm.encoding import encoder

CAPACITY = 2048
OPEN_BINS = 128
#: Texts that are encoded, and pieces that are handed on, at a time.
SLICE = 2_000
#: Rows of an Arrow batch at most.
ROWS = 2_000
#: Tasks whose last open bins are packed together.
GROUP = 64


@dataclass
class BestFit:
    """The packer. Bits of ``free`` mark the amounts of free space that some open bin has."""

    capacity: int = CAPACITY
    open_bins: int = OPEN_BINS
    free: int = 0
    n_open: int = 0
    n_made: int = 0
    stacks: dict[int, list[int]] = field(default_factory=dict)
    filled: dict[int, int] = field(default_factory=dict)

    def _take(self, space: int) -> int:
        stack = self.stacks[space]
        made = stack.pop()
        if not stack:
            del self.stacks[space]
            self.free &= ~(1 << space)
        self.n_open -= 1
        return made

    def place(self, size: int) -> tuple[int, int, list[int]]:
        """``(bin, offset, bins that closed)`` for a piece of at most the capacity."""
        closed = []
        fits = self.free >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            at = self._take(space)
        else:
            if self.n_open >= self.open_bins:
                at = self._take((self.free & -self.free).bit_length() - 1)
                closed.append(at)
                del self.filled[at]
            at, space = self.n_made, self.capacity
            self.n_made += 1
            self.filled[at] = 0
        offset = self.filled[at]
        space -= size
        if space:
            self.stacks.setdefault(space, []).append(at)
            self.free |= 1 << space
            self.n_open += 1
            self.filled[at] = offset + size
        else:
            closed.append(at)
            del self.filled[at]
        return at, offset, closed


def pieces_of(ids: bytes, capacity: int) -> list[tuple[int, bytes]]:
    """``(start, ids)`` of the pieces of a document: all full but the first, which may be shorter."""
    n = len(ids) // 4
    head = n % capacity or min(n, capacity)
    starts = [0, *range(head, n, capacity)]
    return [(a, ids[4 * a : 4 * b]) for a, b in zip(starts, [*starts[1:], n], strict=True)]


SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("task", pa.int64()), ("bin", pa.int64()), ("offset", pa.int64()), ("open", pa.bool_())])
DDL = "doc_id long, piece int, start long, length long, ids binary, task long, bin long, offset long, open boolean"


def _packed(path: str, end_id: int, capacity: int, open_bins: int):
    end = end_id.to_bytes(4, "little")

    def run(batches):
        task = TaskContext.get().partitionId()
        packer = BestFit(capacity, open_bins)
        held: dict[int, list[tuple]] = {}  # the pieces of open bins: at most open_bins * capacity ids
        ready: list[tuple] = []

        def batch_of(rows, still_open):
            columns = list(zip(*rows, strict=True))
            n = len(rows)
            return pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(columns[:5], SCHEMA, strict=False)), pa.array([task] * n, pa.int64()), pa.array(columns[5], pa.int64()), pa.array(columns[6], pa.int64()), pa.array([still_open] * n)], schema=SCHEMA)

        for batch in batches:
            encode = encoder(path, spaced=True)
            for first in range(0, batch.num_rows, SLICE):
                some = batch.slice(first, SLICE)
                for doc_id, ids in zip(some.column(0).to_pylist(), encode(some.column(1)), strict=True):
                    for k, (start, part) in enumerate(pieces_of(ids + end, capacity)):
                        at, offset, closed = packer.place(len(part) // 4)
                        held.setdefault(at, []).append((doc_id, k, start, len(part) // 4, part, at, offset))
                        for done in closed:
                            ready += held.pop(done)
                if len(ready) >= SLICE:
                    yield batch_of(ready, False)
                    ready = []
        if ready:
            yield batch_of(ready, False)
        left = [x for rows in held.values() for x in rows]
        for at in range(0, len(left), SLICE):
            yield batch_of(left[at : at + SLICE], True)
        held.clear()
        release_memory()

    return run


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, piece, start, length, ids, sequence_id, offset)``: the pieces of all documents in their sequences.

    A document is the ids of its whole text and ``end_id``; only one longer than ``capacity`` is cut. ``ids`` are the
    piece's ids as little-endian unsigned 32-bit integers. In a sequence the offsets run gapless from 0. A null or
    empty text is its ``end_id``; repeated rows and rows without an id are packed each; an empty table gives an empty
    result; other columns are not read.

    Scale: one pass, no shuffle of texts or ids but for those in the last ``open_bins`` bins of a task; a task holds
    those bins and one Arrow batch. The packed table is written once, so the second step repeats no encoding.
    """
    source = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    with arrow_rows(docs.sparkSession, ROWS):
        packed = cut(source.mapInArrow(_packed(tokenizer, end_id, capacity, open_bins), DDL), "packed")
    last = packed.where("open").groupBy("task", "bin").agg(F.sum("length").alias("fill"))

    def again(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("task", "ascending"), ("bin", "ascending")])
        packer = BestFit(capacity, open_bins)
        placed = [packer.place(x)[:2] for x in rows["fill"].to_pylist()]
        base = (1 << 62) + (rows["task"][0].as_py() // group << 32)
        return pa.table({"task": rows["task"], "bin": rows["bin"], "sequence_id": pa.array([base + b for b, _ in placed], pa.int64()), "shift": pa.array([o for _, o in placed], pa.int64())})

    moved = last.groupBy(F.floor(F.col("task") / group).alias("_group")).applyInArrow(again, "task long, bin long, sequence_id long, shift long")
    columns = ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]
    done = packed.where("NOT open").withColumn("sequence_id", F.shiftleft("task", 32) + F.col("bin")).select(columns)
    rest = packed.where("open").join(moved.hint("merge"), ["task", "bin"]).withColumn("offset", F.col("offset") + F.col("shift")).select(columns)
    return done.unionByName(rest)
