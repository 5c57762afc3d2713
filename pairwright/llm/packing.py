"""Best-fit packing by sums of squares.

An item goes where the squared counts of open bins, summed over the residual gaps, become smallest: into
an open bin, or into a new one. Counts per gap are all that the rule needs, so its state is one array of
`capacity` numbers and the open bins' ids. Longest items come first. As the rule keeps gaps of every size
open, which pays in long runs only, a finished window is mended: the bins that it left open are taken apart,
and so are MENDED in a hundred of the full ones, those of the most items, and their items go where they fit
best.

Each scan partition tokenises and packs its own documents in one pass; what doesn't fill its sequences to
the last token is dealt out anew, to as many tasks as its tokens fill windows, and closed there. So the
number of sequences hardly depends on how the table is laid out in files.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.common import materialize, ship
from pairwright.llm.tokens import byte_bpe, default_ranks_path

CAPACITY = 1024
END_OF_DOCUMENT = 2
MENDED = 20
SCHEMA = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long"
_KINDS = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
_NEVER = np.iinfo(np.int64).max


class SumOfSquares:
    """Assigns items to bins of a capacity; `closing` uses best fit, for the last items."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, dtype=np.int64)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bins = 0

    def place(self, size: int, closing: bool = False) -> int:
        """The item's bin. Gap 0 isn't counted: a full bin is no longer open."""
        n, c = self.counts, self.capacity
        have, gap = n[size:], -1
        if closing:
            fits = np.flatnonzero(have)
            gap = size + int(fits[0]) if len(fits) else -1
        elif have.any():
            # moving a bin from gap g to g - size changes the sum by 2 (n[g - size] - n[g]) + 2
            change = np.where(have > 0, 2 * (n[: c + 1 - size] - have) + 2, _NEVER)
            if have[0] > 0:
                change[0] = 1 - 2 * have[0]
            best = int(change.argmin())
            gap = size + best if change[best] <= (2 * n[c - size] + 1 if size < c else 0) else -1
        if gap < 0:
            at, gap, self.bins = self.bins, c, self.bins + 1
        else:
            at = self.open[gap].pop()
            n[gap] -= 1
        if gap > size:
            n[gap - size] += 1
            self.open[gap - size].append(at)
        return at


def _placed(sizes: list[int], capacity: int, closing: bool) -> list[list[int]]:
    """The items of each bin, longest first."""
    rule, bins = SumOfSquares(capacity), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        b = rule.place(sizes[i], closing)
        if b == len(bins):
            bins.append([])
        bins[b].append(i)
    return bins


def pack(sizes: list[int], capacity: int, closing: bool) -> tuple[list[int], list[int], list[int]]:
    """For each item its bin and offset; and for each bin what it holds. closing: by best fit alone."""
    found = _placed(sizes, capacity, closing)
    if not closing:
        held = [sum(sizes[i] for i in b) for b in found]
        full = sorted((k for k, h in enumerate(held) if h == capacity), key=lambda k: -len(found[k]))
        apart = {k for k, h in enumerate(held) if h < capacity}
        if apart:
            apart.update(full[: MENDED * len(full) // 100])
        again = [i for k in sorted(apart) for i in found[k]]
        mended = [[again[i] for i in b] for b in _placed([sizes[i] for i in again], capacity, True)]
        if len(mended) <= len(apart):
            found = [b for k, b in enumerate(found) if k not in apart] + mended
    bins, offsets, used = [0] * len(sizes), [0] * len(sizes), []
    for k, b in enumerate(found):
        at = 0
        for i in b:
            bins[i], offsets[i] = k, at
            at += sizes[i]
        used.append(at)
    return bins, offsets, used


def cut(ids: bytes, capacity: int) -> Iterator[tuple[int, int, bytes]]:
    """piece, start and ids of a document's pieces: all but the first one are full."""
    n = len(ids) // 4
    start, end = 0, n if n <= capacity else n % capacity or capacity
    piece = 0
    while start < n:
        yield piece, start, ids[4 * start : 4 * end]
        piece, start, end = piece + 1, end, end + capacity


def _emit(rows: list[tuple], numbers: list[int | None], offsets: list[int | None]) -> pa.RecordBatch:
    doc_id, piece, start, ids = zip(*rows, strict=True)
    columns = (doc_id, piece, start, [len(x) // 4 for x in ids], ids, numbers, offsets)
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, _KINDS, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])


def _first_pass(ranks_path: str, capacity: int, window: int):
    """Pieces of documents; those that no full sequence takes have no sequence_id yet."""
    end = np.array([END_OF_DOCUMENT], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, next_id = byte_bpe(ranks_path), TaskContext.get().partitionId() << 40
        held: list[tuple] = []
        waiting = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, waiting, next_id
            if held:
                bins, offsets, used = pack([len(r[3]) // 4 for r in held], capacity, closing=False)
                full = [used[b] == capacity for b in bins]
                yield _emit(held, [next_id + b if ok else None for b, ok in zip(bins, full, strict=True)], [o if ok else None for o, ok in zip(offsets, full, strict=True)])
                next_id += len(used)
                held, waiting = [], 0

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for piece, start, ids in cut(bpe.encode(text.as_py() or "") + end, capacity):
                    held.append((doc_id, piece, start, ids))
                    waiting += len(ids) // 4
                if waiting >= window:
                    yield from flush()
        yield from flush()

    return run


def _second_pass(capacity: int, window: int):
    """Closes what the first pass left over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_id = (1 << 62) + (TaskContext.get().partitionId() << 40)
        held: list[tuple] = []
        waiting = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, waiting, next_id
            if held:
                bins, offsets, used = pack([len(r[3]) // 4 for r in held], capacity, closing=False)
                yield _emit(held, [next_id + b for b in bins], offsets)
                next_id += len(used)
                held, waiting = [], 0

        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in (0, 1, 2, 4)), strict=True):
                held.append(row)
                waiting += len(row[3]) // 4
            if waiting >= 2 * window:
                yield from flush()
        yield from flush()

    return run


def pack_documents(docs: DataFrame, ranks_path: str | None = None, capacity: int = CAPACITY, window: int = 4_000_000) -> DataFrame:
    """Every piece of every document (doc_id, text) with its ids, sequence and place.

    ids are little-endian unsigned 32-bit numbers; a document ends in END_OF_DOCUMENT, so an empty or null
    text makes one piece of one id. Repeated rows and null ids are packed like any other; an empty table
    gives none; other columns don't matter, whatever their names. `window` bounds, in tokens, what a task
    holds: one window, or two in the second pass.
    """
    ship(docs.sparkSession)
    run = _first_pass(ranks_path or default_ranks_path(), capacity, window)
    found = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA))
    left = found.filter("sequence_id IS NULL")
    tasks = -(-left.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0] // window) or 1
    return found.filter("sequence_id IS NOT NULL").unionByName(left.repartition(tasks).mapInArrow(_second_pass(capacity, window), SCHEMA))


def packing_report(docs: DataFrame) -> DataFrame:
    return pack_documents(docs).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
