"""Best-fit packing of documents into sequences of several permitted lengths.

Every piece of every document is placed exactly once.  A document longer than
the largest length is cut into pieces of that length and a remainder.  Within a
block of pieces, taken longest first, a piece goes to the open bin that it fills
most tightly.  When none has room, a bin is opened: for each permitted length the
pieces still waiting are tried, longest first, and the length whose filled and
downsized bin costs least a token is taken.  At the end each bin shrinks to the
smallest permitted length that holds its contents.  The same block is also packed
with each length alone for its new bins, and the cheapest of all these packings is
kept, so several lengths never cost more than any one of them.

Texts are read once, by narrow tasks that only count tokens.  What is shuffled is one
row of three numbers a document: these are dealt evenly into blocks of about
``block_pieces`` pieces, so bins don't depend on how files are split, a task's memory
has a bound, and documents of one id or source are spread over all blocks.

Defined cases: a null or empty text is one piece that holds only the end mark;
equal lengths keep the order of (doc_id, input order); repeated rows are packed
once per row; a very long text is many pieces; a null doc_id is kept; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm import textnum
from tallyframe.llm.store import written

SCHEMA = "doc_id bigint, piece int, first_token bigint, n_tokens int, bin_id bigint, bin_length int, bin_offset int, bin_tokens int"
LENGTHS = (512, 1024, 2048, 4096, 8192)


@dataclass(frozen=True)
class Cost:
    """Cost of one sequence of c tokens: ``fixed + c + c * c / quadratic``.

    ``fixed`` stands for what any sequence costs (padding to a batch, launch),
    the last term for attention.
    """

    fixed: float = 64.0
    quadratic: float = 262_144.0

    def of(self, c: int) -> float:
        return self.fixed + c + c * c / self.quadratic


class Waiting:
    """How many pieces of each size are still to be placed."""

    def __init__(self, sizes: np.ndarray, most: int):
        self.count = np.bincount(sizes, minlength=most + 1).tolist()
        self.some = sum(1 << int(n) for n in np.unique(sizes))  # bit n is set if a piece of n tokens waits

    def take(self, n: int) -> None:
        self.count[n] -= 1
        if not self.count[n]:
            self.some &= ~(1 << n)

    def fill(self, room: int) -> int:
        """Tokens of the waiting pieces that go into some room, longest first."""
        left = room
        size = left + 1
        while left and (fits := self.some & ((1 << min(size, left + 1)) - 1)):
            size = fits.bit_length() - 1
            left -= size * min(self.count[size], left // size)
        return room - left


def _packed(sizes: np.ndarray, permitted: Sequence[int], costs: Sequence[float], only: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin of each piece, its offset there, and the tokens of each bin; ``only``: the length of all bins whose first piece it holds."""
    waiting = Waiting(sizes, permitted[-1])
    holds = np.searchsorted(permitted, np.arange(permitted[-1] + 1)).tolist()  # number of the smallest length for so many tokens

    def worth(c: int, n: int) -> float:
        full = n + waiting.fill(c - n)
        return costs[holds[full]] / full

    order = np.argsort(-sizes, kind="stable")
    bin_of, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    rooms: list[list[int]] = [[] for _ in range(permitted[-1] + 1)]  # open bins by room left
    open_rooms = 0  # bit r is set if a bin with r tokens of room is open
    used: list[int] = []
    for at, n in zip(order.tolist(), sizes[order].tolist()):
        waiting.take(n)
        fitting = open_rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                open_rooms &= ~(1 << room)
        else:
            b, room = len(used), permitted[holds[n]]
            if only is None:
                room = min(permitted[holds[n] :], key=lambda c: worth(c, n))
            elif only > room:
                room = only
            used.append(0)
        bin_of[at], offset[at] = b, used[b]
        used[b] += n
        if room > n:
            rooms[room - n].append(b)
            open_rooms |= 1 << (room - n)
    return bin_of, offset, np.array(used, np.int64)


def pack_lengths(sizes: np.ndarray, lengths: Sequence[int] = LENGTHS, cost: Cost = Cost()) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bin of each piece and its offset there, and of each bin its length and its tokens.

    ``sizes`` are between 1 and the largest permitted length.
    """
    permitted = sorted({int(c) for c in lengths})
    if not len(sizes):
        return (np.zeros(0, np.int64),) * 4
    costs = [cost.of(c) for c in permitted]
    best = None
    for only in (None, *permitted) if len(permitted) > 1 else permitted:
        bin_of, offset, filled = _packed(sizes, permitted, costs, only)
        shrunk = np.searchsorted(permitted, filled)
        total = float(np.array(costs)[shrunk].sum())
        if best is None or total < best[0]:
            best = total, bin_of, offset, np.array(permitted, np.int64)[shrunk], filled
    return best[1:]


def _pieces(ids: np.ndarray, tokens: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, piece number and size of each piece."""
    count = -(-tokens // most)
    row = np.repeat(np.arange(len(ids)), count)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return row, piece, np.minimum(most, tokens[row] - piece * most)


def pack(docs: DataFrame, lengths: Sequence[int] = LENGTHS, cost: Cost = Cost(), block_pieces: int = 20_000) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text) with its place; a token is a word between ASCII white space, and each text ends with one end mark."""
    permitted = tuple(sorted({int(c) for c in lengths}))
    if not permitted or permitted[0] < 1:
        raise ValueError("lengths must be positive")
    most = permitted[-1]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textnum.slices(batch):
                texts = textnum.Texts(part.column("text"))
                tokens = np.bincount(texts.spans(textnum.SPACED)[2], minlength=texts.n).astype(np.int64) + 1
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), pa.array(tokens)], ["doc_id", "row", "tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(batches, pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("tokens", pa.int64())])).combine_chunks()
        if not len(held):
            return
        held = held.take(pa.compute.sort_indices(held, [("doc_id", "ascending"), ("row", "ascending")]))
        ids = held.column("doc_id").combine_chunks()
        row, piece, size = _pieces(np.arange(len(held)), held.column("tokens").to_numpy(), most)
        bin_of, offset, length, filled = pack_lengths(size, permitted, cost)
        first_bin = TaskContext.get().partitionId() << 36
        out = [ids.take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(piece * most, pa.int64()), pa.array(size, pa.int32()), pa.array(first_bin + bin_of, pa.int64()), pa.array(length[bin_of], pa.int32()), pa.array(offset, pa.int32()), pa.array(filled[bin_of], pa.int32())]
        table = pa.Table.from_arrays(out, ["doc_id", "piece", "first_token", "n_tokens", "bin_id", "bin_length", "bin_offset", "bin_tokens"])
        yield from table.to_batches(100_000)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col("text").cast("string").alias("text"))
    sizes = written(rows.mapInArrow(textnum.lean(measure), "doc_id bigint, row bigint, tokens bigint"), "sizes")
    pieces = sizes.agg(F.sum(F.ceil(F.col("tokens") / most))).first()[0] or 0
    return sizes.repartition(max(1, -(-int(pieces) // block_pieces)), F.xxhash64("row")).mapInArrow(textnum.lean(run), SCHEMA)
