"""Best-fit packing by sums of squares.

Pieces of documents are placed into sequences of a fixed capacity. Of the open sequences of each residual gap, and a new
one, the piece goes where the squared counts of open sequences per gap then sum to least. Placement looks at lengths alone.

Pieces are dealt by a hash of their row into groups of about `group` pieces, so that no id can fill a group; one task packs
each group, and the pieces of sequences that stay under-filled are dealt anew into fewer groups, until one group is left or a
round fills up fewer than a tenth of what it is given: the waste of many groups is packed away and no task ever sees more than
a group. Longest pieces go first, so that the short ones fill what is left; equal lengths go in the order of arrival, which
changes sequences but neither their number by much nor any piece.

Defined results: a null text is empty; an empty document is its closing id alone; rows that share a doc_id are packed
each by itself; a null doc_id stays null; a text longer than a slice is tokenized by itself and leaves as batches of pieces; an
empty table gives no pieces. Other columns are ignored by `pieces`; `pack` carries any columns, and its own names replace them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, slices
from .tokens import Encoder, tokenizer_path

CAPACITY = 2048
#: Pieces of a group, pieces that leave at once, and groups that a task packs one after the other.
GROUP, BATCH, PER_TASK = 4_000, 16_000, 16
PIECES = "doc_id long, piece int, start long, length long, ids binary"


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """Documents as runs of token ids of at most capacity; ids are little-endian 32-bit."""
    tokenizer = tokenizer or tokenizer_path()

    def task(batches):
        encoder = Encoder.at(tokenizer)
        for batch in batches:
            for run in slices(batch):
                ids, off = encoder.encode(run.column("text"))
                ids = np.insert(ids, off[1:], np.uint32(end_id))
                off = off + np.arange(len(off))
                size = np.diff(off)
                n = -(-size // capacity)
                row = np.repeat(np.arange(len(size)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(size[row] - start, capacity)
                ends = np.concatenate([[0], np.cumsum(length)])
                for lo in range(0, len(row), BATCH):  # so that offsets of a very long text stay within 32 bits
                    hi = min(len(row), lo + BATCH)
                    cut = (4 * (ends[lo : hi + 1] - ends[lo])).astype(np.int32)
                    flat = np.ascontiguousarray(ids[ends[lo] : ends[hi]], "<u4").tobytes()
                    raw = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(cut.tobytes()), pa.py_buffer(flat)])
                    at = slice(lo, hi)
                    yield pa.RecordBatch.from_arrays([run.column("doc_id").take(pa.array(row[at])), pa.array(piece[at], pa.int32()), pa.array(start[at]), pa.array(length[at]), raw], ["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(task, PIECES)


def place(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The sequence of each piece, pieces in the given order, by least sum of squared counts of open sequences per gap."""
    count = np.zeros(capacity + 1, np.int64)  # open sequences by gap
    open_by: list[list[int]] = [[] for _ in range(capacity + 1)]
    out, n = np.zeros(len(lengths), np.int64), 0
    far = np.int64(1) << 40
    for i, s in enumerate(lengths.tolist()):
        if s >= capacity:
            out[i], n = n, n + 1
            continue
        # Taking gap g makes g one fewer and g - s one more (gap 0 is closed and counts nothing): change = 2 * (count[g - s] - count[g]) + 2.
        had, gets = count[s:capacity], count[: capacity - s]
        change = 2 * (gets - had) + 2
        change[0] = 1 - 2 * had[0]
        change[had == 0] = far
        k = int(change.argmin())
        new = 2 * int(count[capacity - s]) + 1
        if change[k] <= new:
            g = s + k
            b = open_by[g].pop()
            count[g] -= 1
        else:
            g, b, n = capacity, n, n + 1
        out[i] = b
        if g > s:
            open_by[g - s].append(b)
            count[g - s] += 1
    return out


def _packer(capacity: int, base: int):
    def task(key: tuple, rows: pa.Table) -> pa.Table:
        lengths = rows.column("length").to_numpy()
        order = np.argsort(-lengths, kind="stable")
        rows, lengths = rows.take(pa.array(order)), lengths[order]
        bins = place(lengths, capacity)
        by = np.argsort(bins, kind="stable")
        lengths, bins = lengths[by], bins[by]
        first = np.concatenate([[True], bins[1:] != bins[:-1]])
        ends = np.cumsum(lengths)
        offset = ends - lengths
        offset = offset - np.maximum.accumulate(np.where(first, offset, 0))
        filled = np.bincount(bins, weights=lengths).astype(np.int64)[bins]
        out = rows.drop_columns(["_group"]).take(pa.array(by))
        ids = base + (np.int64(key[0].as_py()) << 28) + bins
        return out.append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offset)).append_column("filled", pa.array(filled))

    return task


def pack(items: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Pieces (any columns, with `length`) and their place: sequence_id, offset."""
    spark = items.sparkSession
    given = todo = materialize(items.drop("sequence_id", "offset", "filled", "_group"), "pieces")
    n, done, round_ = todo.count(), [], 0
    names = todo.columns
    schema = todo.schema.add("sequence_id", "long").add("offset", "long").add("filled", "long")
    while True:
        groups = max(1, round(n / group))
        tasks = max(min(groups, 2 * spark.sparkContext.defaultParallelism), -(-groups // PER_TASK))
        # The row's own number is in the hash: rows of one id, or of none, are spread like all others.
        deal = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(round_)), F.lit(groups))
        keyed = todo.select(*(F.col(f"`{c}`") for c in names), deal.alias("_group"))
        packed = materialize(keyed.repartition(tasks, "_group").groupBy("_group").applyInArrow(_packer(capacity, round_ << 56), schema), "packed")
        if round_ == 0:
            release(given)
        # A sequence as full as any shortest piece leaves it stays; what is emptier is packed again among its like.
        poor = F.col("filled") < F.lit(capacity - max(4, capacity // 100))
        n_poor = packed.where(poor).count() if groups > 1 else 0
        if n_poor == 0 or 10 * n_poor > 9 * n:
            done.append(packed)
            break
        done.append(packed.where(~poor))
        todo, n, round_ = packed.where(poor).select(*(F.col(f"`{c}`") for c in names)), n_poor, round_ + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("filled")
