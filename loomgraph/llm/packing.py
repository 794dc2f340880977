"""Best-fit packing of tokenized documents into sequences, with certified bounds.

Texts are tokenized where they are read; what is shuffled afterwards is one narrow
row a piece.  Full pieces are sequences of their own.  The others are dealt to
partitions of about `items` pieces.  Each partition packs its pieces by best-fit
decreasing and computes lower bounds on its number of bins from dual feasible
functions over the histogram of lengths.  Where both agree the partition is
certified: no packing of its pieces is better.  Where a gap is left, the worst bins
are opened and their documents exchanged: all partitions' opened bins are dealt
again to half as many partitions, which rerun best-fit decreasing.  A certified
partition opens its emptiest bin only, because a bin that is partly empty in each
partition is what bounds of single partitions can't see.  The last partition exchanges
documents with its own: its worst bins and more and more of the others, chosen by a seed,
are opened and packed again, as long as its gap lasts, `tries` times at most.  The bins
and the bound of each partition are returned with its pieces.

The work a round hands on is a few bins a partition, so it shrinks by orders of
magnitude at once; a round's result is a written table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import own_names, written
from loomgraph.llm.token_fst import machine, text_blocks
from loomgraph.session import ship


@dataclass(frozen=True)
class Packing:
    """capacity: tokens a sequence. items: pieces a partition, about. opened: bins that a gap of
    one bin opens. tries: of the last partition's exchange with itself."""

    capacity: int = 1024
    items: int = 50_000
    opened: int = 4
    tries: int = 24


def tokenized(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of each document: id, piece, start, length, ids (binary: little-endian
    unsigned 32-bit ids).

    A document is its text's ids, then end_id; null is an empty text, so it is one piece
    of length 1. Longer ones than capacity are cut into pieces of capacity, the first of
    which may be shorter. Repeated rows give repeated pieces. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(tokenizer_path)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            keys, at = batch.column(0), 0
            for block in text_blocks(batch.column(1)):
                rows, piece, start, length, out = [], [], [], [], []
                for k, ids in enumerate(m.ids(block), at):
                    ids = np.append(ids, end).astype("<u4")
                    n = len(ids)
                    cuts = [0, *range(n % capacity or min(n, capacity), n + 1, capacity)]
                    for p in range(len(cuts) - 1):
                        rows.append(k)
                        piece.append(p)
                        start.append(cuts[p])
                        length.append(cuts[p + 1] - cuts[p])
                        out.append(ids[cuts[p] : cuts[p + 1]].tobytes())
                at += len(block)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(out, pa.binary())], names=[id_col, "piece", "start", "length", "ids"])

    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids binary")


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the best of the dual feasible functions U (large
    lengths round up to the capacity, small ones to nothing) and u_k (lengths round down
    to k-ths), over the histogram of lengths."""
    if not len(lengths):
        return 0
    h = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    n, s = np.concatenate([[0], np.cumsum(h)]), np.concatenate([[0], np.cumsum(h * x)])
    best = -(-int(s[-1]) // capacity)
    small = np.arange(capacity // 2 + 1)
    large = n[-1] - n[capacity - small + 1]
    middle = s[capacity - small + 1] - s[small]
    best = max(best, int((large - (-middle // capacity)).max()))
    for k in range(1, 65):
        y = np.where((k + 1) * x % capacity == 0, k * x, (k + 1) * x // capacity * capacity)
        best = max(best, -(-int((h * y).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece, the longest first."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    bins[order], offsets[order] = _best_fit(lengths[order], capacity)
    return bins, offsets


def _best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece. Each in turn goes to the fullest bin that has room; bins are
    found by their room in one step."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, fresh = 0, 0
    for i, n in enumerate(lengths.tolist()):
        fitting = mask >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                mask ^= 1 << room
        else:
            b, room, fresh = fresh, capacity, fresh + 1
        bins[i], offsets[i] = b, capacity - room
        room -= n
        if room:
            by_room[room].append(b)
            mask |= 1 << room
    return bins, offsets


def repacked(lengths: np.ndarray, bins: np.ndarray, capacity: int, bound: int, tries: int) -> np.ndarray:
    """The bin of each piece, in fewer bins than `bins` if that is found: of a packing with a gap
    the emptiest bins and some others are opened, and their pieces packed again by best-fit
    decreasing, with the pieces of equal or near lengths in another order."""
    r = np.random.default_rng(len(lengths))
    for turn in range(tries):
        n = int(bins.max(initial=-1)) + 1
        if n <= bound:
            break
        used = np.bincount(bins, weights=lengths, minlength=n)
        worst = np.argsort(used, kind="stable")[: 4 * (n - bound) * (1 + turn % 6)]
        others = r.choice(n, min(n, 8 << turn % 6), replace=False)
        chosen = np.zeros(n, bool)
        chosen[worst] = chosen[others] = True
        at = np.flatnonzero(chosen[bins])
        nudged = lengths[at] + r.integers(0, 1 + capacity // 64 * (turn % 4), len(at)) if turn % 4 else lengths[at]
        order = at[np.argsort(-nudged, kind="stable")]
        again = _best_fit(lengths[order], capacity)[0]
        if again.max(initial=-1) + 1 <= chosen.sum():  # no more bins than before: even a tie moves pieces
            keep = np.cumsum(~chosen) - 1
            bins = np.where(chosen[bins], 0, keep[bins])
            bins[order] = again + int((~chosen).sum())
    return bins


def _offsets(lengths: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """The place of each piece in its bin, gapless from 0."""
    order = np.argsort(bins, kind="stable")
    before = np.cumsum(lengths[order]) - lengths[order]
    first = np.concatenate([[True], np.diff(bins[order]) != 0]) if len(order) else np.zeros(0, bool)
    out = np.empty(len(lengths), np.int64)
    out[order] = before - np.repeat(before[first], np.diff(np.flatnonzero(first), append=len(order)))
    return out


def _pack_partition(pdf: pd.DataFrame, how: Packing, alone: bool) -> pd.DataFrame:
    """The partition's packing; columns bin, offset, closed, part_bins and part_bound."""
    lengths = pdf["length"].to_numpy()
    bins, offsets = best_fit_decreasing(lengths, how.capacity)
    bound = lower_bound(lengths, how.capacity)
    if alone and bins.max(initial=-1) + 1 > bound:
        bins = repacked(lengths, bins, how.capacity, bound, how.tries)
        offsets = _offsets(lengths, bins)
    used = np.bincount(bins, weights=lengths).astype(np.int64)
    gap = len(used) - bound
    closed = np.ones(len(used), bool)
    if not alone:
        worst = np.argsort(used, kind="stable")[: 1 + how.opened * gap]
        closed[worst[used[worst] < how.capacity]] = False
    return pdf.assign(bin=bins, offset=offsets, closed=closed[bins], part_bins=len(used), part_bound=bound)


def pack(pieces: DataFrame, how: Packing = Packing()) -> DataFrame:
    """pieces with sequence_id, offset, part_bins and part_bound: how many sequences the
    partition that packed the piece made, and the least that any packing of its pieces needs
    (for a full piece 1 and 1). pieces: a column length (1 to capacity) and any others, which are
    carried along; where they have a name of an added one, that is lengthened by underscores.

    Every row is placed, repeated ones too; sequences are gapless from offset 0. Which of
    equally long pieces goes where is arbitrary but, once written, stays. An empty table
    gives no rows.
    """
    ship(pieces.sparkSession)
    names = [*pieces.columns, *own_names(pieces, "sequence_id", "offset", "part_bins", "part_bound")]
    # within, columns that are only carried have plain names
    pieces = pieces.toDF(*[c if c == "length" else f"column_{k}" for k, c in enumerate(pieces.columns)])
    schema = pieces.schema
    full = pieces.where(F.col("length") == how.capacity)
    done = [full.select("*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(1).cast("long").alias("part_bins"), F.lit(1).cast("long").alias("part_bound"))]
    todo = pieces.where(F.col("length") < how.capacity)
    n = todo.count()
    parts = max(1, math.ceil(n / how.items))
    for turn in count(1):
        if not n:
            break

        def run(frames: Iterator[pd.DataFrame], turn: int = turn, alone: bool = parts == 1) -> Iterator[pd.DataFrame]:
            got = [f for f in frames if len(f)]
            if got:
                out = _pack_partition(pd.concat(got, ignore_index=True), how, alone)
                part = TaskContext.get().partitionId()
                out["sequence_id"] = (turn << 56) + (part << 28) + out.pop("bin")
                yield out

        # dealt by row number too, so that equal rows don't meet in one partition
        dealt = todo.repartition(parts, F.xxhash64(F.monotonically_increasing_id(), F.col("length"), F.lit(turn)))
        out = written(dealt.mapInPandas(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in schema)}, offset long, closed boolean, part_bins long, part_bound long, sequence_id long"), "packed")
        done.append(out.where("closed").select(*[F.col(f"`{c}`") for c in schema.names], "sequence_id", "offset", "part_bins", "part_bound"))
        if parts == 1:
            break
        todo = out.where("not closed").select(*[F.col(f"`{c}`") for c in schema.names])
        n = todo.count()
        parts = max(1, min(math.ceil(n / how.items), parts // 2))
    result = done[0]
    for d in done[1:]:
        result = result.unionByName(d)
    return result.toDF(*names)
