"""Best-fit-decreasing packing of tokenised documents into sequences of fixed length.

Documents become ids with an end id behind them. Longer ones than a sequence are cut into whole sequences, a shorter
rest coming first. Pieces are dealt by hash, also of their row, into groups of bounded size; in each group they are placed from the longest
to the shortest, each into the open sequence with the least room that still fits. A segment tree over the remaining
capacities counts the open sequences, so the tightest is found in logarithmic time. A group leaves at most a few
sequences half full among tens of thousands.

Null texts are empty: their only id is the end id. Ids may be null or repeat: each row is packed for itself. Texts are
taken whole; added tokens' strings in a text stand for their ids. An empty table gives an empty one. The result has the
columns named below and no others of the input.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.bpe import Encoder
from furrow.llm.common import row_total
from furrow.session import cut_lineage

CAPACITY = 1024
END_ID = 2
#: Pieces of a group.
GROUP = 65_536


class OpenBins:
    """Counts of open bins by remaining capacity in a segment tree."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()  # the least power of two that has a leaf for `capacity`
        self.tree = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(self.leaves)]

    def add(self, room: int, which: int) -> None:
        self.bins[room].append(which)
        self._count(room, 1)

    def _count(self, room: int, by: int) -> None:
        tree, at = self.tree, room + self.leaves
        while at:
            tree[at] += by
            at >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """Removes a bin of the least room that is `size` or more: (room, bin)."""
        tree, at = self.tree, size + self.leaves
        while not tree[at]:
            # Up to the next subtree on the right.
            while at & 1:
                at >>= 1
            if at <= 1:
                return None
            at += 1
        while at < self.leaves:
            at *= 2
            if not tree[at]:
                at += 1
        room = at - self.leaves
        self._count(room, -1)
        return room, self.bins[room].pop()


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; items in the given order among equals."""
    bins, offsets = np.empty(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    order = np.argsort(-sizes, kind="stable")
    full = int((sizes == capacity).sum())
    bins[order[:full]] = np.arange(full)
    open_bins, made = OpenBins(capacity), full
    for at, size in zip(order[full:].tolist(), sizes[order[full:]].tolist()):
        found = open_bins.take(size)
        room, which = found or (capacity, made)
        made += found is None
        bins[at], offsets[at] = which, capacity - room
        if room > size:
            open_bins.add(room - size, which)
    return bins, offsets


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece."""
    rows = docs.select(F.col(doc_id), F.col(text))
    columns = ("piece", "start", "length", "ids_crc32")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder.load(path)
        for batch in batches:
            owner, made = [], []
            for at, ids in enumerate(coder.encode([t or "" for t in batch.column(1).to_pylist()])):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                first = len(ids) % capacity or capacity
                edges = [0, *range(first, len(ids) + 1, capacity)]
                for piece, (a, b) in enumerate(zip(edges, edges[1:])):
                    owner.append(at)
                    made.append((piece, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            parts = list(zip(*made)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int32())), pa.array(parts[0], pa.int32()),
                                              *(pa.array(p, pa.int64()) for p in parts[1:])], [doc_id, *columns])

    return rows.mapInArrow(run, f"`{doc_id}` {rows.schema[0].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text",
           group: int = GROUP) -> DataFrame:
    """The pieces with `sequence_id` and `offset`: offsets of a sequence run from 0 without gaps."""
    # The row number is written with the pieces, so it stays the same however often they are read.
    made = cut_lineage(pieces(docs, path, capacity, end_id, doc_id, text).withColumn("__row", F.monotonically_increasing_id()))
    groups = max(1, -(-row_total(made) // group))
    dealt = made.withColumn("__group", F.pmod(F.xxhash64(doc_id, "piece", "ids_crc32", "length", "__row"), F.lit(groups))).drop("__row")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(doc_id, "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        which = table.column("__group")[0].as_py()
        bins, offsets = best_fit(table.column("length").to_numpy(), capacity)
        return table.drop_columns(["__group"]).append_column("sequence_id", pa.array(bins * groups + which)).append_column(
            "offset", pa.array(offsets))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.drop("__row").schema)
    return dealt.groupBy("__group").applyInArrow(run, f"{kinds}, sequence_id long, offset long")
