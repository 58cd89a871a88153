"""Operator 3: best-fit packing by swap-based local search.

A document's ids (its text by the tokenizer, then an end id) go into sequences of at most
``capacity`` ids; only longer documents are cut. The pieces are dealt over shards by a hash. A
shard's pieces first stand as they come (next fit, about three quarters full). The search then empties the sparsest sequences
one after another: a piece moves into the tightest gap that takes it; where no gap does, it is exchanged with a
shorter piece, or two of them with a shorter one than both, of the sequence that this fills best. Each step makes the sum of squared fills
larger, so no state comes back and the search ends: at the least possible number of sequences, or when no step is left.
Sequences that a shard leaves below full are searched on together with those of other shards.

Scale: one row of about 50 bytes a piece moves, never the ids. A shard holds about ``shard`` pieces
whatever the input, as the number of shards follows a count of the pieces; a hash deals them, so no
source or group of copies makes a hot shard.

Cases: null and empty texts are documents of the end id alone; repeated rows and doc_ids are packed
each; null doc_ids stay null; an empty table gives no rows; other columns, whatever their names, are not read;
pieces of the same length stand in the order of their rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, tokens

SHARD = 16_384


def next_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indexes as they come: each into the last bin if it has room."""
    bins: list[list[int]] = []
    left = 0
    for i, length in enumerate(lengths):
        if length > left:
            bins.append([])
            left = capacity
        bins[-1].append(i)
        left -= length
    return bins


class Search:
    """The local search over one shard. ``steps`` counts what it did."""

    def __init__(self, bins: list[list[int]], lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.size = np.asarray(lengths, np.int64)
        self.held = [list(items) for items in bins]
        self.where = np.full(len(lengths), -1, np.int64)
        for b, items in enumerate(bins):
            self.where[items] = b
        self.fill = np.array([sum(lengths[i] for i in items) for items in bins], np.int64)
        self.steps: Counter[str] = Counter()
        # Bins by their room, as lists that may hold bins whose room is another by now; bit r of mask: such a list isn't empty.
        self.with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0
        for b in range(len(bins)):
            self._open(b)

    def _open(self, b: int) -> None:
        room = self.capacity - int(self.fill[b])
        if 0 < room < self.capacity:
            self.with_room[room].append(b)
            self.mask |= 1 << room

    def _tightest(self, length: int, but: int) -> int | None:
        """The fullest bin, other than ``but``, that has room for ``length``."""
        fits, base = self.mask >> length, length
        while fits:
            step = (fits & -fits).bit_length() - 1
            room = base + step
            own = self.with_room[room]
            while own and (self.fill[own[-1]] != self.capacity - room or own[-1] == but):
                own.pop()
            if own:
                return own[-1]
            self.mask &= ~(1 << room)
            fits, base = fits >> step + 1, room + 1
        return None

    def _put(self, i: int, b: int) -> None:
        a, length = int(self.where[i]), self.lengths[i]
        self.held[a].remove(i)
        self.held[b].append(i)
        self.fill[a] -= length
        self.fill[b] += length
        self.where[i] = b

    def _move(self, sparse: int) -> bool:
        for i in sorted(self.held[sparse], key=lambda i: -self.lengths[i]):
            b = self._tightest(self.lengths[i], sparse)
            if b is not None and self.fill[b] + self.lengths[i] > self.fill[sparse]:
                self._put(i, b)
                self._open(b)
                self.steps["move"] += 1
                return True
        return False

    def _exchange(self, sparse: int, others: np.ndarray) -> bool:
        """One or two pieces of ``sparse`` for a shorter one of ``others``, so that its bin is filled as far as can be."""
        room = (self.capacity - self.fill)[self.where[others]]
        usable = (room > 0) & (self.where[others] != sparse) & (self.fill[self.where[others]] >= self.fill[sparse])
        others, room = others[usable], room[usable]
        if not len(others):
            return False
        size = self.size[others]
        own = sorted(self.held[sparse], key=lambda i: -self.lengths[i])
        for mine in chain(((i,) for i in own), combinations(own[::-1], 2)):
            gain = sum(self.lengths[i] for i in mine) - size
            left = np.where((gain > 0) & (gain <= room), room - gain, self.capacity)
            k = int(left.argmin())
            if left[k] < self.capacity:
                b = int(self.where[others[k]])
                self._put(int(others[k]), sparse)
                for i in mine:
                    self._put(i, b)
                self._open(b)
                self.steps["one for one" if len(mine) == 1 else "two for one"] += 1
                return True
        return False

    def run(self) -> list[list[int]]:
        least = -(-int(self.size.sum()) // self.capacity)
        alive = sum(map(bool, self.held))
        while alive > least:
            before = self.steps.total()
            order = np.argsort(self.fill, kind="stable")
            order = order[(self.fill[order] > 0) & (self.fill[order] < self.capacity)].tolist()
            others = np.flatnonzero(self.fill[self.where] < self.capacity)
            for sparse in order:
                if alive <= least or not 0 < self.fill[sparse] < self.capacity:
                    continue
                while self.held[sparse] and (self._move(sparse) or self._exchange(sparse, others)):
                    pass
                if self.held[sparse]:
                    self._open(sparse)
                else:
                    alive -= 1
            if self.steps.total() == before:
                break
        return [items for items in self.held if items]


def improve(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Empty sparse bins by moves and exchanges until none helps, or to the least possible number of bins."""
    return Search(bins, lengths, capacity).run()


def pack(lengths: list[int], capacity: int) -> list[list[int]]:
    return improve(next_fit(lengths, capacity), lengths, capacity)


def _pieces(path: str, end_id: int, capacity: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, row = TaskContext.get().partitionId(), 0
        for batch, offsets, ids in tokens.encoded(batches, "text", path, end_id):
            data = memoryview(ids.astype("<u4", copy=False)).cast("B")
            docs, rows, pieces, starts, lengths, crcs = [], [], [], [], [], []
            for k, doc in enumerate(batch.column("doc_id").to_pylist()):
                begin, end = int(offsets[k]), int(offsets[k + 1])
                for piece, at in enumerate(range(begin, end, capacity)):
                    until = min(at + capacity, end)
                    docs.append(doc)
                    rows.append((task << 40) + row)
                    pieces.append(piece)
                    starts.append(at - begin)
                    lengths.append(until - at)
                    crcs.append(zlib.crc32(data[at * 4 : until * 4]))
                row += 1
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(rows, pa.int64()), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "row", "piece", "start", "length", "ids_crc32"])

    return run, "doc_id long, row long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """One row a piece: doc_id, row (a number of the document's row), piece, start, length, ids_crc32."""
    scratch.small_batches(docs.sparkSession)
    run, schema = _pieces(tokenizer, end_id, capacity)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


_PLACED = "doc_id long, row long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, fill long"


def _shard(capacity: int, level: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        # Later levels start from the sequences that the first one left.
        rows = rows.sort_values(["row", "piece"] if level == 0 else ["sequence_id", "offset"], kind="stable").reset_index(drop=True)
        lengths = rows["length"].tolist()
        sequence, offset, fill = (np.zeros(len(rows), np.int64) for _ in range(3))
        for b, items in enumerate(pack(lengths, capacity)):
            at = 0
            for i in items:
                sequence[i], offset[i] = b, at
                at += lengths[i]
            fill[items] = at
        rows["sequence_id"] = (np.int64(level) << 60) + (np.int64(key[0]) << 28) + sequence
        rows["offset"], rows["fill"] = offset, fill
        return rows[[x.split()[0] for x in _PLACED.split(", ")]]

    return run


def place(found: DataFrame, capacity: int = 4096, shard: int = SHARD) -> DataFrame:
    """Sequence and offset of each row of ``pieces`` (a table that is read more than once)."""
    shards = max(1, -(-found.count() // shard))
    first = scratch.written(found.withColumn("shard", F.pmod(F.xxhash64("row", "piece"), F.lit(shards))).groupBy("shard").applyInPandas(_shard(capacity, 0), _PLACED))
    if shards == 1:
        return first
    loose = first.where(F.col("fill") < capacity).drop("fill")
    left = max(1, -(-loose.count() // shard))
    again = loose.withColumn("shard", F.pmod(F.xxhash64("sequence_id"), F.lit(left))).groupBy("shard").applyInPandas(_shard(capacity, 1), _PLACED)
    return first.where(F.col("fill") == capacity).unionByName(again)


def packed(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, shard: int = SHARD) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of ``docs``."""
    found = scratch.written(pieces(docs, tokenizer, end_id, capacity))
    return place(found, capacity, shard).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, shard: int = SHARD) -> DataFrame:
    """sequence_id and ids of every packed sequence; a sequence gathers ``capacity`` ids at most."""
    spark = docs.sparkSession
    scratch.small_batches(spark)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, row = TaskContext.get().partitionId(), 0
        for batch, offsets, ids in tokens.encoded(batches, "text", tokenizer, end_id):
            out = []
            for k, doc in enumerate(batch.column("doc_id").to_pylist()):
                begin, end = int(offsets[k]), int(offsets[k + 1])
                for piece, at in enumerate(range(begin, end, capacity)):
                    part = ids[at : min(at + capacity, end)]
                    out.append((doc, (task << 40) + row, piece, at - begin, len(part), zlib.crc32(part.astype("<u4").tobytes()), part.astype(np.int64)))
                row += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)], names=["doc_id", "row", "piece", "start", "length", "ids_crc32", "ids"])

    whole = scratch.written(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, row long, piece int, start long, length long, ids_crc32 long, ids array<long>"))
    placed = place(whole.drop("ids"), capacity, shard).select("row", "piece", "sequence_id", "offset")
    joined = placed.join(whole.select("row", "piece", "ids"), ["row", "piece"])
    listed = joined.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return listed.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))


def bins_needed(lengths: Iterable[int], capacity: int) -> int:
    """The fewest sequences that could hold so many ids."""
    return -(-sum(lengths) // capacity)
