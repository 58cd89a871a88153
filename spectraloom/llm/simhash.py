"""Operator 4: near-duplicates by SimHash under a Gray-order hierarchical index.

A text's fingerprint has a bit set where over half of its word shingles' XXH64 have it. Fingerprints
link at ``distance`` or fewer differing bits. Distinct fingerprints are sorted by Gray rank, in which
neighbours share most bits, and range-partitioned. Over each range stands an index: leaves of neighbours and the nodes
above them keep the bits that all below share (a mask and their pattern). Ranges are joined with themselves from the top
down: a pair of nodes whose shared patterns already differ in more than ``distance`` bits is left out with all below it, and so is a
pair of groups that links have joined before. The index gives the links of a spanning forest,
which keeps components whole without listing all pairs of a cluster.

So that no range needs to meet another, fingerprints are sorted ``distance + 1`` times, each time turned so that another
block of their bits leads. Of linked fingerprints at least one block is equal, so in that order they stand in one run of equal leading bits,
which is never cut; nodes whose leading bits differ are left out at once.

Scale: texts are read once; 12 bytes a fingerprint times four move, after equal fingerprints are
folded by partial aggregation (copies cost one row). A task holds ``HELD`` fingerprints, or one run of 16 equal leading bits if that
is longer (N / 65,536 on average), and their node pairs are worked off in portions.

Cases: null counts as empty; no words: fingerprint zero, which links like any other; null doc_ids are
kept and belong to their fingerprint's component (a component of null ids alone has id null); repeated
rows give repeated rows; an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jaccard, scratch, words
from .components import components

SEED = 42


def _hashes(text: bytes, shingle: int, hashed) -> list[int]:
    found = text.lower().split()  # of bytes: A-Z, and white space is \x20\x09-\x0D
    if not found:
        return []
    line = b" ".join(found)
    if len(found) <= shingle:
        return [hashed(line, SEED)]
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = [0, *(ends[: len(found) - shingle] + 1).tolist()]
    return [hashed(line[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]


def majority(held: list[np.ndarray]) -> np.ndarray:
    """The fingerprint of each list of hashes; zero of an empty one."""
    out = np.zeros(len(held), np.uint64)
    size = np.fromiter(map(len, held), np.int64, len(held))
    some = np.flatnonzero(size)
    portion = np.cumsum(size[some]) // 100_000  # lists that are counted at once
    for at in np.split(some, np.flatnonzero(np.diff(portion)) + 1) if len(some) else []:
        bits = np.unpackbits(np.concatenate([held[i] for i in at]).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count = np.add.reduceat(bits, np.cumsum(size[at]) - size[at], axis=0, dtype=np.int32)
        out[at] = np.packbits(count * 2 > size[at][:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints_of(texts: list[bytes], shingle: int = 3) -> np.ndarray:
    """64-bit fingerprints of texts in UTF-8."""
    from xxhash import xxh64_intdigest

    return majority([np.array(_hashes(text, shingle, xxh64_intdigest), np.uint64) for text in texts])


def _fingerprints(shingle: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, "text"):
            texts = pc.fill_null(batch.column("text"), "").cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fingerprints_of(texts, shingle).view(np.int64))], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) for every row."""
    scratch.small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_fingerprints(shingle), "doc_id long, fp long")


def gray_rank(fp):
    """The place of a bit pattern in reflected Gray order, as a column that sorts as unsigned."""
    for k in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, k))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


def turns(distance: int) -> tuple[list[int], int]:
    """How far to turn a fingerprint to the left so that each of ``distance + 1`` blocks leads, and the bits that lead."""
    blocks = distance + 1
    return [(64 - round(64 * (i + 1) / blocks)) % 64 for i in range(blocks)], 64 // blocks


def turned(fp, by: int):
    """A column of 64-bit patterns turned to the left."""
    return F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, 64 - by)) if by else fp


LEAF, FAN, PORTION, HELD = 16, 8, 1 << 20, 1 << 17


class GrayIndex:
    """Fingerprints in Gray order, with the shared bits of each leaf and of the nodes above.

    A node's mask holds the bits of those above it as well, so the differing bits of a pair of nodes are what has been
    accumulated on the way down. ``lead`` bits are the leading ones: groups that differ in them are left out.
    """

    def __init__(self, ordered: np.ndarray, lead: int = 0):
        self.points = ordered
        self.lead = np.uint64(((1 << lead) - 1) << (64 - lead))
        self.pruned, self.tested = 0, 0  # pairs of nodes left out with all below them, pairs of points compared
        mask, value, self.levels = np.full(len(ordered), ~np.uint64(0)), ordered, []
        size = LEAF
        while True:
            begin = np.arange(0, len(value), size)
            low, high = np.bitwise_and.reduceat(value & mask, begin), np.bitwise_or.reduceat(value | ~mask, begin)
            mask = ~(low ^ high)  # the bits in which all below agree
            value = low
            self.levels.append((mask, value & mask))
            if len(begin) == 1:
                break
            size = FAN

    def _children(self, a: np.ndarray, b: np.ndarray, fan: int, count: int) -> tuple[np.ndarray, np.ndarray]:
        x, y = (a[:, None] * fan + np.arange(fan)), (b[:, None] * fan + np.arange(fan))
        x, y = np.repeat(x, fan, axis=1).ravel(), np.tile(y, (1, fan)).ravel()
        ok = (x <= y) & (y < count)
        return x[ok], y[ok]

    def forest(self, distance: int, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places (in the order given) of links that join every component of points within ``distance``.

        ``label`` is each point's component so far, by its least place; it is brought up to date.
        """
        found: list[tuple[np.ndarray, np.ndarray]] = []
        top = len(self.levels) - 1
        stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, a, b = stack.pop()
            if len(a) > (most := max(1, PORTION // (LEAF * LEAF if level == 0 else FAN * FAN))):
                stack += [(level, a[i : i + most], b[i : i + most]) for i in range(0, len(a), most)]
                continue
            mask, value = self.levels[level]
            differ = (value[a] ^ value[b]) & mask[a] & mask[b]
            near = (np.bitwise_count(differ) <= distance) & (differ & self.lead == 0)
            self.pruned += len(a) - int(near.sum())
            a, b = a[near], b[near]
            if not len(a):
                continue
            if level:
                stack.append((level - 1, *self._children(a, b, FAN, len(self.levels[level - 1][0]))))
                continue
            # A pair of leaves whose points are all in one component can add nothing.
            begin = np.arange(0, len(label), LEAF)
            low, high = np.minimum.reduceat(label, begin), np.maximum.reduceat(label, begin)
            open_ = ~((low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b]))
            x, y = self._children(a[open_], b[open_], LEAF, len(self.points))
            ok = (x < y) & (label[x] != label[y])
            x, y = x[ok], y[ok]
            self.tested += len(x)
            ok = np.bitwise_count(self.points[x] ^ self.points[y]) <= distance
            found += _join(label, x[ok], y[ok])
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _join(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Join the components of x and y in ``label`` (each point's least one); the links that did it."""
    used = []
    while len(x):
        p, q = label[x], label[y]
        on = p != q
        x, y, p, q = x[on], y[on], p[on], q[on]
        if not len(x):
            break
        low, high = np.minimum(p, q), np.maximum(p, q)
        order = np.lexsort((low, high))
        first = order[np.concatenate([[True], high[order][1:] != high[order][:-1]])]  # one link for each component that gives way
        used.append((x[first], y[first]))
        parent = np.arange(len(label))
        parent[high[first]] = low[first]
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        label[:] = parent[label]
    return used


def _range_links(distance: int):
    """Links of a spanning forest of each run of equal leading bits; rows come by turn and Gray rank."""
    by, lead = turns(distance)

    def links(turn: np.ndarray, points: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        edge = np.flatnonzero(np.concatenate([[True], turn[1:] != turn[:-1], [True]])).tolist()
        for a, b in zip(edge, edge[1:], strict=False):
            x, y = GrayIndex(points[a:b], lead).forest(distance, np.arange(b - a))
            yield pa.RecordBatch.from_arrays([pa.array(ids[a + x]), pa.array(ids[a + y])], names=["u", "v"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        waiting = 0
        for batch in batches:
            held.append([batch.column(x).to_numpy() for x in ("turn", "turned", "id")])
            waiting += batch.num_rows
            if waiting < HELD:
                continue
            turn, points, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            leading = points.view(np.uint64) >> np.uint64(64 - lead)
            same = (turn == turn[-1]) & (leading == leading[-1])
            last = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0  # the run that isn't over begins here
            held, waiting = [[turn[last:], points[last:], ids[last:]]], len(turn) - last
            if last:
                yield from links(turn[:last], points[:last].view(np.uint64), ids[:last])
        if waiting:
            turn, points, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            yield from links(turn, points.view(np.uint64), ids)

    return run


def links(points: DataFrame, distance: int = 3) -> DataFrame:
    """u, v: links of ids that join all of ``points`` (id, fp; fp each once) within ``distance`` bits, directly or through others."""
    by, lead = turns(distance)
    dealt = points.select("id", F.posexplode(F.array(*(turned(F.col("fp"), k) for k in by))).alias("turn", "turned"))
    dealt = dealt.withColumn("rank", gray_rank(F.col("turned")))
    ranged = dealt.repartitionByRange("turn", F.shiftright("rank", 64 - lead)).sortWithinPartitions("turn", "rank")
    return ranged.select("turn", "turned", "id").mapInArrow(_range_links(distance), "u long, v long")


def classes(docs: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable through links) for every row."""
    prints = scratch.written(fingerprints(docs, shingle))
    distinct = scratch.written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    node = components(links(distinct.select(F.col("fp").alias("id"), "fp"), distance))
    linked = distinct.join(node, distinct.fp == node.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    of = linked.join(least, "component").select(F.col("fp").alias("fp_"), "component_id")
    return prints.join(of, prints.fp == of.fp_).select("doc_id", "fp", "component_id")


def hexed(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


#: Near duplicates in a corpus: shingles of five words, similarity 0.8.
NEAR_SHINGLE, SIMILARITY = 5, 0.8


def _nearest(points: DataFrame, distance: int = 3) -> DataFrame:
    """u, v: ids of ``points`` (id, fp) that join all whose fingerprints are equal or link."""
    first = points.groupBy("fp").agg(F.min("id").alias("first"))
    same = points.join(first, "fp").where("id <> first").select(F.col("id").alias("u"), F.col("first").alias("v"))
    return same.unionByName(links(first.select(F.col("first").alias("id"), "fp"), distance))


def near_classes(docs: DataFrame, shingle: int = NEAR_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, component_id of every row, linked where the Jaccard similarity of the shingle sets is ``similarity`` or more.

    The Gray-order index finds the closest copies, whose shingle sets are then compared. Copies at 0.8 differ in too many of
    64 bits for fingerprints to find them all, so what is not in one group yet goes through an exact join of the sets.
    """
    return jaccard.classes(docs, shingle, similarity, _hashes, majority, _nearest)


def deduplicated(docs: DataFrame, shingle: int = NEAR_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its group of near duplicates, whole and unchanged.

    Rows that share a doc_id stay or go together; rows without one stay.
    """
    inner = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    own = f"c{docs.columns.index('doc_id')}"
    found = near_classes(docs, shingle, similarity)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct()
    return inner.join(gone, F.col(own) == F.col("gone"), "left_anti").toDF(*docs.columns)
