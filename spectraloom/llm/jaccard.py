"""Texts whose sets of word shingles are alike: an exact set-similarity join that gives components.

Two texts link where the Jaccard similarity of their shingle sets (XXH64) is at least ``similarity``. Shingles have
one order for all texts, rarest first: those that are frequent in a sample of texts come last, the others by their hash. Texts that
link share a shingle among the first ``n - ceil(similarity n) + 1`` of both (prefix filter), so they meet in the bucket of one.
Of buckets that hold the same texts only the one of the first shingle stays, as pairs that meet in one of them meet in it no later.
The order decides about speed only; any order finds all links. In a bucket a pair is left out if its sizes (length filter), the places of the
shingle (positional filter) or 256 parity bits (two sets differ in at least as many shingles as bits) rule the similarity out; what is
left is compared by parity bits in proportion to the set (4 a shingle), and then exactly by whole sets. None of the filters loses a link.

Links are looked for in rounds, each among texts that no round before has brought into one component; others can add nothing.
First come pairs that the caller proposes (near fingerprints). Then, in each of ``CHAINS`` rounds, a bucket's texts stand in an order of
its own and each is compared with the next: in its buckets a text of a cluster meets several others of it, at a cost linear
in the cluster. Last, all pairs are tried whose texts are still apart.

Scale: the sets are written once (8 bytes a shingle, about 1.2 x the texts); about a fifth of the shingles move with 12 further bytes, then only those
that several texts share. For pairs that no filter rules out the parity bits move (half a byte a shingle), and for those that these leave the whole sets. A cluster costs its size, but texts
that are nearly as alike as ``similarity``, and are not linked by others, are compared pair by pair.

Cases: equal sets are one node; texts without words have the empty set, so all of them are one node.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, words
from .components import components

#: Texts whose shingles are counted, shingles that come last at most, and rows of ids to broadcast at most. None of them changes a result.
SAMPLE, FREQUENT, MOST_BROADCAST = 20_000, 100_000, 2_000_000
SEEN, PORTION = 1_000_000, 200_000
SLICE_BYTES = 4 << 20  # of text whose sets are made at once; shingles and parity bits take many times that
MARKS = ("b0", "b1", "b2", "b3")
CHAINS = 2


def _flat(sets: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the sets, and their hashes end to end."""
    size = pc.binary_length(sets).to_numpy(zero_copy_only=False).astype(np.int64) // 8
    return np.concatenate([[0], np.cumsum(size)]), np.frombuffer(b"".join(sets.to_pylist()), "<u8")


def _sets(shingle: int, hashes: Callable, fingerprint: Callable):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in words.slices(batches, "text", SLICE_BYTES):
            texts = pc.fill_null(batch.column("text"), "").cast(pa.binary()).to_pylist()
            sets = [np.unique(np.array(hashes(t, shingle, xxh64_intdigest), "<u8")) for t in texts]
            fps = fingerprint(sets).view(np.int64)
            sigs = pa.array([signature(x) for x in sets], pa.binary())
            sets = [x.tobytes() for x in sets]
            ids = np.array([xxh64_intdigest(s) for s in sets], np.uint64).view(np.int64)
            sets = pa.array(sets, pa.binary())
            size = pc.binary_length(sets).to_numpy().astype(np.int32) // 8
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids), sets, sigs, pa.array(size), pa.array(fps), *(pa.array(np.ascontiguousarray(x)) for x in marks(sets).T)], names=["doc_id", "id", "set", "sig", "n", "fp", *MARKS])
        pa.default_memory_pool().release_unused()  # else the worker keeps it through the stages that follow

    return run


def _hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(_flat(batch.column("set"))[1].view(np.int64))], names=["hash"])


def frequent(sets: DataFrame, sample: int = SAMPLE, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, in order, that several texts of a sample hold, and how many do."""
    every = max(1, math.ceil(sets.count() / sample))
    counts = sets.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).select("set").mapInArrow(_hashed, "hash long").groupBy("hash").count()
    found = counts.where("count >= 3").orderBy(F.col("count").desc(), "hash").limit(most).toArrow()
    hashes, count = found.column("hash").to_numpy().view(np.uint64), found.column("count").to_numpy()
    order = np.argsort(hashes)
    return hashes[order], count[order]


def _needed(size: int, similarity: float) -> int:
    return math.ceil(similarity * size - 1e-9)


def _prefixes(similarity: float, common: tuple[np.ndarray, np.ndarray]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count = common
        seen: set[int] = set()  # equal sets of a task go once
        for batch in batches:
            at, flat = _flat(batch.column("set"))
            last = np.zeros(len(flat), np.int64)
            if len(known) and len(flat):
                place = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                last = np.where(known[place] == flat, count[place], 0)
            hashes, ids = [flat[:0]], []
            for i, id_ in enumerate(batch.column("id").to_pylist()):
                a, b = int(at[i]), int(at[i + 1])
                if a == b or id_ in seen:
                    continue
                seen.add(id_)
                own = flat[a:b]
                if last[a:b].any():
                    own = own[np.argsort(last[a:b], kind="stable")]
                hashes.append(own[: b - a - _needed(b - a, similarity) + 1])
                ids.append(id_)
            if len(seen) > SEEN:
                seen.clear()
            size = np.array([len(x) for x in hashes[1:]], np.int64)
            places = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            ids = np.repeat(np.array(ids, np.int64), size)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes).view(np.int64)), pa.array(ids), pa.array(places.astype(np.int32))], names=["hash", "id", "place"])

    return run


def _buckets(batches: Iterable[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Whole buckets (rows of one hash, which is the first column): where they begin, and the columns."""
    held: list[list[np.ndarray]] = []

    def closed(whole: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        return np.flatnonzero(np.concatenate([[True], whole[0][1:] != whole[0][:-1]])), whole

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([batch.column(x).to_numpy() for x in names])
        if held[0][0][0] == held[-1][0][-1]:
            continue
        whole = [np.concatenate(x) for x in zip(*held, strict=True)]
        last = int(np.searchsorted(whole[0], whole[0][-1]))
        yield closed([x[:last] for x in whole])
        held = [[x[last:] for x in whole]]
    if held:
        yield closed([np.concatenate(x) for x in zip(*held, strict=True)])


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of ids (the finaliser of SplitMix64), whose sum stands for a set of them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of hashes that several ids have, each id once; ``texts`` stands for a bucket's ids and is told in its first row."""
    for _, (hashes, ids, places) in _buckets(batches, ("hash", "id", "place")):
        once = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (ids[1:] != ids[:-1])])
        hashes, ids, places = hashes[once], ids[once], places[once]
        same = hashes[1:] == hashes[:-1]
        several = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        hashes, ids, places = hashes[several], ids[several], places[several]
        begin = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
        sums = np.zeros(len(hashes), np.uint64)
        sums[begin] = np.add.reduceat(_mixed(ids.view(np.uint64)), begin) if len(begin) else 0
        head = np.ones(len(hashes), bool)
        head[begin] = False
        yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in (hashes, ids, places)), pa.array(sums.view(np.int64), mask=head)], names=["hash", "id", "place", "texts"])


def marks(sets: pa.Array) -> np.ndarray:
    """A row of 256 bits for each set: the parity of its hashes' counts at each of 256 values."""
    at, flat = _flat(sets)
    owner = np.repeat(np.arange(len(sets)), np.diff(at))
    count = np.bincount(owner * 256 + (flat >> np.uint64(56)).astype(np.int64), minlength=256 * len(sets)).reshape(-1, 256)
    return np.packbits((count & 1).astype(np.uint8), axis=1, bitorder="little").view("<i8")


def signature(hashes: np.ndarray) -> bytes:
    """Parity bits of a set of hashes, at least 4 a hash; their number is a power of two from 256 on."""
    size = 1 << max(8, (4 * len(hashes) - 1).bit_length())
    count = np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return np.packbits((count & 1).astype(np.uint8), bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """In at least how many hashes two sets differ, by their signatures; the longer one is folded to the shorter's length."""
    a, b = sorted((np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")), key=len)
    return int(np.bitwise_count(a ^ np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)).sum())


def _candidates(similarity: float, every: bool):
    """u, v of two components in each bucket that no filter rules out: texts that follow each other, or with ``every`` all pairs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for begin, (hashes, ids, places, n, component, *bits) in _buckets(batches, ("hash", "id", "place", "n", "component", *MARKS)):
            size = np.diff(np.append(begin, len(ids)))
            end = np.repeat(begin + size, size)
            n, places = n.astype(np.int64), places.astype(np.int64)
            if every:  # in the order of components: partners begin where the own one ends
                run_at = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (component[1:] != component[:-1])]))
                run_size = np.diff(np.append(run_at, len(ids)))
                first = np.repeat(run_at + run_size, run_size)
            else:
                first = np.arange(len(ids)) + 1
            out, total = [], 0
            i, shift = np.flatnonzero(first < end), 0
            if not every:
                i = i[component[i] != component[i + 1]]
            while len(i):
                j = first[i] + shift
                both = n[i] + n[j]
                needed = np.ceil(similarity / (1 + similarity) * both - 1e-9).astype(np.int64)
                on = (np.minimum(n[i], n[j]) >= needed) & (np.minimum(n[i] - places[i], n[j] - places[j]) >= needed)
                x, y, most = i[on], j[on], (both - 2 * needed)[on]
                on = sum(np.bitwise_count((b[x] ^ b[y]).view(np.uint64)).astype(np.int64) for b in bits) <= most
                u, v = ids[x[on]], ids[y[on]]
                out.append(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1))
                total += len(u)
                if total > PORTION:
                    yield batch_of(out)
                    out, total = [], 0
                shift += 1
                i = i[first[i] + shift < end[i]] if every else i[:0]
            if total:
                yield batch_of(out)

    def batch_of(out: list[np.ndarray]) -> pa.RecordBatch:
        found = np.unique(np.concatenate(out), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in found.T], names=["u", "v"])

    return run


def _kept(test: Callable[[pa.RecordBatch], list[bool]]):
    """The pairs u, v of the rows that pass."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array(test(batch), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(x).filter(keep) for x in ("u", "v")], names=["u", "v"])

    return run


def _perhaps(similarity: float):
    def test(batch: pa.RecordBatch) -> list[bool]:
        both = batch.column("na").to_numpy().astype(np.int64) + batch.column("nb").to_numpy()
        most = both - 2 * np.ceil(similarity / (1 + similarity) * both - 1e-9).astype(np.int64)
        return [least_difference(a, b) <= m for a, b, m in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), most.tolist(), strict=True)]

    return test


def _alike(similarity: float):
    def test(batch: pa.RecordBatch) -> list[bool]:
        keep = []
        for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
            a, b = (np.frombuffer(x.as_buffer(), "<u8") for x in (a, b))
            common = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(common >= similarity * (len(a) + len(b) - common) - 1e-9)
        return keep

    return test


def _beside(pairs: DataFrame, sets: DataFrame, what: str) -> DataFrame:
    """The pairs (u, v) with n and column ``what`` of both sets; only those of ``pairs`` move."""
    ids = scratch.written(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct())
    small = ids.count() <= MOST_BROADCAST
    own = sets.select("id", "n", what).join(F.broadcast(ids) if small else ids, "id", "left_semi").groupBy("id").agg(F.first(F.struct("n", what)).alias("own"))
    a, b = (own.select(F.col("id").alias(x), F.col("own.n").alias(f"n{y}"), F.col(f"own.{what}").alias(y)) for x, y in (("u", "a"), ("v", "b")))
    return pairs.join(a, "u").join(b, "v")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) of ``sets`` (id, n, sig, set) that are alike."""
    pairs = scratch.written(pairs)
    left = scratch.written(_beside(pairs, sets, "sig").mapInArrow(_kept(_perhaps(similarity)), "u long, v long"))
    return _beside(left, sets, "set").mapInArrow(_kept(_alike(similarity)), "u long, v long")


def linked(sets: DataFrame, similarity: float, propose: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """node, component of the ids of ``sets`` (id, set, n, fp and MARKS) that link with others; ``propose`` gives pairs for (id, fp)."""
    prefix = sets.select("id", "set").mapInArrow(_prefixes(similarity, frequent(sets)), "hash long, id long, place int")
    shared = scratch.written(prefix.repartition("hash").sortWithinPartitions("hash", "id").mapInArrow(_shared, "hash long, id long, place int, texts long"))
    # Of the buckets with the same texts (their sum, and the least of them) the one whose shingle comes first.
    first = shared.where("texts is not null").groupBy("texts", "id").agg(F.min_by("hash", F.struct("place", "hash")).alias("hash")).select("hash")
    kept = shared.join(first, "hash", "left_semi").select("hash", "id", "place")
    points = scratch.written(kept.join(sets.select("id", "n", *MARKS).distinct(), "id"))
    node = scratch.written(components(scratch.written(verified(propose(sets.select("id", "fp").distinct()), sets, similarity))))
    for k in range(CHAINS + 1):
        every = k == CHAINS
        rows = points.join(node, F.col("id") == F.col("node"), "left").select(*points.columns, F.coalesce("component", "id").alias("component"))
        order = F.col("component") if every else F.xxhash64("id", "hash", F.lit(k))
        dealt = rows.repartition("hash").sortWithinPartitions("hash", order, "id")
        pairs = dealt.mapInArrow(_candidates(similarity, every), "u long, v long").distinct()
        more = scratch.written(verified(pairs, sets, similarity))
        node = scratch.written(components(node.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more)))
    return node


def classes(docs: DataFrame, shingle: int, similarity: float, hashes: Callable, fingerprint: Callable, propose: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """doc_id, component_id (the smallest doc_id reachable through links) of every row; ``hashes`` gives a text's shingles."""
    scratch.small_batches(docs.sparkSession)
    columns = "doc_id long, id long, set binary, sig binary, n int, fp long, " + ", ".join(f"{b} long" for b in MARKS)
    sets = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_sets(shingle, hashes, fingerprint), columns)
    sets = scratch.written(sets)
    node = linked(sets, similarity, propose)
    nodes = sets.groupBy("id").agg(F.min("doc_id").alias("least"))
    nodes = scratch.written(nodes.join(node, nodes.id == node.node, "left").select("id", "least", F.coalesce("component", "id").alias("component")))
    least = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    of = nodes.join(least, "component").select(F.col("id").alias("id_"), "component_id")
    return sets.select("doc_id", "id").join(of, F.col("id") == F.col("id_")).select("doc_id", "component_id")
