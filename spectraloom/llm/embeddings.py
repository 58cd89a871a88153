"""Operator 7: near-duplicate embeddings by iterative quantisation and multi-index Hamming tables.

A rotation of the principal axes of the unit vectors is learned so that the signs of the rotated vectors lose least (ITQ); the
signs are a code of up to 64 bits. A code is cut into four substrings, each with a table; a vector
stands in a table under its substring and under all that differ from it in one bit, so two vectors whose
substrings differ in at most two bits meet. A pair that meets in several places counts at one of
them only. Pairs whose whole codes differ in at most ``reach`` bits are compared by their original
vectors in double precision; only cosines of at least ``threshold`` link.

Equal vectors (after -0 becomes 0) are folded into one before the search and count in ``n_links`` by their
number. The search is approximate in what it finds (recall is measured in the tests), never in what it
links.

Scale: the rotation is fitted on at most ``sample`` vectors, chosen by a hash; all are indexed. 68 rows of 20
bytes a distinct vector move. A table's buckets hold about N / 65,536 x 17 vectors, so the pair tests grow with N
squared over that; beyond some 10 million distinct vectors use longer substrings (``tables=2``).

A cluster of m distinct near copies has m (m - 1) / 2 links, all of which are verified, but in no one task: a bucket of
more than ``block`` rows is cut into blocks and each pair of blocks is a cell of its own. Classes are dealt to
N / ``block`` parts, and the candidate pairs of a part with another are a tile; a tile's vectors move once for all its pairs (16
bytes each) and it gives one row a vector, its number of links and the least vector of its component there. So a task holds some
2 x ``block`` vectors, and rows grow with vectors and tiles, not with links.

Vectors of each length are a search of their own, with its own rotation; lengths run one after another.

Cases: null, zero-norm or empty vectors, and those with null or non-finite components, link with nothing and are components of their own; null vec_ids stay
(their component has the smallest id reachable, or null); rows that repeat a vec_id are vectors of their own; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .components import components

SAMPLE, REACH, TABLES, THRESHOLD = 20_000, 18, 4, 0.9
#: Share of pairs at the threshold that codes about the mean must find to be used.
ENOUGH = 0.95
#: Most rows of a bucket's block and, on average, classes of a part; candidate pairs handled at once; rows to broadcast. None of them changes a result.
BLOCK, PORTION, MOST_BROADCAST = 2_048, 200_000, 2_000_000


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors that are all there and finite, with norm, and their components end to end."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(offsets)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    some = np.concatenate([[0], np.cumsum(np.nan_to_num(flat, posinf=0, neginf=0) != 0)])
    ok = (size > 0) & (bad[offsets[1:]] == bad[offsets[:-1]]) & (some[offsets[1:]] > some[offsets[:-1]]) & column.is_valid().to_numpy(zero_copy_only=False)
    return np.flatnonzero(ok), size


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, key (a digest of the components, null if the vector can't link), dim, vector (doubles as bytes)."""
    for batch in batches:
        column = batch.column("embedding")
        good, size = _matrix(column)
        keys, vectors = [None] * batch.num_rows, [None] * batch.num_rows
        offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
        for i in good.tolist():
            x = flat[offsets[i] : offsets[i + 1]].astype("<f8") + 0.0
            with np.errstate(over="ignore", under="ignore"):
                norm = float(np.sqrt((x * x).sum()))
            if not np.isfinite(norm) or norm == 0:  # components so large or small that squares leave the range
                x = x / np.abs(x).max()
            vectors[i] = x.tobytes()
            keys[i] = hashlib.blake2b(vectors[i], digest_size=16).digest()
        dims = [int(size[i]) if k else None for i, k in enumerate(keys)]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(keys, pa.binary()), pa.array(dims, pa.int32()), pa.array(vectors, pa.binary())], names=["vec_id", "key", "dim", "vector"])


def _unit(vectors: list[bytes], dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(vectors), "<f8").reshape(-1, dim)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def rotation(x: np.ndarray, bits: int, share: float = 1.0, rounds: int = 50, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Centre (``share`` of the mean) and projection (dims x bits) whose signs are the codes."""
    centre = x.mean(axis=0) * share
    if len(x) < 2:  # no pairs, so any axes will do
        return centre, np.eye(x.shape[1])[:, :bits]
    _, axes = np.linalg.eigh((x - centre).T @ (x - centre) / len(x))
    axes = axes[:, ::-1][:, :bits]
    v = (x - centre) @ axes
    r = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        left, _, right = np.linalg.svd(np.sign(v @ r).T @ v)
        r = (left @ right).T
    return centre, axes @ r


def codes_of(unit: np.ndarray, centre: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """The signs of the rotated vectors as 64 bits."""
    signs = np.zeros((len(unit), 64), np.uint8)
    signs[:, : axes.shape[1]] = (unit - centre) @ axes > 0
    return np.packbits(signs, axis=1, bitorder="little").view("<u8").ravel()


def met(a: np.ndarray, b: np.ndarray, bits: int, reach: int, tables: int) -> np.ndarray:
    """Which pairs of codes the tables and ``reach`` find."""
    near = np.any([np.bitwise_count(_sub(a, part) ^ _sub(b, part)) <= 2 for part in _substrings(bits, tables)], axis=0)
    return near & (np.bitwise_count(a ^ b) <= reach)


def fitted(unit: np.ndarray, bits: int, threshold: float, reach: int, tables: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """The centre and projection for unit vectors: about the mean where that finds ``ENOUGH`` of pairs at the threshold, else nearer to the origin.

    Codes about the mean are balanced, but where most vectors lie on one side (a large cluster, a common part) near copies
    differ from the mean in little but noise. Each sample vector's partner, at just the threshold in a random direction, tells what is found.
    """
    noise = np.random.default_rng(seed).normal(size=unit.shape)
    noise -= (noise * unit).sum(axis=1, keepdims=True) * unit
    noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-300)
    partner = threshold * unit + np.sqrt(max(0.0, 1 - threshold**2)) * noise
    best = (-1.0, None)
    for share in (1.0, 0.5, 0.0):
        model = rotation(unit, bits, share)
        found = met(codes_of(unit, *model), codes_of(partner, *model), bits, reach, tables).mean()
        if found > best[0]:
            best = (found, model)
        if found >= ENOUGH:
            break
    return best[1]


def _substrings(bits: int, tables: int) -> list[tuple[int, int]]:
    edge = [round(bits * i / tables) for i in range(tables + 1)]
    return list(zip(edge, edge[1:], strict=False))


def _sub(code: np.ndarray, part: tuple[int, int]) -> np.ndarray:
    return (code >> np.uint64(part[0])) & np.uint64((1 << (part[1] - part[0])) - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Class numbers spread over 64 bits, to deal them to parts."""
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def _binary(values: np.ndarray, begin: np.ndarray) -> pa.Array:
    """Runs of 8-byte numbers, which begin at ``begin``, as one binary value each."""
    edges = np.append(begin, len(values)).astype(np.int32) * np.int32(8)
    return pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(values))])


def _pairs(bits: int, tables: int, reach: int, parts: int):
    """Candidate pairs by tile (part of u, part of v): one row for all pairs of a tile that are found together."""
    subs = _substrings(bits, tables)

    def tested(table: np.ndarray, key: np.ndarray, cls: np.ndarray, code: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs of places in one bucket those within reach for which it is the one that counts."""
        near = np.bitwise_count(code[i] ^ code[j]) <= reach
        i, j = i[near], j[near]
        before = np.zeros(len(i), bool)
        here = np.zeros(len(i), bool)
        for t, sub in enumerate(subs):
            a, b = _sub(code[i], sub), _sub(code[j], sub)
            d = a ^ b
            meets = np.bitwise_count(d) <= 2
            low = d & (~d + np.uint64(1))
            first = np.where(np.bitwise_count(d) == 2, np.minimum(a ^ low, b ^ low), np.minimum(a, b))
            here |= (table[i] == t) & ~before & (first == key[i])
            before |= meets
        i, j = i[here], j[here]
        return np.minimum(cls[i], cls[j]), np.maximum(cls[i], cls[j])

    def found(table, key, low, high, own, cls, code) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of whole cells; in a cell of two blocks only those of one block with the other."""
        cell = np.concatenate([[True], (table[1:] != table[:-1]) | (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
        run = cell | np.concatenate([[True], own[1:] != own[:-1]])
        ends = lambda new: np.repeat(np.append(np.flatnonzero(new), len(key))[1:], np.diff(np.append(np.flatnonzero(new), len(key))))
        end, place = ends(cell), np.arange(len(key))
        first = np.where(low == high, place + 1, ends(run))
        i, shift = np.flatnonzero(first < end), 0
        while len(i):
            yield tested(table, key, cls, code, i, first[i] + shift)
            shift += 1
            i = i[first[i] + shift < end[i]]

    def tiles(out: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        u, v = (np.concatenate(x) for x in zip(*out, strict=True))
        a, b = ((_mixed(x) % np.uint64(parts)).astype(np.int64) for x in (u, v))
        order = np.lexsort((b, a))
        a, b, u, v = a[order], b[order], u[order], v[order]
        begin = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        return pa.RecordBatch.from_arrays([pa.array(a[begin]), pa.array(b[begin]), _binary(u, begin), _binary(v, begin)], names=["a", "b", "us", "vs"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, total = [], 0
        for rows in _whole(batches, ("table", "key", "low", "high", "own", "cls", "code"), 4):
            rows[1], rows[6] = rows[1].view(np.uint64), rows[6].view(np.uint64)
            for u, v in found(*rows):
                if len(u):
                    out.append((u, v))
                    total += len(u)
                if total > PORTION:
                    yield tiles(out)
                    out, total = [], 0
        if total:
            yield tiles(out)

    return run


def _whole(batches: Iterable[pa.RecordBatch], names: tuple[str, ...], by: int) -> Iterator[list[np.ndarray]]:
    """Columns of sorted rows, cut only where the first ``by`` of them change."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([batch.column(x).to_numpy() for x in names])
        if all(held[0][k][0] == held[-1][k][-1] for k in range(by)):
            continue
        rows = [np.concatenate(x) for x in zip(*held, strict=True)]
        same = np.all([rows[k] == rows[k][-1] for k in range(by)], axis=0)
        last = len(same) - int(np.argmin(same[::-1]))
        yield [x[:last] for x in rows]
        held = [[x[last:] for x in rows]]
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _members(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b, cls: which vectors a tile's pairs need."""
    for batch in batches:
        for a, b, us, vs in zip(*(batch.column(x).to_pylist() for x in ("a", "b", "us", "vs")), strict=True):
            cls = np.unique(np.frombuffer(us + vs, "<i8"))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cls), a)), pa.array(np.full(len(cls), b)), pa.array(cls)], names=["a", "b", "cls"])


def forest(u: np.ndarray, v: np.ndarray, size: int) -> np.ndarray:
    """The least node of each node's component, for links u, v of nodes below ``size``."""
    label = np.arange(size)
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _verified(threshold: float, dim: int):
    """Of each tile: how many vectors each links with (u, others), and a forest of the links (u, v)."""
    portion = max(1, (16 << 20) // (8 * dim))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held, pairs, total = None, [], [], 0
        cls = copies = x = norm = others = label = None

        def opened() -> None:
            nonlocal cls, copies, x, norm, others, label, held
            cls, copies = (np.array(c, np.int64) for c in list(zip(*held, strict=True))[:2])
            x = np.frombuffer(b"".join(h[2] for h in held), "<f8").reshape(len(held), dim)
            order = np.argsort(cls)
            cls, copies, x = cls[order], copies[order], x[order]
            norm = np.sqrt(np.einsum("ij,ij->i", x, x))
            others, label, held = np.zeros(len(cls), np.int64), np.arange(len(cls)), []

        def compared() -> None:
            nonlocal pairs, total, label
            if not total:
                return
            if held:
                opened()
            us, vs = (np.searchsorted(cls, np.concatenate(p)) for p in zip(*pairs, strict=True))
            pairs, total = [], 0
            for at in range(0, len(us), portion):
                u, v = us[at : at + portion], vs[at : at + portion]
                keep = np.einsum("ij,ij->i", x[u], x[v]) / (norm[u] * norm[v]) >= threshold
                u, v = u[keep], v[keep]
                others[:] += np.bincount(u, copies[v], len(cls)).astype(np.int64) + np.bincount(v, copies[u], len(cls)).astype(np.int64)
                own = np.arange(len(cls))
                label = forest(np.concatenate([u, own]), np.concatenate([v, label]), len(cls))

        def closed() -> pa.RecordBatch:
            compared()
            some = others > 0
            return pa.RecordBatch.from_arrays([pa.array(cls[some]), pa.array(cls[label[some]]), pa.array(others[some])], names=["u", "v", "others"])

        for batch in batches:
            for a, b, kind, id_, n, vector, us, vs in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "kind", "cls", "copies", "vector", "us", "vs")), strict=True):
                if (a, b) != tile:
                    if tile is not None:
                        yield closed()
                    tile = (a, b)
                if kind == 0:
                    held.append((id_, n, vector))
                    continue
                pairs.append((np.frombuffer(us, "<i8"), np.frombuffer(vs, "<i8")))
                total += len(pairs[-1][0])
                if total > PORTION:
                    compared()
        if tile is not None:
            yield closed()

    return run


def linked(rows: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE, reach: int = REACH, tables: int = TABLES, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vectors (vec_id, key, dim), classes of equal vectors (cls, key, copies, least), and of classes that link some rows
    u, v, others: ``others`` sums to the number of vectors u links with, and the pairs u, v have the components of the links."""
    spark = rows.sparkSession
    scratch.small_batches(spark)
    vectors = rows.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(_rows, "vec_id long, key binary, dim int, vector binary")
    vectors = scratch.written(vectors)
    classes = vectors.where("key is not null").groupBy("key", "dim").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.first("vector").alias("vector"))
    classes = scratch.written(classes.withColumn("cls", F.monotonically_increasing_id()))
    dims = classes.groupBy("dim").count().where("count > 1").orderBy("dim").collect()  # one vector alone has no pairs
    links = spark.createDataFrame([], "u long, v long, others long")
    for row in dims:
        links = links.unionByName(_links_of(classes.where(F.col("dim") == row.dim), row.dim, row["count"], threshold, sample, reach, tables, block))
    return vectors, classes.select("cls", "key", "copies", "least"), scratch.written(links) if dims else links


def _celled(codes: DataFrame, bits: int, tables: int, block: int) -> DataFrame:
    """Each code in all its buckets; a bucket of more than ``block`` rows is cut into blocks, and each pair of blocks is a cell."""
    around, own = [], []
    for a, b in _substrings(bits, tables):
        own.append(F.shiftrightunsigned("code", a).bitwiseAND(F.lit((1 << (b - a)) - 1)))
        around.append(lambda at, size=b - a: F.array(at, *(at.bitwiseXOR(F.lit(1 << i)) for i in range(size))))
    dealt = codes.select("cls", "code", F.posexplode(F.array(*(near(x) for near, x in zip(around, own, strict=True)))).alias("table", "keys")).select("table", F.explode("keys").alias("key"), "cls", "code")
    # A bucket's size is the sum over the substrings around its key, of which there are far fewer than rows.
    held = codes.select(F.posexplode(F.array(*own)).alias("table", "at")).groupBy("table", "at").count()
    near = F.element_at(F.array(*(f(F.col("at")) for f in around)), F.col("table") + 1)
    size = held.select("table", F.explode(near).alias("key"), "count").groupBy("table", "key").agg(F.sum("count").alias("n"))
    hot = scratch.written(size.where(F.col("n") > block).select("table", "key", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    hot = F.broadcast(hot) if hot.count() <= MOST_BROADCAST else hot
    blocks = F.coalesce("blocks", F.lit(1))
    dealt = dealt.join(hot, ["table", "key"], "left").withColumn("own", F.pmod(F.xxhash64("cls"), blocks).cast("int"))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return other.select("table", "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "cls", "code")


def _links_of(classes: DataFrame, dim: int, count: int, threshold: float, sample: int, reach: int, tables: int, block: int) -> DataFrame:
    """Links (u, v, others) of ``count`` classes whose vectors have ``dim`` components."""
    bits = min(64, dim)
    chosen = classes.select("vector").orderBy(F.xxhash64("key"), "key").limit(sample).toArrow()
    model = fitted(_unit(chosen.column("vector").to_pylist(), dim), bits, threshold, reach, tables)

    def coded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = codes_of(_unit(batch.column("vector").to_pylist(), dim), *model)
            yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array(code.view(np.int64))], names=["cls", "code"])

    codes = scratch.written(classes.select("cls", "vector").mapInArrow(coded, "cls long, code long"))
    dealt = _celled(codes, bits, tables, block).repartition("table", "key", "low", "high").sortWithinPartitions("table", "key", "low", "high", "own")
    parts = -(-count // block)
    pairs = scratch.written(dealt.mapInArrow(_pairs(bits, tables, reach, parts), "a long, b long, us binary, vs binary"))
    members = pairs.mapInArrow(_members, "a long, b long, cls long").distinct().join(classes.select("cls", "copies", "vector"), "cls")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("cls", "long"), ("copies", "long"), ("vector", "binary"))]
    both = members.select("a", "b", F.lit(0).alias("kind"), "cls", "copies", "vector", F.lit(None).cast("binary").alias("us"), F.lit(None).cast("binary").alias("vs"))
    both = both.unionByName(pairs.select("a", "b", F.lit(1).alias("kind"), *none, "us", "vs"))
    return both.repartition("a", "b").sortWithinPartitions("a", "b", "kind").mapInArrow(_verified(threshold, dim), "u long, v long, others long")


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    vectors, classes, links = linked(rows, threshold, **options)
    degree = links.groupBy("u").agg(F.sum("others").alias("others"))
    node = components(links.select("u", "v"))
    found = classes.join(degree, classes.cls == degree.u, "left").join(node, classes.cls == node.node, "left")
    found = found.select(F.col("key").alias("key_"), "least", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "cls").alias("component"))
    found = scratch.written(found)
    least = found.groupBy("component").agg(F.min("least").alias("component_id"))
    of = found.join(least, "component").select("key_", "n_links", "component_id")
    out = vectors.select("vec_id", "key").join(of, F.col("key") == F.col("key_"), "left")
    linking = F.col("key_").isNotNull()
    component = F.when(linking, F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))


#: All pairs by brute force, for tables of whole, non-zero vectors.
SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a
), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT c.a AS vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, c.a = component_id AS kept FROM c LEFT JOIN n USING (a)
"""
