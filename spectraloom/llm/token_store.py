"""Operator 2: a content-addressed store of token ids.

Each document's ids (its text by the tokenizer, then an end id) are cut into chunks where a rolling
hash of the last 16 ids is below a limit, so equal passages give equal chunks wherever they
stand. Each distinct chunk is written once under its digest; a document is a recipe, the list of
its digests. A document's root is a Merkle tree over its digests, a part's root one over its documents'
roots and lengths, the store's root one over its parts'. Reading computes digests, roots, counts and
checksums again and fails on the first that differs: a chunk, recipe, part or manifest row that is damaged or missing.

Layout under ``path`` (Parquet through Spark's writers, any file system)::

    objects/kind=chunk    digest, ids (little-endian, 2 bytes an id where the vocabulary allows, else 4)
    objects/kind=recipe   the recipes as first written
    recipes/kind=recipe   part, row, doc_id, start (in its part), n_tokens, digests, root; ascending doc_id
    recipes/kind=part     part, row (documents), n_tokens, root
    manifest              part, base (ids in earlier parts), n_docs, n_tokens, root; part -1 is the store

Scale: texts never move; distinct chunks move once, recipes (16 bytes a chunk) twice. Copies are
dropped in the task that meets them and by partial aggregation before the shuffle, so a hot group
of copies sends a chunk once per task. Reading joins recipes with 28 bytes a chunk, not with ids; a part is
verified in one task, as it was written by one. The driver sees one manifest row a part.

Cases: a null or empty text is a document of the end id alone; null doc_ids sort first; repeated
rows are documents of their own, ties in doc_id stand by digests; an empty table gives empty files and no rows;
other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch, tokens

LEAST, LIMIT, MOST = 128, 256, 2048  # a cut where the hash is below LIMIT of 65,536
DIGEST = 16


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd node moves up as it is."""
    level = [digest(b"\0" + x) for x in leaves] or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"\1" + b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _gear() -> np.ndarray:
    """A fixed pseudo-random 16-bit number for each 16-bit value (a multiply-and-shift mix)."""
    x = (np.arange(1 << 16, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.uint16)


GEAR = _gear()


def rolling(ids: np.ndarray) -> np.ndarray:
    """At each place the sum of the last 16 ids' numbers, each shifted by its age: four doublings."""
    h = GEAR[(ids ^ (ids >> np.uint32(16))) & np.uint32(0xFFFF)]
    for k in (1, 2, 4, 8):
        h[k:] += h[:-k] << np.uint16(k)
    return h


def cuts(ids: np.ndarray, offsets: np.ndarray) -> Iterator[list[int]]:
    """Ends of the chunks of each document. The window never reaches into the document before, as no
    chunk is shorter than ``LEAST`` (the last may be), which is more than the window's 16 ids."""
    marks = np.flatnonzero(rolling(ids) < LIMIT) + 1
    for begin, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        own = marks[np.searchsorted(marks, begin + LEAST) : np.searchsorted(marks, end)].tolist()
        out, at = [], begin
        for mark in own:
            while mark - at > MOST:
                at += MOST
                out.append(at)
            if mark - at >= LEAST:
                out.append(at := mark)
        while end - at > MOST:
            at += MOST
            out.append(at)
        out.append(end)
        yield out


def _stage(path: str, end_id: int, width: int, seen_most: int = 500_000):
    schema = pa.schema([("kind", pa.string()), ("key", pa.binary()), ("doc_id", pa.int64()), ("n", pa.int64()), ("body", pa.binary()), ("root", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, row, seen = TaskContext.get().partitionId(), 0, set()
        for batch, offsets, ids in tokens.encoded(batches, "text", path, end_id):
            data = ids.astype(f"<u{width}").tobytes()
            out: dict[str, list] = {x: [] for x in schema.names}

            def add(*values):
                for name, value in zip(schema.names, values, strict=True):
                    out[name].append(value)

            for k, (doc, ends) in enumerate(zip(batch.column("doc_id").to_pylist(), cuts(ids, offsets), strict=True)):
                at, leaves = int(offsets[k]), []
                for end in ends:
                    body = data[at * width : end * width]
                    leaves.append(key := digest(body))
                    if key not in seen:
                        if len(seen) >= seen_most:
                            seen.clear()
                        seen.add(key)
                        add("chunk", key, None, end - at, body, None)
                    at = end
                add("recipe", task.to_bytes(4, "big") + row.to_bytes(8, "big"), doc, int(offsets[k + 1] - offsets[k]), b"".join(leaves), merkle(leaves))
                row += 1
            yield pa.RecordBatch.from_pydict(out, schema)

    return run, "kind string, key binary, doc_id long, n long, body binary, root binary"


def _leaf(root: bytes, n_tokens: int) -> bytes:
    return root + n_tokens.to_bytes(8, "big")


def _running(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The recipes of a part with their place in it, and last the part's own row."""
    part, row, at, leaves = TaskContext.get().partitionId(), 0, 0, []
    names = ["part", "row", "doc_id", "start", "n_tokens", "digests", "root", "kind"]
    types = [pa.int64()] * 5 + [pa.binary(), pa.binary(), pa.string()]
    for batch in batches:
        n = batch.column("n_tokens").to_numpy(zero_copy_only=False)
        ends = at + np.cumsum(n)
        rows = pa.array(row + np.arange(batch.num_rows))
        parts = pa.array(np.full(batch.num_rows, part, np.int64))
        leaves += map(_leaf, batch.column("root").to_pylist(), n.tolist())
        yield pa.RecordBatch.from_arrays([parts, rows, batch.column("doc_id"), pa.array(ends - n), batch.column("n_tokens"), batch.column("digests"), batch.column("root"), pa.array(["recipe"] * batch.num_rows, pa.string())], names=names)
        row, at = row + batch.num_rows, int(ends[-1]) if len(ends) else at
    if row:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((part, row, None, None, at, None, merkle(leaves), "part"), types, strict=True)], names=names)


def width_of(tokenizer: str, end_id: int) -> int:
    from tokenizers import Tokenizer

    return 2 if max(Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True), end_id) < 1 << 16 else 4


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> None:
    """Encode ``text`` of every row of ``docs`` (doc_id long, text string) and write the store."""
    spark = docs.sparkSession
    scratch.small_batches(spark)
    stage, schema = _stage(tokenizer, end_id, width_of(tokenizer, end_id))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(stage, schema)
    rows.dropDuplicates(["kind", "key"]).write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/objects")
    recipes = _objects(spark, path).where("kind = 'recipe'").select("doc_id", F.col("n").alias("n_tokens"), F.col("body").alias("digests"), "root")
    ordered = recipes.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "digests")
    ordered.mapInArrow(_running, f"{_RECIPES}, kind string").write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/recipes")
    parts = _recipes(spark, path, "part").orderBy("part").collect()  # a row for each task that wrote
    lines, base = [], 0
    for x in parts:
        lines.append((x.part, base, x.row, x.n_tokens, bytes(x.root)))
        base += x.n_tokens
    lines.append((-1, 0, sum(x[2] for x in lines), base, _total(lines)))
    spark.createDataFrame(lines, _MANIFEST).coalesce(1).write.parquet(f"{path}/manifest")


def _total(lines: list[tuple]) -> bytes:
    return merkle([_leaf(x[4], x[3]) for x in lines])


_MANIFEST = "part long, base long, n_docs long, n_tokens long, root binary"
_RECIPES = "part long, row long, doc_id long, start long, n_tokens long, digests binary, root binary"


def _objects(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("key binary, doc_id long, n long, body binary, root binary, kind string").parquet(f"{path}/objects")


def _recipes(spark: SparkSession, path: str, kind: str = "recipe") -> DataFrame:
    return spark.read.schema(f"{_RECIPES}, kind string").parquet(f"{path}/recipes").where(F.col("kind") == kind).drop("kind")


def manifest(spark: SparkSession, path: str) -> list[tuple]:
    """The manifest's rows of parts, held against the store's own row: a row for each task that wrote."""
    rows = [(x.part, x.base, x.n_docs, x.n_tokens, bytes(x.root or b"")) for x in spark.read.schema(_MANIFEST).parquet(f"{path}/manifest").orderBy("part").collect()]
    if not rows or rows[0][0] != -1:
        raise ValueError(f"{path}: the manifest has no row of the store")
    total, parts, base = rows[0], rows[1:], 0
    for part, at, _, n_tokens, _ in parts:
        if at != base:
            raise ValueError(f"{path}: part {part} of the manifest begins at {at}, not at {base}")
        base += n_tokens
    if (total[2], total[3], total[4]) != (sum(x[2] for x in parts), base, _total(parts)):
        raise ValueError(f"{path}: the manifest's parts don't have the root of the store")
    return parts


def _placed(spark: SparkSession, path: str) -> DataFrame:
    base = spark.createDataFrame([x[:2] for x in manifest(spark, path)], "part long, base long")
    return _recipes(spark, path).join(F.broadcast(base), "part").withColumn("start", F.col("start") + F.col("base")).drop("base")


def _listed(recipes: DataFrame) -> DataFrame:
    """One row for each chunk of each document, in recipe order by ``pos``."""
    pieces = F.expr(f"transform(sequence(0, cast(length(digests) / {DIGEST} as int) - 1), i -> substring(digests, i * {DIGEST} + 1, {DIGEST}))")
    return recipes.select("part", "row", "doc_id", "start", "n_tokens", "root", F.posexplode(pieces).alias("pos", "digest"))


def _facts(width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, body in zip(batch.column("key").to_pylist(), batch.column("body").to_pylist(), strict=True):
                if digest(body) != key:
                    raise ValueError(f"chunk {key.hex()} doesn't have its digest")
                ids = np.frombuffer(body, f"<u{width}").astype("<u4")
                out.append((key, len(ids), zlib.crc32(ids.tobytes())))
            keys, sizes, crcs = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())], names=["digest", "size", "crc"])

    return run


def _shift_tables(most: int = 34) -> np.ndarray:
    """Tables that carry a CRC-32 over 2**k zero bytes, for each k and each byte of the CRC."""

    def times(m: np.ndarray, v: int) -> int:
        out, i = 0, 0
        while v:
            if v & 1:
                out ^= int(m[i])
            v, i = v >> 1, i + 1
        return out

    one = [0xEDB88320] + [1 << i for i in range(31)]  # one zero bit, by CRC-32's polynomial
    for _ in range(3):
        one = [times(one, x) for x in one]
    tables = np.zeros((most, 4, 256), np.uint32)
    for k in range(most):
        for byte in range(4):
            tables[k, byte] = [times(one, v << (8 * byte)) for v in range(256)]
        one = [times(one, x) for x in one]
    return tables


def shifted(crc: np.ndarray, zeros: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Each CRC-32 as if as many zero bytes followed; XOR of such gives the CRC of what is joined."""
    crc = crc.astype(np.uint32)
    for k in range(int(zeros.max()).bit_length() if len(zeros) else 0):
        on = np.flatnonzero(zeros >> k & 1)
        c = crc[on]
        crc[on] = tables[k, 0][c & 255] ^ tables[k, 1][c >> 8 & 255] ^ tables[k, 2][c >> 16 & 255] ^ tables[k, 3][c >> 24]
    return crc


def _verified(lines: dict[int, tuple]):
    """Documents put together from their chunks, each part held against its manifest row; rows come by part, row and pos."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _shift_tables()
        part, rows, at, leaves = None, 0, 0, []

        def close() -> None:
            if part is not None and (rows, at, merkle(leaves)) != (lines[part][2], lines[part][3], lines[part][4]):
                raise ValueError(f"part {part} isn't what the manifest says: {rows} documents of {lines[part][2]}, {at} ids of {lines[part][3]}")

        held: list[pa.RecordBatch] = []  # of the document that isn't over
        for batch in chain(batches, [None]):
            if batch is not None:
                if not batch.num_rows:
                    continue
                held.append(batch)
            if not held:
                break
            whole = pa.Table.from_batches(held).combine_chunks()
            own, row = (whole.column(x).to_numpy() for x in ("part", "row"))
            begin = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (row[1:] != row[:-1])]))
            end = len(own) if batch is None else int(begin[-1])
            held = whole.slice(end).to_batches() if end < len(own) else []
            begin = begin[begin < end]
            if not len(begin):
                continue
            whole = whole.slice(0, end)
            if whole.column("size").null_count:
                k = whole.column("size").is_null().to_numpy(zero_copy_only=False).argmax()
                raise ValueError(f"document {whole.column('doc_id')[k]} needs a chunk that isn't there")
            size, crc = (whole.column(x).to_numpy() for x in ("size", "crc"))
            keys = whole.column("digest").to_pylist()
            counts = np.diff(np.append(begin, end))
            ends = np.cumsum(size)
            last = np.repeat(ends[begin + counts - 1], counts)
            sums = np.bitwise_xor.reduceat(shifted(crc, (last - ends) * 4, tables), begin)
            totals = np.add.reduceat(size, begin)
            first = whole.take(pa.array(begin))
            starts = first.column("start").to_numpy().copy()
            of, n_tokens = own[begin].tolist(), first.column("n_tokens").to_pylist()
            for k, root in enumerate(first.column("root").to_pylist()):
                a = int(begin[k])
                if of[k] != part:
                    close()
                    part, rows, at, leaves = of[k], 0, 0, []
                    if part not in lines:
                        raise ValueError(f"part {part} isn't in the manifest")
                if totals[k] != n_tokens[k] or starts[k] != at or row[a] != rows or merkle(keys[a : a + int(counts[k])]) != root:
                    raise ValueError(f"document {first.column('doc_id')[k]} can't be rebuilt from its recipe")
                starts[k] += lines[part][1]
                rows, at = rows + 1, at + n_tokens[k]
                leaves.append(_leaf(root, n_tokens[k]))
            out = [first.column("doc_id").combine_chunks(), pa.array(starts), pa.array(n_tokens, pa.int64()), pa.array(sums.astype(np.int64)), pa.array(counts)]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "n_tokens", "ids_crc32", "n_chunks"])
        close()

    return run


def _width(spark: SparkSession, path: str) -> int:
    first = _objects(spark, path).where("kind = 'chunk'").select((F.length("body") / F.col("n")).cast("int").alias("w")).first()
    return first.w if first else 4


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document doc_id, start, n_tokens, ids_crc32, n_chunks, from the files alone.

    Every stored chunk is hashed again, every document's length, place and Merkle root are compared, every part's
    and the store's; a mismatch fails the job. A document's checksum is put together from those of its chunks.
    """
    lines = {x[0]: x for x in manifest(spark, path)}
    recipes = _recipes(spark, path)
    there = {x.part for x in recipes.select("part").distinct().collect()}  # as many as the manifest has rows
    if lost := sorted(lines.keys() - there):
        raise ValueError(f"{path}: no recipes of the parts {lost}")
    chunks = _objects(spark, path).where("kind = 'chunk'").select("key", "body").mapInArrow(_facts(_width(spark, path)), "digest binary, size long, crc long")
    rows = _listed(recipes).join(chunks, "digest", "left").repartition("part").sortWithinPartitions("part", "row", "pos")
    return rows.mapInArrow(_verified(lines), "doc_id long, start long, n_tokens long, ids_crc32 long, n_chunks long")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Per document doc_id, start and ids, the whole stream rebuilt chunk by chunk."""
    chunks = _objects(spark, path).where("kind = 'chunk'").select(F.col("key").alias("digest"), "body")
    rows = _listed(_placed(spark, path)).join(chunks, "digest")
    docs = rows.groupBy("part", "row", "doc_id", "start").agg(F.sort_array(F.collect_list(F.struct("pos", "body"))).alias("chunks"))
    width = _width(spark, path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b"".join(x["body"] for x in chunks), f"<u{width}").astype(np.int64) for chunks in batch.column("chunks").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "start", "ids"])

    return docs.mapInArrow(run, "doc_id long, start long, ids array<long>")
