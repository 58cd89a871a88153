"""Operator 5: exact duplicates by content sort.

Two texts are equal when they are the same after every character of ``[\\x20\\x09-\\x0D]`` is deleted.
Rows are range-partitioned by sampled splitters over the start of the normalised bytes, and those that share the
start by their SHA-256; inside a range the whole normalised bytes are sorted externally, and neighbours are compared
byte for byte. Of equal rows the one with the most code points in the original text stays, then the one with the
smallest doc_id. What a row belongs to, it has from the run it stood in.

Scale: the splitters' sample holds 64 bytes and a digest a row, never texts. Before the shuffle each
task folds the equal rows of about 16 MB into one, which lists the members' ids, so a group that holds a third of the table sends a
text once per 16 MB; sorting spills. A text moves once for the membership, and as it is beside its normalised bytes for whole rows. A run is read as a stream; only runs of several such rows
send those rows' ids on, to be joined with what the end of the run has told, in a join whose large keys Spark can split.

Cases: null text counts as empty; all empty and all-white-space texts are one group; null doc_ids
come after all others in ties; rows with the same doc_id and text are a group in which one row is
kept; an empty table gives no rows; other columns are carried by ``deduplicated`` under any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scratch, words

WHITE = b" \t\n\x0b\x0c\r"
START = 64


def normalised(texts: pa.Array) -> list[bytes]:
    return [x.translate(None, WHITE) for x in pc.fill_null(texts, "").cast(pa.binary()).to_pylist()]


def _better(a: tuple, b: tuple) -> bool:
    """a, b: code points, doc_id. True if a stays rather than b."""
    return (-a[0], a[1] is None, a[1] or 0) < (-b[0], b[1] is None, b[1] or 0)


def _ranks(batch: pa.RecordBatch, doc: str, text: str) -> list[tuple]:
    return list(zip(pc.utf8_length(pc.fill_null(batch.column(text), "")).to_pylist(), batch.column(doc).to_pylist(), strict=True))


def _folded(doc: str, text: str):
    """The best row of each group of equal texts in a slice, with the normalised bytes, their start and digest, and the group's size."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, text):
            groups: dict[bytes, list] = {}
            ranks = _ranks(batch, doc, text)
            for i, data in enumerate(normalised(batch.column(text))):
                if (own := groups.get(data)) is None:
                    groups[data] = [i, 1]
                else:
                    own[1] += 1
                    if _better(ranks[i], ranks[own[0]]):
                        own[0] = i
            kept = batch.take(pa.array([i for i, _ in groups.values()], pa.int64()))
            more = [pa.array(list(groups), pa.binary()), pa.array([x[:START] for x in groups], pa.binary()), pa.array([hashlib.sha256(x).digest() for x in groups], pa.binary()), pa.array([n for _, n in groups.values()], pa.int64())]
            yield pa.RecordBatch.from_arrays([*kept.columns, *more], names=[*kept.schema.names, "content", "start", "digest", "size"])

    return run


def _neighbours(doc: str, text: str):
    """One row for each run of equal neighbours: the best row, with the run's size."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = rank = row = None
        size = 0

        def closed() -> pa.RecordBatch:
            return row.set_column(row.schema.get_field_index("size"), "size", pa.array([size], pa.int64()))

        for whole in batches:
            for batch in words.slices([whole], text):
                bare = batch.drop_columns(["content", "start"])
                out: list[int] = []
                sizes: list[int] = []
                at = -1  # the place of the run's best row in this batch; -1: in an earlier one
                for i, (here, its, n) in enumerate(zip(batch.column("content").to_pylist(), _ranks(batch, doc, text), batch.column("size").to_pylist(), strict=True)):
                    if data is not None and here == data:
                        size += n
                        if _better(its, rank):
                            rank, at = its, i
                        continue
                    if data is not None:
                        if at >= 0:
                            out.append(at)
                            sizes.append(size)
                        else:
                            yield closed()
                    data, rank, at, size = here, its, i, n
                if out:
                    done = bare.take(pa.array(out, pa.int64()))
                    yield done.set_column(done.schema.get_field_index("size"), "size", pa.array(sizes, pa.int64()))
                if at >= 0:
                    row = bare.take(pa.array([at], pa.int64()))
        if data is not None:
            yield closed()

    return run


def _sorted(folded: DataFrame, content: Column) -> DataFrame:
    """Equal contents adjacent: ranges of the first bytes (then the digest), each sorted by the whole content."""
    return folded.repartitionByRange("start", "digest").sortWithinPartitions(content)


def groups(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The row of each group that stays, with ``digest`` (binary) and ``size``; all columns of ``docs``."""
    scratch.small_batches(docs.sparkSession)
    schema = lambda *names: T.StructType([*docs.schema.fields, *(T.StructField(x, T.LongType() if x == "size" else T.BinaryType()) for x in names)])
    folded = docs.mapInArrow(_folded(doc, text), schema("content", "start", "digest", "size"))
    return _sorted(folded, F.col("content")).mapInArrow(_neighbours(doc, text), schema("digest", "size"))


_MEMBERS = pa.list_(pa.struct([("doc_id", pa.int64()), ("n", pa.int32())]))


def _listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each group of equal texts in a slice: the normalised bytes, their start and digest, and the members."""
    for batch in words.slices(batches, "text"):
        found: dict[bytes, list] = {}
        for data, (n, doc) in zip(normalised(batch.column("text")), _ranks(batch, "doc_id", "text"), strict=True):
            found.setdefault(data, []).append((doc, n))
        keys = list(found)
        columns = [pa.array(keys, pa.binary()), pa.array([x[:START] for x in keys], pa.binary()), pa.array([hashlib.sha256(x).digest() for x in keys], pa.binary()), pa.array(list(found.values()), _MEMBERS)]
        yield pa.RecordBatch.from_arrays(columns, names=["content", "start", "digest", "members"])


_RUNS = "part long, run long, nth long, digest binary, members array<struct<doc_id: long, n: int>>, keep_id long, keep_nth long, keep_pos int, group_size long"


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the run they stand in. A run of one row tells at once what stays; one of several has a last row for that, without members."""
    part, run, nth, size = TaskContext.get().partitionId(), 0, 0, 0
    content = best = None  # best: the rank of the member that stays, and its place
    names = [x.split()[0] for x in _RUNS.split(", ") if not x.startswith("n:")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), _MEMBERS, pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    out: list[tuple] = []
    waiting: tuple = ()  # the run's first row, while it has no other

    def close() -> None:
        told = (best[0][1], best[1], best[2], size)
        out.append((*waiting, *told) if waiting else (part, run, None, None, None, *told))

    def batch_of() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
        out.clear()
        return made

    for whole in batches:
        for batch in words.slices([whole], "content"):
            for here, digest, members in zip(batch.column("content").to_pylist(), batch.column("digest").to_pylist(), batch.column("members").to_pylist(), strict=True):
                if content is not None and here == content:
                    if waiting:
                        out.append((*waiting, None, None, None, None))
                        waiting = ()
                    nth += 1
                    out.append((part, run, nth, digest, members, None, None, None, None))
                else:
                    if content is not None:
                        close()
                    content, run, nth, size, best = here, run + 1, 0, 0, None
                    waiting = (part, run, 0, digest, members)
                size += len(members)
                for pos, x in enumerate(members):
                    if best is None or _better((x["n"], x["doc_id"]), best[0]):
                        best = (x["n"], x["doc_id"]), nth, pos
            if out:
                yield batch_of()
    if content is not None:
        close()
        yield batch_of()


def membership(docs: DataFrame) -> DataFrame:
    """For every row: doc_id, keep_id, group_size, kept, text_sha256."""
    scratch.small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    listed = rows.mapInArrow(_listed, "content binary, start binary, digest binary, members array<struct<doc_id: long, n: int>>")
    found = scratch.written(_sorted(listed, F.col("content")).select("content", "digest", "members").mapInArrow(_runs, _RUNS))
    told = ["keep_id", "keep_nth", "keep_pos", "group_size"]
    single = found.where("members is not null and group_size is not null").select("nth", "digest", "members", *told)
    ends = found.where("members is null").select("part", "run", *told)
    several = found.where("group_size is null").select("part", "run", "nth", "digest", "members").join(ends, ["part", "run"])
    whole = single.unionByName(several.select(single.columns))
    each = whole.select("nth", "digest", *told, F.posexplode("members").alias("pos", "member"))
    kept = (F.col("nth") == F.col("keep_nth")) & (F.col("pos") == F.col("keep_pos"))
    return each.select(F.col("member.doc_id").alias("doc_id"), "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicated(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, whole and unchanged, straight from the sort."""
    inner = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    found = groups(inner, f"c{docs.columns.index(doc)}", f"c{docs.columns.index(text)}")
    return found.select(*inner.columns).toDF(*docs.columns)


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t
  FROM documents
), r AS (
  SELECT doc_id, sha256(t) AS s,
    first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id NULLS LAST) AS keep_id,
    count(*) OVER (PARTITION BY t) AS group_size,
    row_number() OVER (PARTITION BY t ORDER BY n DESC, doc_id NULLS LAST) AS nth
  FROM d
)
SELECT doc_id, keep_id, group_size, nth = 1 AS kept, s AS text_sha256 FROM r
"""
