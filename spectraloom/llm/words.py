"""Arrow helpers shared by the operators that read whole texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 16 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def slices(batches: Iterable[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of text, one row at least."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(size[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(size, before + limit, side="right")))
            yield batch.slice(at, end - at)
            at = end


def gathered(batches: Iterable[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches joined and cut so that each holds about ``limit`` bytes of text, one row at least."""
    held, size = [], 0
    for batch in slices(batches, text, limit):
        own = pc.sum(pc.binary_length(batch.column(text))).as_py() or 0
        if held and size + own > limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        if batch.num_rows:
            held.append(batch)
            size += own
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def split(texts: pa.Array, ascii_space: bool = False) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Words of each text: offsets of the texts in the words, and the words as a dictionary.

    With ``ascii_space`` the words are the runs of characters other than space and U+0009..D,
    and there are no empty ones; else texts are cut at each space and line feed, and empty
    strings may appear. Null counts as empty.
    """
    texts = pc.fill_null(texts, "")
    if ascii_space:
        texts = pc.ascii_trim(pc.replace_substring_regex(texts, r"[ \t\n\x0b\f\r]+", " "), " ")
    else:
        texts = pc.replace_substring(texts, "\n", " ")
    listed = pc.split_pattern(texts, " ")
    offsets = listed.offsets.to_numpy().astype(np.int64)
    flat = listed.flatten()
    if ascii_space:
        empty = pc.equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
        if empty.any():
            offsets = np.concatenate([[0], np.cumsum(~empty)])[offsets]
            flat = flat.filter(pa.array(~empty))
    return offsets, flat.dictionary_encode()


def _plain_table() -> np.ndarray:
    """ASCII letters in lower case and digits as they are, other ASCII to space, other bytes kept."""
    table = np.arange(256, dtype=np.uint8)
    for c in range(128):
        table[c] = ord(chr(c).lower()) if chr(c).isalnum() else 32
    return table


PLAIN = _plain_table()


def mapped(texts: pa.Array, table: np.ndarray) -> pa.Array:
    """Each byte of the texts through a table that keeps UTF-8 valid; null as empty."""
    texts = pc.fill_null(texts, "")
    if texts.offset:
        texts = pa.concat_arrays([texts])
    _, offsets, data = texts.buffers()
    if data is None or not len(texts):
        return texts
    return type(texts).from_buffers(len(texts), offsets, pa.py_buffer(table[np.frombuffer(data, np.uint8)]), None, 0, 0)


def plain_split(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Runs of ASCII letters (in lower case), digits and non-ASCII characters, as ``split`` gives them."""
    listed = pc.split_pattern(mapped(texts, PLAIN), " ")
    offsets = listed.offsets.to_numpy().astype(np.int64)
    flat = listed.flatten()
    some = pc.greater(pc.binary_length(flat), 0)
    kept = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
    return kept[offsets], flat.filter(some).dictionary_encode()
