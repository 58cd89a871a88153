"""Token ids of whole texts by a public tokenizer file, one library call per distinct word."""

from __future__ import annotations

import functools
import json
import os
import re
import string
from collections.abc import Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import words


def _byte_letters() -> dict[int, str]:
    """How byte-level BPE writes bytes: printable ones as they are, the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(256 + i) for i, b in enumerate(rest)}


BYTES = _byte_letters()
MEMO = 600_000  # words that a worker remembers
SLICE_BYTES = 4 << 20  # of text that is encoded at once; its words and ids take many times that


# The normaliser and the pre-tokenizer of files whose tokens stop at white space and lower-case first.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}


def _form_is_known(path: str) -> bool:
    """Whether the file normalises and cuts texts as stated above, and has a plain BPE model."""
    with open(path, encoding="utf-8") as file:
        form = json.load(file)
    cut = form["pre_tokenizer"] or {}
    parts = cut.get("pretokenizers", [])
    byte_level = len(parts) == 2 and {k: v for k, v in parts[1].items() if k != "trim_offsets"} == BYTE_LEVEL
    model = form["model"]
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    marks = all(any(c.isalnum() for c in x["content"]) and not any(c.isspace() for c in x["content"]) for x in form["added_tokens"])
    return form["normalizer"] == NORMALIZER and cut.get("type") == "Sequence" and byte_level and parts[0] == SPLIT and plain and marks and not form["post_processor"]


def _byte_table(changed: dict[int, int]) -> np.ndarray:
    return np.array([changed.get(b, b) for b in range(256)], np.uint8)


#: Line feeds become spaces, and with the second table A-Z lower-case.
SPACED = _byte_table({10: 32})
LOWERED = _byte_table({10: 32} | {c: c + 32 for c in range(65, 91)})
CLOSING, ALNUM = (np.array([b < 128 and chr(b) in chars for b in range(256)]) for chars in (string.punctuation, string.ascii_letters + string.digits))


def parted(texts: pa.Array) -> pa.Array:
    """The texts in lower case (A-Z), with spaces for line feeds and before single closing punctuation.

    The files lower-case and part the two themselves; so a word is looked up in one form only. Texts with the beginning of a
    special token keep their case, as those tokens are told by it. Punctuation is parted where an ASCII letter or digit or a
    letter from U+00C0 to U+00FF stands before it and white space or nothing follows.
    """
    texts = pc.fill_null(texts, "")
    if texts.offset:
        texts = pa.concat_arrays([texts])
    _, buffer, data = texts.buffers()
    if data is None or not len(texts):
        return texts
    offsets = np.frombuffer(buffer, np.int64 if pa.types.is_large_string(texts.type) else np.int32)[: len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[: offsets[-1]]
    b = (SPACED if b"<|" in memoryview(raw).tobytes() else LOWERED)[raw]
    edge = np.zeros(len(b) + 1, bool)
    edge[offsets] = True
    at = np.flatnonzero(CLOSING[b])
    at = at[~edge[at] & (edge[at + 1] | (b[np.minimum(at + 1, len(b) - 1)] == 32))]
    before, lead = b[at - 1], b[np.maximum(at - 2, 0)]
    at = at[ALNUM[before] | ((lead == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7))]
    out = np.insert(b, at, 32)
    moved = (offsets + np.searchsorted(at, offsets)).astype(offsets.dtype)
    return type(texts).from_buffers(len(texts), pa.py_buffer(moved), pa.py_buffer(out), None, 0, 0)


class WordTokenizer:
    """``tokenizers`` over whole texts, for files whose tokens never span or keep white space.

    A text is cut at spaces and line feeds, each distinct word is encoded once by the library and
    remembered, and the ids of a text are those of its words in order. This equals encoding the
    whole text when the pre-tokenizer drops white space; the constructor reads the file's normaliser and
    pre-tokenizer and refuses files of any other form.
    A word of letters with closing ASCII punctuation is looked up as its lower-case letters and its
    punctuation, as the file itself lower-cases and parts the two; a lower-case letter word goes straight
    to the file's BPE model, as its normaliser and pre-tokenizer would leave it as it is. At ``memo`` words
    the memory drops those that were met only once since it last did.
    """

    #: Scripts whose letters are single code points that NFC keeps and that lower-case one to one.
    LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff\u0410-\u044f]+")

    def __init__(self, path: str, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if not _form_is_known(path):
            raise ValueError(f"{path}: tokens of this file may depend on white space")
        self.inner = Tokenizer.from_file(path)
        self.memo = memo
        self._clear()

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.inner.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, word: str) -> list[int]:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(BYTES)
        return [x.id for x in self.inner.model.tokenize(word)]

    def _clear(self) -> None:
        self.units: dict[str, int] = {"": 0}  # of words and parts of words
        self.ids = np.empty(1 << 16, np.uint32)
        self.start = np.zeros(1 << 14, np.int64)  # of the n-th unit in ids, and the end of the last
        self.hits = np.zeros(1 << 14, np.int32)  # slices that had the unit
        self.n, self.used = 1, 0

    def _drop(self) -> None:
        """Forget the units that no second slice had; all of them if that leaves more than half."""
        kept = [w for w, u in self.units.items() if self.hits[u] > 1 and u]
        if 2 * len(kept) > self.memo:
            return self._clear()
        ids, ends = self._gather(np.fromiter(map(self.units.__getitem__, kept), np.int64, len(kept)))
        self._clear()
        return self._add(kept, ids, np.diff(ends))

    def _gather(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of units end to end, and where each ends, from 0."""
        begin = self.start[units]
        lengths = self.start[units + 1] - begin
        ends = np.zeros(len(units) + 1, np.int64)
        np.cumsum(lengths, out=ends[1:])
        pick = np.repeat(begin - ends[:-1], lengths)
        pick += np.arange(ends[-1])
        return self.ids[pick], ends

    def _add(self, new: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while self.n + len(new) + 1 > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.hits = np.concatenate([self.hits, np.zeros_like(self.hits)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.start[self.n + 1 : self.n + 1 + len(new)] = self.used + np.cumsum(lengths)
        self.units.update(zip(new, range(self.n, self.n + len(new)), strict=True))
        self.n, self.used = self.n + len(new), self.used + len(ids)

    def _encode_units(self, new: list[str], letters: bool) -> None:
        for at in range(0, len(new), 50_000):
            part = new[at : at + 50_000]
            own = [self._letters(x) for x in part] if letters else self._ids(part)
            lengths = np.fromiter(map(len, own), np.int64, len(own))
            self._add(part, np.fromiter(chain.from_iterable(own), np.uint32, int(lengths.sum())), lengths)

    def _learn(self, new: list[str]) -> None:
        units, match, closing = self.units, self.LETTERS.fullmatch, string.punctuation
        letters, others, joined = {}, {}, {}
        for w in new:
            core = w.rstrip(closing)
            if match(core):
                rest = w[len(core) :]
                core = core.lower()
                if core not in units:
                    letters[core] = None
                if core != w:
                    if rest and rest not in units:
                        others[rest] = None
                    joined[w] = core, rest
            else:
                others[w] = None
        self._encode_units(list(letters), True)
        self._encode_units([x for x in others if x not in units], False)
        joined = {w: x for w, x in joined.items() if w not in units}
        if joined:
            both = np.fromiter(map(units.__getitem__, chain.from_iterable(joined.values())), np.int64, 2 * len(joined))
            ids, ends = self._gather(both)
            self._add(list(joined), ids, np.diff(ends[::2]))

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Offsets (one more than texts) and the ids of all texts, end to end, each with ``end_id`` after it; null is empty."""
        listed = pc.split_pattern(parted(texts), " ")
        offsets, flat = listed.offsets.to_numpy().astype(np.int64), listed.flatten().dictionary_encode()
        distinct = flat.dictionary.to_pylist()
        if len(self.units) + len(distinct) > self.memo:
            self._drop()
        units = np.fromiter(map(self.units.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(units < 0).tolist()
        if new:
            self._learn([distinct[i] for i in new])
            units[new] = [self.units[distinct[i]] for i in new]
        self.hits[units] += 1
        units = units[flat.indices.to_numpy()] if len(units) else units
        if end_id is not None:
            if (mark := f" {end_id}") not in self.units:  # no word has a space
                self._add([mark], np.array([end_id], np.uint32), np.ones(1, np.int64))
            units = np.insert(units, offsets[1:], self.units[mark])
            offsets = offsets + np.arange(len(offsets))
        ids, ends = self._gather(units)
        return ends[offsets], ids


@functools.lru_cache(maxsize=2)
def worker_tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of this worker process, which keeps its words from task to task."""
    return WordTokenizer(path)


def encoded(batches: Iterable[pa.RecordBatch], text: str, path: str, end_id: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with the offsets and ids of their texts, ``end_id`` after each text."""
    tokenizer = worker_tokenizer(path)
    for batch in words.gathered(batches, text, SLICE_BYTES):
        yield batch, *tokenizer.encode(batch.column(text), end_id)
    pa.default_memory_pool().release_unused()  # else the worker keeps it for as long as it lives
