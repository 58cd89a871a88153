"""Operator 6: a quality classifier by positive-unlabelled learning.

Trusted positives are labelled rows of good quality; the unlabelled set is web text, whatever its
quality. A model that adds one weight for each feature's interval minimises the non-negative
unbiased risk (Kiryo and others): pi R+(positives) + max(0, R-(unlabelled) - pi R-(positives)), with the logistic loss, so
that its output is a probability. pi, the class prior, is estimated from positives and unlabelled rows alone: a first model is learned from half of
both, and on the other half the score range is sought in which the unlabelled rows are fewest for the positives (best bin estimation,
Garg and others), as good rows must be at least so many everywhere. Features are shapes of a text: shares of kinds of characters, lengths, repeated words and
lines, so the model reads no label, language, source or id.

Scale: at most ``sample`` positives and ``sample`` unlabelled documents, chosen by a hash of the id, are
joined by broadcast and gathered; features and scores are one pass without a shuffle.

Cases: null and empty texts have features of their own (all zero) and are scored; null labels and ids
are not learned from; without positives every score is the prior; an empty table gives no rows; only
doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, words
from .toxicity import sample_of

SAMPLE, INTERVALS = 20_000, 16
KINDS = ("upper", "lower", "digit", "space", "line", "stop", "symbol", "other")
FEATURES = (*(f"{k}_share" for k in KINDS), "log_bytes", "word_length", "distinct_words", "repeated_words", "longest_run", "top_word", "repeated_lines", "line_length", "marked_words", "symbol_words")


def _kinds() -> np.ndarray:
    table = np.full(256, 7, np.uint8)
    for c in range(128):
        x = chr(c)
        table[c] = 0 if x.isupper() else 1 if x.islower() else 2 if x.isdigit() else 4 if x == "\n" else 3 if x.isspace() else 5 if x in ".,;:'\"()-?" else 6
    return table


KIND = _kinds()


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _per_pair(offsets: np.ndarray, codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of each document and the count of its most frequent one."""
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n), np.diff(offsets))
    pairs, count = np.unique(doc * max(size, 1) + codes, return_counts=True)
    own = pairs // max(size, 1)
    top = np.zeros(n)
    np.maximum.at(top, own, count)
    return np.bincount(own, minlength=n).astype(float), top


def features(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text."""
    texts = pa.concat_arrays([pc.fill_null(texts, "")])
    n = len(texts)
    _, buffer, data = texts.buffers()
    at = np.frombuffer(buffer, np.int64 if pa.types.is_large_string(texts.type) else np.int32)[: n + 1].astype(np.int64)
    kind = KIND[np.frombuffer(data, np.uint8)] if data is not None else np.zeros(0, np.uint8)
    size = np.diff(at).astype(float)
    some = np.maximum(size, 1)
    out = [_sums(kind == k, at) / some for k in range(len(KINDS))]
    out.append(np.log1p(size))

    offsets, flat = words.split(texts)
    codes = flat.indices.to_numpy().astype(np.int64)
    names = flat.dictionary
    length = pc.utf8_length(names).to_numpy(zero_copy_only=False).astype(float)
    real = length[codes] > 0 if len(codes) else np.zeros(0, bool)
    kept = np.concatenate([[0], np.cumsum(real)])
    offsets, codes = kept[offsets], codes[real]
    count = np.maximum(np.diff(offsets), 1)
    out.append(_sums(length[codes], offsets) / count)
    distinct, top = _per_pair(offsets, codes, len(names))
    out.append(distinct / np.sqrt(count))
    first = np.zeros(len(codes), bool)
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    same = np.concatenate([[False], codes[1:] == codes[:-1]]) & ~first
    out.append(_sums(same, offsets) / count)
    # The longest run of one word, as a share of the words.
    starts = np.flatnonzero(~same)
    longest = np.zeros(n)
    if len(starts):
        doc = np.repeat(np.arange(n), np.diff(offsets))
        np.maximum.at(longest, doc[starts], np.diff(np.append(starts, len(codes))))
    out += [np.log1p(longest), top / count]

    lines = pc.split_pattern(texts, "\n")
    line_at = lines.offsets.to_numpy().astype(np.int64)
    line = lines.flatten().dictionary_encode()
    n_lines = np.maximum(np.diff(line_at), 1)
    unlike, _ = _per_pair(line_at, line.indices.to_numpy().astype(np.int64), len(line.dictionary))
    out += [1 - unlike / n_lines, np.log1p(size / n_lines)]
    marked = pc.match_substring_regex(names, r"[^\w\s.,;:'\"()?-]\W*$").to_numpy(zero_copy_only=False)
    lone = pc.match_substring_regex(names, r"^[!-/:-@\[-`{-~]+$").to_numpy(zero_copy_only=False)
    out += [_sums(marked[codes], offsets) / count, _sums(lone[codes], offsets) / count]
    return np.stack(out, axis=1)


@dataclass
class Model:
    edges: list[np.ndarray] = field(default_factory=list)  # of the intervals of each feature
    weights: list[np.ndarray] = field(default_factory=list)
    bias: float = 0.0


def score(x: np.ndarray, model: Model) -> np.ndarray:
    g = np.full(len(x), model.bias)
    for f, (edges, weights) in enumerate(zip(model.edges, model.weights, strict=True)):
        g += weights[np.searchsorted(edges, x[:, f], side="right")]
    return 1 / (1 + np.exp(-np.clip(g, -30, 30)))


def learn(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 400, rate: float = 0.05, ridge: float = 1e-4) -> Model:
    """Minimise the non-negative risk by Adam over whole samples."""
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    model = Model(bias=float(np.log(prior / (1 - prior))))
    if not len(positive) or not len(unlabelled):
        return model
    for f in range(unlabelled.shape[1]):
        inner = np.quantile(unlabelled[:, f], np.concatenate([[0.003, 0.01, 0.03], np.arange(1, INTERVALS) / INTERVALS, [0.97, 0.99, 0.997]]))
        model.edges.append(np.unique(inner))
    sizes = [len(e) + 1 for e in model.edges]
    base = np.concatenate([[0], np.cumsum(sizes)])
    places = [np.stack([base[f] + np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(model.edges)], axis=1) for x in (positive, unlabelled)]
    w, first, second = (np.zeros(base[-1] + 1) for _ in range(3))
    w[-1] = model.bias

    def gradient(where: np.ndarray, d: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(where.ravel(), np.repeat(d, where.shape[1]), base[-1]), d.sum())

    for t in range(1, rounds + 1):
        g_p, g_u = (w[x].sum(axis=1) + w[-1] for x in places)
        s_p, s_u = (1 / (1 + np.exp(-np.clip(g, -30, 30))) for g in (g_p, g_u))
        # Losses: log(1 + exp(-g)) of a positive, log(1 + exp(g)) of a negative.
        negative = np.logaddexp(0, g_u).mean() - prior * np.logaddexp(0, g_p).mean()
        step_n = gradient(places[1], s_u / len(s_u)) - prior * gradient(places[0], s_p / len(s_p))
        step = -step_n if negative < 0 else prior * gradient(places[0], (s_p - 1) / len(s_p)) + step_n
        step = step + ridge * np.append(w[:-1], 0)
        first, second = 0.9 * first + 0.1 * step, 0.999 * second + 0.001 * step**2
        w = w - rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    model.weights = [w[a:b] for a, b in zip(base[:-1], base[1:], strict=True)]
    model.bias = float(w[-1])
    return model


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1, gamma: float = 0.01) -> float:
    """The share of positives among the unlabelled rows; the rows of both are in random order."""
    if min(len(positive), len(unlabelled)) < 2:
        return 0.5
    model = learn(positive[::2], unlabelled[::2], 0.5)
    p, u = np.sort(score(positive[1::2], model)), np.sort(score(unlabelled[1::2], model))
    cut = np.unique(p)
    above_p, above_u = (1 - np.searchsorted(x, cut, side="left") / len(x) for x in (p, u))
    slack = sum(np.sqrt(np.log(4 / delta) / (2 * len(x))) for x in (p, u))
    best = np.argmin((above_u + (1 + gamma) * slack) / above_p)
    # The lower end: too high a prior lets the model take bad rows for good ones, too low a one costs little.
    return float(np.clip(above_u[best] / above_p[best] - np.sqrt(np.log(4 / delta) / (2 * len(u))), 0.01, 0.99))


def fit(docs: DataFrame, labels: DataFrame, keep=None, sample: int = SAMPLE) -> Model:
    """Learn from ``labels`` (doc_id, quality) where ``keep`` holds and from unlabelled rows of ``docs``."""
    scratch.small_batches(docs.sparkSession)
    keep = F.lit(True) if keep is None else keep
    good = sample_of(labels, "quality", keep & (F.col("quality") == 1), sample).select("doc_id", F.lit(1).alias("kind"))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    web = texts.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id", F.lit("web")), "doc_id").limit(sample).select("doc_id", F.lit(0).alias("kind"))
    chosen = good.unionByName(web)  # twice ``sample`` rows at most

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, "text"):
            x = features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("kind"), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "kind", "x"])

    chosen = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "kind", "text")
    seen = chosen.mapInArrow(run, "doc_id long, kind int, x array<double>").orderBy(F.xxhash64("doc_id"), "kind", "x").toArrow()
    kind = seen.column("kind").to_numpy()
    x = np.array(seen.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    positive, unlabelled = x[kind == 1], x[kind == 0]
    return learn(positive, unlabelled, class_prior(positive, unlabelled))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""
    scratch.small_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score(features(batch.column("text")), model))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
