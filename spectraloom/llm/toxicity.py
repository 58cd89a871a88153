"""Operator 1: toxicity by maximum-scoring segments over token log-odds.

Words (ASCII lower case, cut at ASCII characters that are no letter or digit) are counted once a
document in labelled toxic and clean documents, and so are word stems, the first four and five code points. A token's
log-odds between the two stand under a Dirichlet prior in proportion to both classes together; their lower
end less ``DRIFT`` is its score, and a word scores as the best of itself and its stems. So
passages without toxic words score below zero. A linear scan finds all maximal segments of a
text. Under the clean model, segments of score S or more come about K n exp(-lambda S) times in n words
(Karlin and Altschul); lambda follows from the word scores, K from the clean training documents. Segments
whose expected number is below ``level`` are significant; a document's evidence is the Poisson sum
statistic of those, and a logistic curve fitted on the training documents turns it into a score. The curve is
the minimum of a convex loss, found by steps that only go down; ``clean`` refuses a model that misses
half or more of the toxic documents it learned from, as it would let everything pass.

Scale: at most ``sample`` labelled rows are learned from (chosen by a hash of the id), so what is
joined by broadcast and gathered from them is bounded. Log-odds are computed in the table of counts; only tokens that score above
the least score, which all others have, come to the driver. Scoring is one pass without a
shuffle; a task holds about 16 MB of text.

Cases: null and empty texts score as documents without evidence; null labels and null ids are not
learned from; a label repeated for a document counts each time; without toxic or without clean
labels every score is that class share; an empty table gives no rows; only doc_id and text are read;
``clean`` keeps rows alike in everything or none of them, and other columns under any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, words

SAMPLE, LEAST_DOCS, PRIOR, DRIFT, LEVEL = 20_000, 3, 100.0, 0.5, 0.05
LEAST_SCORE = -1.0
TRUSTED = 50
DEVIATIONS = 1.7  # below the log-odds; many words are tried, so few may pass by chance


@dataclass
class Model:
    scores: dict[str, float] = field(default_factory=dict)
    other: float = LEAST_SCORE  # of all other words
    rate: float = 1.0  # lambda
    k: float = 0.1
    curve: tuple[float, float] = (0.0, 0.0)
    level: float = LEVEL
    learned: tuple[int, int] = (0, 0)  # toxic documents learned from, and how many of them score one half or more


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a text, in linear time (Ruzzo and Tompa).

    Only places with a positive score can begin or end one, so only those are visited; what lies
    between them is in the running sum. Each held segment knows the last one before it that begins at
    a smaller sum, so segments that a search has passed over are not looked at again.
    """
    places = np.flatnonzero(scores > 0)
    if not len(places):
        return []
    total = np.cumsum(scores)
    after = total[places].tolist()
    before = (total[places] - scores[places]).tolist()
    held: list[tuple] = []  # start, end, sum before, sum after, place of the last one that begins lower
    for at, low, high in zip(places.tolist(), before, after, strict=True):
        start = at
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= low:
                j = held[j][4]
            if j < 0 or held[j][3] >= high:
                break
            start, low = held[j][0], held[j][2]
            del held[j:]
        held.append((start, at + 1, low, high, j))
    return [(a, b, high - low) for a, b, low, high, _ in held]


def evidence(found: list[float], n: int, model: Model) -> tuple[float, int]:
    """-log of the sum statistic's tail for the significant of segment scores, and their number."""
    base = math.log(max(model.k * max(n, 1), 1e-12))
    own = [x for s in found if (x := model.rate * s - base) > -math.log(model.level)]
    if not own:
        return 0.0, 0
    r, total = len(own), sum(own)
    return max(0.0, total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r)), r


def _feature(e: float) -> float:
    return math.log1p(e)


def score(e: float, model: Model) -> float:
    a, b = model.curve
    return 1 / (1 + math.exp(-(a + b * _feature(e))))


STEMS = (4, 5)


def stems(distinct: pa.Array, k: int) -> tuple[np.ndarray, pa.Array]:
    """Places of the words that are longer than ``k`` code points, and their stems, marked by a tilde."""
    long = np.flatnonzero(pc.greater(pc.utf8_length(distinct), k).to_numpy(zero_copy_only=False))
    return long, pc.binary_join_element_wise(pc.utf8_slice_codeunits(distinct.take(pa.array(long)), 0, k), "~", "")


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, toxic, clean: documents of this slice that hold the word or stem."""
    for batch in words.slices(batches, "text"):
        offsets, flat = words.plain_split(batch.column("text"))
        label = batch.column("toxic").to_numpy(zero_copy_only=False)
        size = len(flat.dictionary)
        if not size:
            continue
        doc = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
        pairs = np.unique(doc * size + flat.indices.to_numpy())
        kinds = [(flat.dictionary, np.arange(size))]
        for k in STEMS:
            long, stem = stems(flat.dictionary, k)
            coded = stem.dictionary_encode()
            to = np.full(size, -1)
            to[long] = coded.indices.to_numpy()
            kinds.append((coded.dictionary, to))
        for names, to in kinds:
            own = to[pairs % size]
            have = np.unique((pairs // size)[own >= 0] * size + own[own >= 0])
            on = label[have // size] == 1
            toxic, clean = (np.bincount(have[x] % size, minlength=len(names)) for x in (on, ~on))
            yield pa.RecordBatch.from_arrays([names, pa.array(toxic), pa.array(clean)], names=["word", "toxic", "clean"])


def _text_scores(batch: pa.RecordBatch, model: Model) -> tuple[np.ndarray, np.ndarray]:
    offsets, flat = words.plain_split(batch.column("text"))
    known, other = model.scores, model.other
    each = np.fromiter((known.get(w, other) for w in flat.dictionary.to_pylist()), float, len(flat.dictionary))
    for k in STEMS:
        long, stem = stems(flat.dictionary, k)
        each[long] = np.maximum(each[long], np.fromiter((known.get(w, other) for w in stem.to_pylist()), float, len(long)))
    return offsets, each[flat.indices.to_numpy()] if len(each) else np.zeros(0)


def _found(batches: Iterable[pa.RecordBatch], model: Model) -> Iterator[tuple[pa.RecordBatch, int, int, list]]:
    """Every document's batch, place, number of words and segments."""
    for batch in words.slices(batches, "text"):
        offsets, flat = _text_scores(batch, model)
        some = np.add.reduceat(np.append(flat > 0, False), np.minimum(offsets[:-1], len(flat))) if batch.num_rows else []
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            yield batch, i, b - a, segments(flat[a:b]) if b > a and some[i] else []


def sample_of(labels: DataFrame, column: str, keep, sample: int) -> DataFrame:
    """At most ``sample`` labelled rows that ``keep`` (a predicate) lets be learned from, by a hash of the id."""
    rows = labels.select(F.col("doc_id").cast("long"), F.col(column).cast("int")).where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & keep)
    return rows.orderBy(F.xxhash64("doc_id", F.lit(column)), "doc_id", column).limit(sample)


def fit(docs: DataFrame, labels: DataFrame, keep=None, sample: int = SAMPLE) -> Model:
    """Learn from ``labels`` (doc_id, toxic) where ``keep`` holds."""
    spark = docs.sparkSession
    scratch.small_batches(spark)
    chosen = sample_of(labels, "toxic", F.lit(True) if keep is None else keep, sample)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    train = scratch.written(texts.join(F.broadcast(chosen), "doc_id"))  # as many rows as ``sample`` bounds
    counts = train.select("text", "toxic").mapInArrow(_counted, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = scratch.written(counts)
    sums = counts.where(~F.col("word").endswith("~")).agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("toxic", "clean"))).first()
    shares = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    model = Model()
    share = (shares.get(1, 0) + 0.5) / (sum(shares.values()) + 5)  # without labels a tenth
    model.curve = (math.log(share / (1 - share)), 0.0)
    if not shares.get(1) or not shares.get(0):
        return model
    # Of the tokens that enough documents hold, those above the least score; which are as many as the sample's texts bear out.
    vocabulary = counts.where(F.col("toxic") + F.col("clean") >= LEAST_DOCS)
    n = np.array([sums["toxic"], sums["clean"]], float)
    whole = n + PRIOR + 0.5 * vocabulary.count()
    prior = F.lit(0.5) + (F.col("toxic") + F.col("clean")) * F.lit(PRIOR / float(n.sum()))
    up = vocabulary.select("word", (F.col("toxic") + prior).alias("t"), (F.col("clean") + prior).alias("c"))
    odds = F.log(F.col("t") / (whole[0] - F.col("t"))) - F.log(F.col("c") / (whole[1] - F.col("c")))
    low = odds - DEVIATIONS * F.sqrt(1 / F.col("t") + 1 / F.col("c"))
    above = up.select("word", "c", low.alias("low")).where(F.col("low") - DRIFT > LEAST_SCORE).orderBy("word").collect()
    low = np.array([r["low"] for r in above], float)
    # A positive score needs a word that is toxic far beyond chance among all words that were tried.
    final = np.where((low > DRIFT) & (low < 1.0), -DRIFT, low - DRIFT)
    model.scores = {r["word"]: float(s) for r, s in zip(above, final, strict=True)}
    # The null model: words at their rate in clean documents, and the stems that score above zero; all others have the least score.
    atoms = np.array([s > 0 or not w.endswith("~") for w, s in model.scores.items()], bool)
    null = np.array([r["c"] for r in above], float)[atoms] / whole[1]
    model.rate = _rate(np.append(final[atoms], model.other), np.append(null, max(0.0, 1 - null.sum())))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, size, found in _found(batches, model):
            yield pa.RecordBatch.from_arrays([batch.column("toxic").slice(i, 1), pa.array([size], pa.int64()), pa.array([[s for _, _, s in found]], pa.list_(pa.float64()))], names=["toxic", "n", "scores"])

    seen = train.select("text", "toxic").mapInArrow(run, "toxic int, n long, scores array<double>").collect()  # a row for each of the sample
    clean = [r for r in seen if not r["toxic"]]
    total = sum(r["n"] for r in clean) or 1
    every = [s for r in clean for s in r["scores"]]
    floor = min(every, default=1.0)
    model.k = min(1.0, max(0.5, len(every)) * math.exp(model.rate * floor) / total)
    x = np.array([_feature(evidence(r["scores"], r["n"], model)[0]) for r in seen])
    y = np.array([r["toxic"] for r in seen], float)
    model.curve = _logistic(x, y)
    model.learned = int(y.sum()), int((y * (model.curve[0] + model.curve[1] * x >= 0)).sum())
    return model


def _rate(scores: np.ndarray, weights: np.ndarray) -> float:
    """The positive lambda with sum of weight x exp(lambda x score) = 1; 1 if there is none."""
    weights = weights / weights.sum()
    if scores.max() <= 0 or (weights * scores).sum() >= 0:
        return 1.0
    low, high = 0.0, 1.0
    value = lambda x: float((weights * np.exp(np.minimum(x * scores, 700))).sum())
    while value(high) < 1 and high < 64:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 1 else (low, mid)
    return high


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Intercept and slope (none below zero) of least penalised loss, by Newton steps halved until the loss falls."""
    d = np.stack([np.ones_like(x), x], axis=1)

    def loss(w: np.ndarray) -> float:
        return float(np.logaddexp(0, d @ w).sum() - y @ (d @ w) + ridge / 2 * w @ w)

    w, now = np.zeros(2), loss(np.zeros(2))
    for _ in range(500):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -700, 700)))
        down = d.T @ (y - p) - ridge * w
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + ridge * np.eye(2), down)
        if down @ step < 1e-9 * max(1.0, now):  # what a whole step could still gain
            return float(w[0]), float(max(w[1], 0.0))
        size = 1.0
        while size > 1e-9 and loss(w + size * step) > now - 1e-4 * size * (down @ step):
            size /= 2
        w = w + size * step
        now = loss(w)
    raise ArithmeticError("the logistic curve didn't converge")


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, evidence and passages (start and end in words, score, expected number by chance) of every row."""
    scratch.small_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, out = None, []

        def batch_of(batch: pa.RecordBatch) -> pa.RecordBatch:
            e, p = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([score(x, model) for x in e]), pa.array(e, pa.float64()), pa.array(p, kind)], names=["doc_id", "score", "evidence", "passages"])

        for batch, _, n, found in _found(batches, model):
            if last is not None and batch is not last:
                yield batch_of(last)
                out = []
            last = batch
            expected = [model.k * max(n, 1) * math.exp(-model.rate * s) for _, _, s in found]
            out.append((evidence([s for _, _, s in found], n, model)[0], [{"start": a, "end": b, "score": s, "expected": x} for (a, b, s), x in zip(found, expected, strict=True) if x < model.level]))
        if last is not None:
            yield batch_of(last)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, evidence double, passages array<struct<start: long, end: long, score: double, expected: double>>")


def clean(docs: DataFrame, model: Model, reject: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``reject``, whole and unchanged, in one pass.

    A model that learned from ``TRUSTED`` toxic documents or more and finds less than half of them is refused.
    """
    toxic, caught = model.learned
    if toxic >= TRUSTED and 2 * caught < toxic:
        raise ValueError(f"the model finds {caught} of the {toxic} toxic documents it learned from; it would let toxic documents pass")
    scratch.small_batches(docs.sparkSession)
    inner = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    names, text = inner.columns, f"c{docs.columns.index('text')}"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, keep = None, []
        named = (b.rename_columns(["text" if x == text else x for x in b.schema.names]) for b in batches)
        for batch, _, n, found in _found(named, model):
            if last is not None and batch is not last:
                yield last.filter(pa.array(keep)).rename_columns(names)
                keep = []
            last = batch
            keep.append(score(evidence([s for _, _, s in found], n, model)[0], model) < reject)
        if last is not None:
            yield last.filter(pa.array(keep)).rename_columns(names)

    return inner.mapInArrow(run, inner.schema).toDF(*docs.columns)


def held_out(doc_id, parts: int, rest: int):
    """True where the unsigned CRC-32 of the id as text leaves ``rest`` on division by ``parts``; null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == rest, F.lit(False))
