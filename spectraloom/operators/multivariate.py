"""Correlation between samples, principal components and a neighbour embedding."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranges import RANGES
from ..model import Study, logged
from .filters import complete_features

#: Samples whose square matrix may be gathered: an eigenproblem of this size takes half a minute and 200 MB.
MOST_SAMPLES = 5_000


#: A sample with more values than this is dealt to ranges, so that no task holds all of it.
MOST_VALUES = 100_000


def _pairs(x: DataFrame, layer: str) -> DataFrame:
    """obs_i, obs_j (i <= j), a, b, var_id: values of two samples for the features that both have."""
    x = x.where(F.col(layer).isNotNull())
    ranged = ["_range"] if "_range" in x.columns else []
    left = x.select("var_id", F.col("obs_id").alias("obs_i"), F.col(layer).cast("double").alias("a"), *(F.col(c).alias("_ra") for c in ranged))
    right = x.select("var_id", F.col("obs_id").alias("obs_j"), F.col(layer).cast("double").alias("b"), *(F.col(c).alias("_rb") for c in ranged))
    return left.join(right, "var_id").where("obs_i <= obs_j")


def _with_range(x: DataFrame, layer: str, most: int | None = None) -> DataFrame:
    """Add ``_range``, a value's place among its sample's quantiles: equal values share one, larger ones have none smaller."""
    most = MOST_VALUES if most is None else most
    cuts = x.groupBy("obs_id").agg(F.percentile_approx(layer, [i / RANGES for i in range(1, RANGES)], 10 * RANGES).alias("_q"), F.count(layer).alias("_n"))
    none = F.array().cast(f"array<{dict(x.dtypes)[layer]}>")
    cuts = F.broadcast(cuts.select("obs_id", F.when(F.col("_n") > most, F.array_distinct("_q")).otherwise(none).alias("_q")))  # a row for each sample
    return x.join(cuts, "obs_id").withColumn("_range", F.size(F.filter("_q", lambda c: c < F.col(layer)))).drop("_q")


def _ranked(pairs: DataFrame) -> DataFrame:
    """a and b become their mean ranks among the pair's rows: the rows of lower ranges and the rank inside the range."""
    keys = ["obs_i", "obs_j"]
    cells = pairs.groupBy(*keys, "_ra", "_rb").agg(F.count("*").alias("_c"))
    out = pairs
    for value, part in (("a", "_ra"), ("b", "_rb")):
        before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a pair
        lower = cells.groupBy(*keys, part).agg(F.sum("_c").alias("_c")).select(*keys, part, F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_below"))
        inside = Window.partitionBy(*keys, part).orderBy(value)
        rank = (F.rank().over(inside) + F.count(F.lit(1)).over(inside.rangeBetween(Window.unboundedPreceding, Window.currentRow))) / 2
        out = out.withColumn(value, rank).join(lower, [*keys, part]).withColumn(value, F.col(value) + F.col("_below")).drop("_below", part)
    return out


def _correlated(pairs: DataFrame) -> DataFrame:
    """Pearson's r; missing where a side doesn't vary or only one feature is shared."""
    spread = (F.stddev_pop("a") > 0) & (F.stddev_pop("b") > 0)
    return pairs.groupBy("obs_i", "obs_j").agg(F.when(spread, F.try_divide(F.covar_pop("a", "b"), F.stddev_pop("a") * F.stddev_pop("b"))).alias("r"))


def _tied(*v: np.ndarray) -> float:
    return float(sum(c * (c - 1) / 2 for c in np.unique(np.stack(v), axis=1, return_counts=True)[1]))


def _taus(pairs: DataFrame) -> DataFrame:
    """Kendall's tau-b of each pair of samples.

    Two rows stand against each other inside a range of a (sorted and counted there), inside a range of b but in different
    ranges of a (likewise), or in different ranges of both (from a table of ranges).
    """
    keys, parts = ["obs_i", "obs_j"], "obs_i string, obs_j string, n double, ta double, tb double, tab double, against double"

    def row(key, n=0.0, ta=0.0, tb=0.0, tab=0.0, against=0.0):
        return pd.DataFrame({"obs_i": [key[0]], "obs_j": [key[1]], "n": [n], "ta": [ta], "tb": [tb], "tab": [tab], "against": [against]})

    def by_a(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        a, b = own["a"].to_numpy(), own["b"].to_numpy()
        return row(key, n=float(len(a)), ta=_tied(a), tab=_tied(a, b), against=_inversions(b[np.lexsort((b, a))])[0])

    def by_b(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        ra, b = own["_ra"].to_numpy(), own["b"].to_numpy()
        return row(key, tb=_tied(b), against=_inversions(b[np.lexsort((b, ra))])[0])

    def by_cell(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        table = np.zeros((RANGES, RANGES))
        table[own["_ra"], own["_rb"]] = own["_c"]
        later = table[::-1].cumsum(0)[::-1].cumsum(1)  # rows in this range of a or a later one, and this of b or an earlier one
        return row(key, against=float((table[:-1, 1:] * later[1:, :-1]).sum()))

    cells = pairs.groupBy(*keys, "_ra", "_rb").agg(F.count("*").alias("_c"))
    found = pairs.select(*keys, "_ra", "a", "b").groupBy(*keys, "_ra").applyInPandas(by_a, parts)
    found = found.unionByName(pairs.select(*keys, "_rb", "_ra", "b").groupBy(*keys, "_rb").applyInPandas(by_b, parts))
    found = found.unionByName(cells.groupBy(*keys).applyInPandas(by_cell, parts))
    sums = found.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("n", "ta", "tb", "tab", "against")))
    pairs_of = F.col("n") * (F.col("n") - 1) / 2
    below = F.sqrt((pairs_of - F.col("ta")) * (pairs_of - F.col("tb")))
    return sums.select(*keys, F.try_divide(pairs_of - F.col("ta") - F.col("tb") + F.col("tab") - 2 * F.col("against"), below).alias("r"))


def _inversions(v: np.ndarray) -> tuple[float, np.ndarray]:
    """How many pairs stand in falling order, and the values sorted: what merging sorted halves counts."""
    if len(v) <= 64:
        return float(np.triu(v[:, None] > v[None, :], 1).sum()), np.sort(v)
    (m, left), (n, right) = _inversions(v[: len(v) // 2]), _inversions(v[len(v) // 2 :])
    after = (len(left) - np.searchsorted(left, right, side="right")).sum()
    return m + n + float(after), np.sort(np.concatenate([left, right]), kind="stable")


def corr(x: DataFrame, layer: str = "value", method: str = "pearson") -> DataFrame:
    """obs_i, obs_j, r for every pair of samples, over the features both have; pearson, spearman or kendall."""
    if method == "pearson":
        half = _correlated(_pairs(x, layer))
    elif method == "spearman":
        half = _correlated(_ranked(_pairs(_with_range(x, layer), layer)))
    elif method == "kendall":
        half = _taus(_pairs(_with_range(x, layer), layer))
    else:
        raise ValueError(f"method is {method!r}; it can be pearson, spearman or kendall")
    return half.unionByName(half.where("obs_i <> obs_j").select(F.col("obs_j").alias("obs_i"), F.col("obs_i").alias("obs_j"), "r"))


def gram(x: DataFrame, layer: str = "value") -> DataFrame:
    """obs_i, obs_j (i <= j), g: inner products of samples over centred features that all samples have."""
    mean = x.groupBy("var_id").agg(F.avg(layer).alias("_m"))
    centred = x.join(mean, "var_id").withColumn(layer, F.col(layer) - F.col("_m"))
    return _pairs(centred, layer).groupBy("obs_i", "obs_j").agg(F.sum(F.col("a") * F.col("b")).alias("g"))


def pca(x: DataFrame, layer: str = "value", n_components: int | None = None, svd_solver: str = "auto", random_state: int = 0) -> dict:
    """Components from the samples' Gram matrix, as samples are few and features many.

    Gives scores (obs_id, PC_1 ...), loadings (var_id, PC_1 ...), variance and variance_ratio. Features that a sample
    lacks are left out. A component's sign makes its largest loading positive. The solver and seed are accepted for compatibility; the
    result is exact.
    """
    spark = x.sparkSession
    names = [r.obs_id for r in x.select("obs_id").distinct().orderBy("obs_id").limit(MOST_SAMPLES + 1).collect()]
    if len(names) > MOST_SAMPLES:
        raise ValueError(f"more than {MOST_SAMPLES} samples: their matrix would be gathered on the driver")
    whole = complete_features(x.where(F.col(layer).isNotNull()), len(names))
    place = {o: i for i, o in enumerate(names)}
    g = np.zeros((len(names), len(names)))
    for r in gram(whole, layer).collect():
        g[place[r.obs_i], place[r.obs_j]] = g[place[r.obs_j], place[r.obs_i]] = r.g
    values, vectors = np.linalg.eigh(g)
    order = np.argsort(values)[::-1]
    values, vectors = np.maximum(values[order], 0), vectors[:, order]
    n = min(n_components or len(names), max(len(names) - 1, 1))
    single = np.sqrt(values[:n])
    scores = vectors[:, :n] * single
    total = values.sum()
    columns = [f"PC_{k + 1}" for k in range(n)]
    # Loadings: centred values times the scaled sample vectors, summed by feature.
    weights = vectors[:, :n] / np.where(single > 1e-12, single, np.inf)
    w = spark.createDataFrame([(o, *map(float, weights[i])) for o, i in place.items()], "obs_id string, " + ", ".join(f"{c} double" for c in columns))
    mean = whole.groupBy("var_id").agg(F.avg(layer).alias("_m"))
    loadings = whole.join(mean, "var_id").join(F.broadcast(w), "obs_id").groupBy("var_id").agg(*(F.sum((F.col(layer) - F.col("_m")) * F.col(c)).alias(c) for c in columns))
    extreme = loadings.agg(*(F.max_by(c, F.struct(F.abs(c), F.col("var_id"))).alias(c) for c in columns)).first()
    sign = [-1.0 if extreme[c] is not None and extreme[c] < 0 else 1.0 for c in columns]
    loadings = loadings.select("var_id", *((F.col(c) * s).alias(c) for c, s in zip(columns, sign, strict=True)))
    table = spark.createDataFrame([(o, *(float(scores[i, k] * sign[k]) for k in range(n))) for o, i in place.items()], "obs_id string, " + ", ".join(f"{c} double" for c in columns))
    below = max(len(names) - 1, 1)
    return {"scores": table, "loadings": loadings, "variance": (values[:n] / below).tolist(), "variance_ratio": (values[:n] / total if total else values[:n]).tolist(), "n_components": n}


def umap(x: DataFrame, layer: str = "value", n_neighbors: int = 15, n_components: int = 2, min_dist: float = 0.1, epochs: int = 300, random_state: int = 0) -> DataFrame:
    """obs_id, UMAP_1 ...: a layout of samples by their fuzzy neighbour graph.

    Distances come from the distributed Gram matrix; the layout of at most ``MOST_SAMPLES`` points runs on the driver:
    attraction along graph edges and repulsion from all others, from the principal components.
    """
    spark = x.sparkSession
    parts = pca(x, layer)
    rows = parts["scores"].orderBy("obs_id").collect()
    names = [r.obs_id for r in rows]
    points = np.array([list(r)[1:] for r in rows], float).reshape(len(names), -1)
    n = len(names)
    inner = points @ points.T  # n x n is all that distances need
    d = np.sqrt(np.maximum(np.diag(inner)[:, None] + np.diag(inner)[None] - 2 * inner, 0))
    np.fill_diagonal(d, 0)
    k = min(n_neighbors, n - 1)
    weight = np.zeros((n, n))
    for i in range(n if k > 0 else 0):
        near = np.argsort(np.where(np.arange(n) == i, -1, d[i]), kind="stable")[1 : k + 1]
        rho = d[i, near[0]]
        low, high = 1e-9, max(d[i, near[-1]], 1e-6) * 10
        for _ in range(50):
            mid = (low + high) / 2
            low, high = (low, mid) if np.exp(-np.maximum(d[i, near] - rho, 0) / mid).sum() > np.log2(k + 1) else (mid, high)
        weight[i, near] = np.exp(-np.maximum(d[i, near] - rho, 0) / high)
    weight = weight + weight.T - weight * weight.T
    rng = np.random.default_rng(random_state)
    y = np.zeros((n, n_components))
    m = min(n_components, points.shape[1])
    y[:, :m] = points[:, :m] / max(np.abs(points[:, :m]).max(initial=0), 1e-12) * 10 + rng.normal(0, 1e-2, (n, m))
    for t in range(epochs):
        gap = y[:, None] - y[None]
        square = (gap**2).sum(-1)
        pull = weight * -2 / (1 + square) * (square > min_dist**2)
        push = (1 - weight) * 2 / ((0.01 + square) * (1 + square)) / max(n, 1)
        step = np.clip(((pull + push)[:, :, None] * gap).sum(1), -4, 4)
        y += 0.5 * (1 - t / epochs) * step
    columns = [f"UMAP_{c + 1}" for c in range(n_components)]
    return spark.createDataFrame([(o, *map(float, y[i])) for i, o in enumerate(names)], "obs_id string, " + ", ".join(f"{c} double" for c in columns))


@logged
def add_corr(study: Study, modality: str, layer: str = "value", method: str = "pearson") -> Study:
    """Keep the samples' correlation as ``X_corr`` of the assay."""
    return _with(study, modality, X_corr=corr(study[modality].x, layer, method))


@logged
def add_pca(study: Study, modality: str, layer: str = "value", n_components: int | None = None, key_added: str = "X_pca", **options) -> Study:
    """Keep scores under ``key_added``, loadings as ``PCs`` and each component's variance as ``{key_added}_variance``."""
    out = pca(study[modality].x, layer, n_components, **options)
    rows = [(f"PC_{i + 1}", float(v), float(r)) for i, (v, r) in enumerate(zip(out["variance"], out["variance_ratio"], strict=True))]
    variance = study.obs.sparkSession.createDataFrame(rows, "component string, variance double, variance_ratio double")
    return _with(study, modality, **{key_added: out["scores"], "PCs": out["loadings"], f"{key_added}_variance": variance})


@logged
def add_umap(study: Study, modality: str, layer: str = "value", key_added: str = "X_umap", **options) -> Study:
    return _with(study, modality, **{key_added: umap(study[modality].x, layer, **options)})


def _with(study: Study, modality: str, **tables: DataFrame) -> Study:
    assay = study[modality]
    return study.with_assay(modality, assay.with_(extra={**assay.extra, **tables}))
