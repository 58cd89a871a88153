"""Batch correction of measurements in long form."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranges import wide_median
from ..model import Study, logged

METHODS = ("gis", "median_center", "combat", "continuous")


def coded(obs: DataFrame, category: str) -> DataFrame:
    """obs_id, batch (the category) and code: its place among the sorted categories, from 0."""
    rows = obs.select("obs_id", F.col(category).alias("batch"))
    return rows.withColumn("code", F.dense_rank().over(Window.orderBy("batch")) - 1)  # a row for each sample


def _corrected(x: DataFrame, factor: str, layer: str, log_transformed: bool) -> DataFrame:
    made = F.col(layer) - F.col(factor) if log_transformed else F.try_divide(F.col(layer), F.col(factor))
    return x.withColumn(layer, made).drop(factor)


def by_standard(x: DataFrame, batches: DataFrame, standards: list[str], layer: str = "value", log_transformed: bool = True) -> DataFrame:
    """Take out the batch's mean of the internal standard samples, feature by feature; without one the value is missing."""
    x = x.join(F.broadcast(batches.select("obs_id", "batch")), "obs_id")
    mean = x.where(F.col("obs_id").isin(standards)).groupBy("batch", "var_id").agg(F.avg(layer).alias("_f"))
    return _corrected(x.join(mean, ["batch", "var_id"], "left"), "_f", layer, log_transformed).drop("batch")


def by_median(x: DataFrame, batches: DataFrame, layer: str = "value", log_transformed: bool = True) -> DataFrame:
    x = x.join(F.broadcast(batches.select("obs_id", "batch")), "obs_id")
    centre = x.groupBy("batch", "var_id").agg(F.median(layer).alias("_f"))
    return _corrected(x.join(centre, ["batch", "var_id"]), "_f", layer, log_transformed).drop("batch")


def lowess(x: np.ndarray, y: np.ndarray, frac: float = 0.8, robust: int = 3) -> np.ndarray:
    """Locally weighted linear fit at each x: tricube weights of the nearest ``frac`` of the points, then ``robust`` bisquare rounds."""
    return lowess_rows(x[None], y[None], frac, robust)[0]


def lowess_rows(x: np.ndarray, y: np.ndarray, frac: float = 0.8, robust: int = 3) -> np.ndarray:
    """``lowess`` of each row of x and y."""
    n = x.shape[1]
    k = min(n, max(2, int(frac * n + 1e-10)))
    distance = np.abs(x[:, :, None] - x[:, None, :])
    reach = np.sort(distance, axis=2)[:, :, k - 1, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        near = np.where(reach > 0, distance / reach, np.where(distance > 0, 1.0, 0.0))
    weight = np.where(near < 0.999, (1 - np.minimum(near, 1) ** 3) ** 3, 0.0)
    weight[near < 0.001] = 1.0
    spread = ((np.ptp(x, axis=1) * 0.001) ** 2)[:, None]
    fits, left = np.zeros(x.shape), np.arange(len(x))
    extra = np.ones(x.shape)
    for _ in range(robust + 1):
        w = weight * extra[:, None, :]
        total = w.sum(axis=2)
        total = np.where(total > 0, total, 1.0)
        mx, my = (w * x[:, None, :]).sum(axis=2) / total, (w * y[:, None, :]).sum(axis=2) / total
        off = x[:, None, :] - mx[:, :, None]
        sxx, sxy = (w * off**2).sum(axis=2) / total, (w * off * y[:, None, :]).sum(axis=2) / total
        slope = np.where(sxx > spread, sxy / np.where(sxx > spread, sxx, 1.0), 0.0)
        fit = my + slope * (x - mx)
        fits[left] = fit
        residual = np.abs(y - fit)
        middle = np.median(residual, axis=1)
        go = middle >= 1e-12
        if not go.any():
            break
        left, x, y, weight, spread = left[go], x[go], y[go], weight[go], spread[go]
        extra = (1 - np.minimum(residual[go] / (6 * middle[go, None]), 1) ** 2) ** 2
    return fits


#: Weights (features x samples x samples) that a worker fits at a time; a feature of more samples is fitted alone.
MOST_WEIGHTS = 1_000_000


def by_lowess(x: DataFrame, batches: DataFrame, layer: str = "value", log_transformed: bool = True, frac: float = 0.8) -> DataFrame:
    """Take out a smooth trend over the batch codes, feature by feature. A feature has at most a value a sample.

    Features come sorted, so that a worker fits many of one size at once.
    """
    rows = x.join(F.broadcast(batches.select("obs_id", "code")), "obs_id").where(F.col(layer).isNotNull())

    def fitted(own: pd.DataFrame) -> pd.DataFrame:
        names, code, value = own["var_id"].to_numpy(), own["code"].to_numpy(float), own[layer].to_numpy(float)
        start = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
        size, fit = np.diff(np.r_[start, len(own)]), np.empty(len(own))
        for n in np.unique(size):
            at = start[size == n]
            step = max(1, MOST_WEIGHTS // int(n * n))
            for k in range(0, len(at), step):
                places = at[k : k + step, None] + np.arange(n)
                fit[places] = lowess_rows(code[places], value[places], frac)
        return own.assign(_f=fit)

    def of_batches(parts):
        rest = None
        for p in parts:
            p = p[p[layer].notna()]
            p = p if rest is None or not len(rest) else pd.concat([rest, p], ignore_index=True)
            if not len(p):
                continue
            # The last feature of a batch may go on in the next one.
            whole = int((p["var_id"] != p["var_id"].iloc[-1]).to_numpy().sum())
            rest = p.iloc[whole:]
            if whole:
                yield fitted(p.iloc[:whole])
        if rest is not None and len(rest):
            yield fitted(rest)

    fields = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    ordered = rows.repartition("var_id").sortWithinPartitions("var_id", "code", "obs_id")
    return _corrected(ordered.mapInPandas(of_batches, f"{fields}, _f double"), "_f", layer, log_transformed).drop("code")


def combat(x: DataFrame, batches: DataFrame, layer: str = "value", rounds: int = 100, tolerance: float = 1e-4) -> DataFrame:
    """Parametric empirical-Bayes adjustment of location and scale (Johnson, Li and Rabinovic 2007).

    Features are standardised by their batch-weighted mean and pooled variance; each batch's location and
    scale effects get priors from all features, as two moments a batch, and the posterior of a feature is
    iterated in a Pandas UDF over (batch, feature) rows, without moving measurements.
    """
    rows = x.where(F.col(layer).isNotNull()).join(F.broadcast(batches.select("obs_id", "batch")), "obs_id")
    cell = rows.groupBy("batch", "var_id").agg(F.count("*").alias("n"), F.avg(layer).alias("m"), F.var_pop(layer).alias("v"))
    size = cell.groupBy("var_id").agg(F.sum("n").alias("total"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"), (F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("pooled"))
    effect = cell.join(size.where("pooled > 0"), "var_id").select("batch", "var_id", "n", "grand", F.sqrt("pooled").alias("sd"), ((F.col("m") - F.col("grand")) / F.sqrt("pooled")).alias("g"), (F.col("n") * F.col("v") / F.col("pooled") / F.greatest(F.col("n") - 1, F.lit(1))).alias("d"))
    many = F.col("n") > 1
    prior = effect.groupBy("batch").agg(F.avg("g").alias("g0"), F.var_samp("g").alias("t2"), F.avg(F.when(many, F.col("d"))).alias("dm"), F.var_samp(F.when(many, F.col("d"))).alias("ds"))
    prior = prior.select("batch", "g0", F.coalesce("t2", F.lit(0.0)).alias("t2"), ((2 * F.col("ds") + F.col("dm") ** 2) / F.col("ds")).alias("a"), ((F.col("dm") * F.col("ds") + F.col("dm") ** 3) / F.col("ds")).alias("b"))

    def posterior(parts):
        for p in parts:
            n, g, d, g0, t2, a, b = (p[c].to_numpy(float) for c in ("n", "g", "d", "g0", "t2", "a", "b"))
            has = np.isfinite(a) & np.isfinite(b) & (n > 1)
            gs, ds = g.copy(), np.where(n > 1, d, 1.0)
            for _ in range(rounds):
                new_g = np.where(t2 > 0, (t2 * n * g + ds * g0) / np.where(t2 * n + ds > 0, t2 * n + ds, 1.0), g0)
                total = (n - 1) * d + n * (g - new_g) ** 2
                new_d = np.where(has, (0.5 * total + np.where(has, b, 0)) / (n / 2 + np.where(has, a, 1) - 1), ds)
                change = max(np.max(np.abs(new_g - gs) / np.maximum(np.abs(gs), 1e-12), initial=0), np.max(np.abs(new_d - ds) / np.maximum(ds, 1e-12), initial=0))
                gs, ds = new_g, new_d
                if change < tolerance:
                    break
            yield pd.DataFrame({"batch": p["batch"], "var_id": p["var_id"], "grand": p["grand"], "sd": p["sd"], "gs": gs, "ds": ds})

    kind = dict(effect.dtypes)["batch"]
    key = dict(effect.dtypes)["var_id"]
    post = effect.join(F.broadcast(prior), "batch").mapInPandas(posterior, f"batch {kind}, var_id {key}, grand double, sd double, gs double, ds double")
    out = rows.join(post, ["batch", "var_id"], "left")
    z = (F.col(layer) - F.col("grand")) / F.col("sd")
    made = F.try_divide(z - F.col("gs"), F.sqrt("ds")) * F.col("sd") + F.col("grand")
    return out.withColumn(layer, F.coalesce(made, F.col(layer))).select(*x.columns)


@logged
def correct_batch_effect(study: Study, modality: str, method: str, category: str, layer: str = "value", gis_samples: list[str] | None = None, drop_gis: bool = True, rescale: bool = True, log_transformed: bool = True) -> Study:
    """Correct one assay; with ``rescale`` its former median is added (not for combat)."""
    if method not in METHODS:
        raise ValueError(f"method is {method!r}; it can be one of {', '.join(METHODS)}")
    assay, batches = study[modality], coded(study.obs, category)
    if method == "gis":
        known = {r.obs_id for r in study.obs.select("obs_id").collect()}
        if not gis_samples or (unknown := set(gis_samples) - known):
            raise ValueError(f"gis_samples must name samples; unknown: {sorted(unknown) if gis_samples else 'none given'}")
        x = by_standard(assay.x, batches, list(gis_samples), layer, log_transformed)
    elif method == "median_center":
        x = by_median(assay.x, batches, layer, log_transformed)
    elif method == "continuous":
        x = by_lowess(assay.x, batches, layer, log_transformed)
    else:
        x = combat(assay.x, batches, layer)
    if rescale and method != "combat":
        x = x.crossJoin(F.broadcast(wide_median(assay.x, layer, name="_g"))).withColumn(layer, F.col(layer) + F.col("_g")).drop("_g")
    study = study.with_assay(modality, assay.with_(x=x.select(*assay.x.columns)))
    if method == "gis" and drop_gis:
        keep = ~F.col("obs_id").isin(list(gis_samples))
        study = study.with_(obs=study.obs.where(keep), assays={k: a.with_(x=a.x.where(keep)) for k, a in study.assays.items()})
    return study
