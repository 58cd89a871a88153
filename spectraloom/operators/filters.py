"""Predicates over features, and operators that keep part of a study."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Assay, Study, logged

KEEPS = ("eq", "ne", "lt", "le", "gt", "ge", "contains", "not_contains")


def predicate(column: str, keep: str, value) -> Column:
    """A predicate that is never NULL: missing values fail it, except that they are ``ne`` to any value.

    ``contains`` and ``not_contains`` take a regular expression.
    """
    c, v = F.col(column), F.lit(value)
    made = {
        "eq": lambda: c == v,
        "ne": lambda: ~c.eqNullSafe(v),
        "lt": lambda: c < v,
        "le": lambda: c <= v,
        "gt": lambda: c > v,
        "ge": lambda: c >= v,
        "contains": lambda: c.cast("string").rlike(str(value)),
        "not_contains": lambda: ~c.cast("string").rlike(str(value)),
    }
    if keep not in made:
        raise ValueError(f"keep is {keep!r}; it can be one of {', '.join(KEEPS)}")
    return F.coalesce(made[keep](), F.lit(False))


@logged
def add_filter(study: Study, modality: str, column: str, keep: str, value) -> Study:
    """Register the filter ``{column}_{keep}_{value}``; nothing is computed until ``apply_filter``."""
    assay = study[modality]
    if column not in assay.var.columns:
        raise ValueError(f"{modality} has no column {column}")
    return study.with_assay(modality, assay.with_(filters=(*assay.filters, (f"{column}_{keep}_{value}", predicate(column, keep, value)))))


def filter_columns(assay: Assay) -> DataFrame:
    """var_id and a boolean column for each registered filter."""
    return assay.var.select("var_id", *(p.alias(name) for name, p in assay.filters))


def _semi(x: DataFrame, var: DataFrame) -> DataFrame:
    return x.join(var.select("var_id"), "var_id", "left_semi")


@logged
def apply_filter(study: Study, modality: str) -> Study:
    """Keep features, decoys and measurements that pass all registered filters."""
    assay = study[modality]
    if not assay.filters:
        raise ValueError(f"{modality} has no registered filter")
    passes = reduce(lambda a, b: a & b, (p for _, p in assay.filters))
    var = assay.var.where(passes)
    decoy = assay.decoy.where(passes) if assay.decoy is not None else None
    return study.with_assay(modality, assay.with_(var=var, decoy=decoy, x=_semi(assay.x, var), filters=()))


@logged
def subset(study: Study, modality: str | None = None, cond_var: str | None = None, cond_obs: str | None = None) -> Study:
    """Keep features of ``modality`` and samples for which a boolean SQL expression is true."""
    if cond_var is not None:
        if modality is None:
            raise ValueError("cond_var needs a modality")
        var = study[modality].var.where(F.expr(cond_var))
        study = study.with_assay(modality, study[modality].with_(var=var, x=_semi(study[modality].x, var)))
    if cond_obs is not None:
        obs = study.obs.where(F.expr(cond_obs))
        keep = obs.select("obs_id")
        study = study.with_(obs=obs, assays={k: a.with_(x=a.x.join(keep, "obs_id", "left_semi")) for k, a in study.assays.items()})
    return study


@logged
def split_sets(study: Study, sets: dict[str, str], modality: str = "psm") -> Study:
    """Samples of a multiplexed study by set: a measurement of file f moves to sample ``{obs_id}_{sets[f]}``."""
    assay = study[modality]
    pairs = F.create_map(*(F.lit(x) for kv in sets.items() for x in kv))
    of = assay.var.select("var_id", F.element_at(pairs, F.col("filename")).alias("set"))
    x = assay.x.join(of, "var_id").where(F.col("set").isNotNull()).withColumn("obs_id", F.concat_ws("_", "obs_id", "set")).drop("set")
    names = sorted(set(sets.values()))
    obs = study.obs.crossJoin(F.broadcast(study.obs.sparkSession.createDataFrame([(s, i) for i, s in enumerate(names)], "set string, set_ord int")))
    obs = obs.withColumn("obs_id", F.concat_ws("_", "obs_id", "set")).withColumn("obs_ord", F.col("set_ord") * 10_000 + F.col("obs_ord")).drop("set_ord")
    return study.with_(obs=obs).with_assay(modality, assay.with_(x=x))


@logged
def reindex_obs(study: Study, column: str) -> Study:
    """Name samples by another column of ``obs``."""
    names = study.obs.select("obs_id", F.col(column).cast("string").alias("_new"))
    assays = {k: a.with_(x=a.x.join(names, "obs_id").withColumn("obs_id", F.col("_new")).drop("_new")) for k, a in study.assays.items()}
    obs = study.obs.withColumn("obs_id", F.col(column).cast("string"))
    return study.with_(obs=obs, assays=assays)


def complete_features(x: DataFrame, n_obs: int) -> DataFrame:
    """Measurements of the features that every sample has."""
    whole = x.groupBy("var_id").agg(F.count("value").alias("n")).where(F.col("n") == n_obs).select("var_id")
    return x.join(whole, "var_id", "left_semi")
