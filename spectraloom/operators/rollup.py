"""Roll-up of measurements and identifications to a higher level.

One shuffle by group for identifications, one by (group, sample) for values; the ranking of
features adds a window on the group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranges import average_rank
from ..model import Assay, Study, logged
from . import fdr

METHODS = {"median": F.median, "mean": F.avg, "sum": F.sum}
RANKS = {"total_intensity": F.sum, "max_intensity": F.max, "median_intensity": F.median, "mean_intensity": F.avg}


def values_by_group(x: DataFrame, group: str | Sequence[str], method: str = "median") -> DataFrame:
    """group, obs_id, value: missing values are left out, a group without any is missing (also for sums)."""
    if method not in METHODS:
        raise ValueError(f"agg_method is {method!r}; it can be one of {', '.join(METHODS)}")
    keys = [group] if isinstance(group, str) else list(group)
    return x.where("value is not null").groupBy(*keys, "obs_id").agg(METHODS[method]("value").alias("value"))


def with_missing_as_zero(values: DataFrame, group: str, groups: DataFrame, obs: DataFrame) -> DataFrame:
    """Every (group, sample): sums of nothing as 0."""
    grid = groups.select(group).distinct().crossJoin(F.broadcast(obs.select("obs_id")))
    return grid.join(values, [group, "obs_id"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def feature_ranks(x: DataFrame, var: DataFrame, group: str, method: str = "median_intensity") -> DataFrame:
    """var_id, group, rank: the rank of each feature in its group by intensity over samples, ties with their mean rank."""
    if method not in RANKS:
        raise ValueError(f"rank_method is {method!r}; it can be one of {', '.join(RANKS)}")
    scores = x.groupBy("var_id").agg(RANKS[method]("value").alias("score"))
    if method == "total_intensity":
        scores = var.select("var_id", group).join(scores, "var_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    else:
        scores = var.select("var_id", group).join(scores, "var_id", "left")
    rank = average_rank([group], "score", descending=True)
    return scores.select("var_id", group, F.when(F.col("score").isNotNull(), rank).alias("rank"))


def top_features(x: DataFrame, var: DataFrame, group: str, top_n: int, method: str = "median_intensity") -> DataFrame:
    """Measurements of the features whose rank in their group is at most ``top_n``."""
    keep = feature_ranks(x, var, group, method).where(F.col("rank") <= top_n).select("var_id")
    return x.join(keep, "var_id", "left_semi")


def mask_values(x: DataFrame, var: DataFrame, predicates: list[Column]) -> DataFrame:
    """Values of features that pass any of the predicates; the others become missing."""
    passes = predicates[0]
    for p in predicates[1:]:
        passes = passes | p
    return x.join(var.where(passes).select("var_id"), "var_id", "left_semi")


def best_pep() -> Column:
    return F.min("PEP")


def picked_score() -> Column:
    return -F.log10(F.min("PEP") + F.lit(1e-10))


def peptide_rows(var: DataFrame) -> DataFrame:
    """One row a peptide: first proteins and stripped sequence by var_ord, number of PSMs, least PEP."""
    first = lambda c: F.min_by(c, "var_ord").alias(c)
    aggs = [first(c) for c in ("proteins", "stripped_peptide", "protein_group", "peptide_type") if c in var.columns]
    aggs += [F.count("*").alias("count_psm"), F.min("var_ord").alias("var_ord")]
    if "PEP" in var.columns:
        aggs.append(best_pep().alias("PEP"))
    return var.groupBy("peptide").agg(*aggs)


def protein_rows(var: DataFrame) -> DataFrame:
    aggs = [F.sum("count_psm").alias("count_psm"), F.countDistinct("stripped_peptide").alias("count_stripped_peptide"), F.min("var_ord").alias("var_ord")]
    if "PEP" in var.columns:
        aggs.append(best_pep().alias("PEP"))
    return var.groupBy("protein_group").agg(*aggs)


def _with_q(var: DataFrame, decoy: DataFrame | None, key: str, calculate: bool) -> tuple[DataFrame, DataFrame | None]:
    if decoy is None or not calculate or "PEP" not in var.columns:
        return var, decoy
    both = var.select(key, "PEP", F.lit(False).alias("is_decoy")).unionByName(decoy.select(key, "PEP", F.lit(True).alias("is_decoy")))
    q = fdr.target_decoy(both, "PEP", "is_decoy", key).select(key, "is_decoy", "q_value")
    add = lambda df, flag: df.drop("q_value").join(q.where(F.col("is_decoy") == flag).drop("is_decoy"), key, "left")
    return add(var, False), add(decoy, True)


def _keyed(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn("var_id", F.col(key))


@logged
def to_peptide(study: Study, layer: str = "value", agg_method: str = "median", purity_threshold: float | None = 0.7, top_n: int | None = None, rank_method: str = "median_intensity", calculate_q: bool = True) -> Study:
    """PSMs to peptides.

    For isobaric labels with a purity column, values of PSMs at or below the threshold are left out;
    their identifications stay. If PSMs have no values but the study already has peptide values, those of identified peptides are kept.
    """
    psm = study["psm"]
    rows = peptide_rows(psm.var)
    decoy = peptide_rows(psm.decoy) if psm.decoy is not None else None
    rows, decoy = _with_q(rows, decoy, "peptide", calculate_q)
    if "peptide" in study.assays and not psm.has_quant():
        x = study["peptide"].x.join(rows.select(F.col("peptide").alias("var_id")), "var_id", "left_semi")
    else:
        x = psm.x.withColumn("value", F.col(layer))
        if purity_threshold is not None and psm.label == "tmt" and psm.has_purity:
            x = mask_values(x, psm.var, [F.col("purity") > purity_threshold])
        if top_n is not None:
            x = top_features(x, psm.var, "peptide", top_n, rank_method)
        x = values_by_group(x.join(psm.var.select("var_id", "peptide"), "var_id"), "peptide", agg_method).withColumnRenamed("peptide", "var_id")
    return study.with_assay("peptide", Assay(x, _keyed(rows, "peptide"), _keyed(decoy, "peptide") if decoy is not None else None, "peptide", psm.label, psm.engine))


@logged
def to_protein(study: Study, layer: str = "value", agg_method: str = "median", top_n: int | None = 3, rank_method: str = "median_intensity", calculate_q: bool = True) -> Study:
    """Unique peptides to protein groups; the peptide level stays as it is."""
    pep = study["peptide"]
    if "peptide_type" not in pep.var.columns:
        raise ValueError("run infer_protein first")
    unique = F.col("peptide_type") == "unique"
    var = pep.var.where(unique)
    decoy = pep.decoy.where(unique) if pep.decoy is not None and "peptide_type" in pep.decoy.columns else None
    rows, bad = _with_q(protein_rows(var), protein_rows(decoy) if decoy is not None else None, "protein_group", calculate_q)
    x = pep.x.withColumn("value", F.col(layer)).join(var.select("var_id"), "var_id", "left_semi")
    if top_n is not None:
        x = top_features(x, var, "protein_group", top_n, rank_method)
    x = values_by_group(x.join(var.select("var_id", "protein_group"), "var_id"), "protein_group", agg_method).withColumnRenamed("protein_group", "var_id")
    return study.with_assay("protein", Assay(x, _keyed(rows, "protein_group"), _keyed(bad, "protein_group") if bad is not None else None, "protein", pep.label, pep.engine))
