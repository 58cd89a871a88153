"""Merging studies, adding levels and values from other tools."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.peptide import zero_to_null
from ..model import Assay, Study, logged


def merge_studies(studies: dict[str, Study]) -> Study:
    """One study of all samples: obs and PSM features are tagged by dataset, features shared by name keep their first known values."""
    if not studies:
        raise ValueError("no studies to merge")
    union = lambda frames: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    obs = union([s.obs.withColumn("dataset", F.lit(k)).withColumn("obs_ord", F.col("obs_ord") + i * 1_000_000) for i, (k, s) in enumerate(studies.items())])
    assays: dict[str, Assay] = {}
    for name in dict.fromkeys(n for s in studies.values() for n in s.assays):
        own = [(i, k, s[name]) for i, (k, s) in enumerate(studies.items()) if name in s.assays]
        if len({a.label for _, _, a in own}) > 1 or len({a.level for _, _, a in own}) > 1:
            raise ValueError(f"{name}: labels or levels differ between studies")

        def combined(frames: list[tuple[int, str, DataFrame]]) -> DataFrame:
            rows = union([(df.withColumn("dataset", F.lit(k)) if name == "psm" else df).withColumn("_nth", F.lit(i)) for i, k, df in frames])
            rest = [c for c in rows.columns if c not in ("var_id", "_nth")]
            return rows.groupBy("var_id").agg(*(F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("_nth"))).alias(c) for c in rest))

        var = combined([(i, k, a.var) for i, k, a in own])
        decoys = [(i, k, a.decoy) for i, k, a in own if a.decoy is not None]
        assays[name] = Assay(union([a.x for _, _, a in own]), var, combined(decoys) if decoys else None, own[0][2].level, own[0][2].label, own[0][2].engine)
    tables: dict[str, DataFrame] = {}
    for name in dict.fromkeys(n for s in studies.values() for n in s.tables):
        frames = [s.tables[name] for s in studies.values() if name in s.tables]
        if len({tuple(sorted(f.columns)) for f in frames}) > 1:
            raise ValueError(f"table {name} has different columns in the studies")
        tables[name] = union(frames).distinct()
    return Study(assays, obs, tables, tuple(e for s in studies.values() for e in s.log))


@logged
def add_modality(study: Study, name: str, assay: Assay, parents: list[str]) -> Study:
    if not parents:
        raise ValueError("a new assay needs the names of its parents")
    if missing := [p for p in parents if p not in study.assays]:
        raise ValueError(f"no such parents: {missing}")
    return study.with_assay(name, assay)


def unpivoted(wide: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """keys, obs_id, value from one column a sample; zeros and NaN are missing and give no row."""
    cast = wide.select(*keys, *(F.col(f"`{c}`").cast("double").alias(o) for c, o in columns.items()))
    long = cast.unpivot(keys, list(columns.values()), "obs_id", "value")
    return long.withColumn("value", zero_to_null(F.col("value"))).where("value is not null")


@logged
def add_quant(study: Study, quant: DataFrame, quant_tool: str, index_name: str = "Sequence") -> Study:
    """Peptide values of FlashLFQ (``Intensity_*`` columns); other tools change nothing."""
    if quant_tool != "flashlfq":
        return study
    columns = {c: c.removeprefix("Intensity_") for c in quant.columns if c.startswith("Intensity_")}
    rows = quant.withColumnRenamed(index_name, "var_id")
    x = unpivoted(rows, ["var_id"], columns).join(F.broadcast(study.obs.select("obs_id")), "obs_id", "left_semi")
    if "peptide" in study.assays:
        return study.with_assay("peptide", study["peptide"].with_(x=x))
    var = x.select("var_id").distinct().withColumn("peptide", F.col("var_id")).withColumn("var_ord", F.xxhash64("var_id"))
    return study.with_assay("peptide", Assay(x, var, None, "peptide", study.label()))


def with_order(df: DataFrame, column: str, order: str) -> DataFrame:
    """Add ``{column}_ord``: the place of a value among all by its first appearance in ``order``."""
    first = df.groupBy(column).agg(F.min(order).alias("_o"))
    places = first.select(F.col(column).alias("_c"), (F.row_number().over(Window.orderBy("_o")) - 1).alias(f"{column}_ord"))  # a row for each category
    return df.join(places, F.col(column).eqNullSafe(F.col("_c")), "left").drop("_c")
