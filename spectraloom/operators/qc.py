"""Tables behind quality-control plots: counts, bins, box statistics, missingness, overlaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import multivariate


def describe(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """count, mean, std, min, quartiles, max of a column by ``keys``."""
    q = F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = df.where(F.col(column).isNotNull()).groupBy(*keys).agg(F.count(column).alias("count"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("min"), q.alias("q"), F.max(column).alias("max"))
    return out.select(*keys, "count", "mean", "std", "min", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "max")


def box(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """``describe`` with fences 1.5 interquartile ranges beyond the quartiles, inside the data's range."""
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    return describe(df, keys, column).withColumn("lower_fence", F.greatest(F.col("min"), F.col("q1") - reach)).withColumn("upper_fence", F.least(F.col("max"), F.col("q3") + reach))


def histogram(df: DataFrame, column: str, bins: int, keys: tuple = ()) -> DataFrame:
    """keys, bin (from 1), left, right, n, frequency (percent of all rows): equal bins from least to largest value.

    Bins are closed on the right, the first on both sides; empty ones are kept.
    """
    rows = df.where(F.col(column).isNotNull()).select(*keys, F.col(column).cast("double").alias("_v"))
    span = rows.agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_all")).withColumn("_w", (F.col("_hi") - F.col("_lo")) / bins)
    number = F.when(F.col("_w") > 0, F.least(F.lit(bins), F.greatest(F.lit(1), F.ceil((F.col("_v") - F.col("_lo")) / F.col("_w"))))).otherwise(1).cast("int")
    counts = rows.crossJoin(F.broadcast(span)).groupBy(*keys, number.alias("bin")).agg(F.count("*").alias("n"))
    edges = span.select("*", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    grid = rows.select(*keys).distinct().crossJoin(F.broadcast(edges)) if keys else edges
    out = grid.join(counts, [*keys, "bin"], "left")
    n = F.coalesce("n", F.lit(0))
    return out.select(*keys, "bin", (F.col("_lo") + (F.col("bin") - 1) * F.col("_w")).alias("left"), (F.col("_lo") + F.col("bin") * F.col("_w")).alias("right"), n.alias("n"), (n * 100.0 / F.col("_all")).alias("frequency"))


def present(x: DataFrame, obs: DataFrame, group: str) -> DataFrame:
    """group, var_id of features measured in any of the group's samples."""
    return x.where("value is not null").join(F.broadcast(obs.select("obs_id", F.col(group).alias("group"))), "obs_id").select("group", "var_id").distinct()


def id_counts(x: DataFrame, obs: DataFrame, group: str) -> DataFrame:
    return present(x, obs, group).groupBy("group").agg(F.count("*").alias("n"))


def var_counts(x: DataFrame, var: DataFrame, obs: DataFrame, group: str, column: str) -> DataFrame:
    """group, column, n: features of the group by a feature column."""
    return present(x, obs, group).join(var.select("var_id", column), "var_id").groupBy("group", column).agg(F.count("*").alias("n"))


def var_box(x: DataFrame, var: DataFrame, obs: DataFrame, group: str, column: str) -> DataFrame:
    return box(present(x, obs, group).join(var.select("var_id", column), "var_id"), ["group"], column)


def var_histogram(x: DataFrame, var: DataFrame, obs: DataFrame, group: str, column: str, bins: int = 30) -> DataFrame:
    return histogram(present(x, obs, group).join(var.select("var_id", column), "var_id"), column, bins, ("group",))


def plot_type(var: DataFrame, column: str) -> str:
    """box for a numeric column with more than 20 values, else stack."""
    numeric = dict(var.dtypes)[column].split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
    return "box" if numeric and var.agg(F.countDistinct(column)).first()[0] > 20 else "stack"


def _grouped(x: DataFrame, obs: DataFrame, group: str) -> DataFrame:
    return x.where("value is not null").join(F.broadcast(obs.select("obs_id", F.col(group).alias("group"))), "obs_id")


def intensity_box(x: DataFrame, obs: DataFrame, group: str) -> DataFrame:
    return box(_grouped(x, obs, group), ["group"], "value")


def intensity_histogram(x: DataFrame, obs: DataFrame, group: str, bins: int = 30) -> DataFrame:
    return histogram(_grouped(x, obs, group), "value", bins, ("group",))


def missingness(x: DataFrame, var: DataFrame, n_obs: int) -> DataFrame:
    """missing, n, cumulative, share: how many features miss at most so many samples; 0 and n_obs always appear."""
    have = x.where("value is not null").groupBy("var_id").agg(F.count("*").alias("have"))
    per = var.select("var_id").join(have, "var_id", "left").select((F.lit(n_obs) - F.coalesce("have", F.lit(0))).cast("long").alias("missing"))
    ends = x.sparkSession.range(2).select((F.col("id") * n_obs).alias("missing"), F.lit(0).alias("k"))
    counts = per.select("missing", F.lit(1).alias("k")).unionByName(ends).groupBy("missing").agg(F.sum("k").alias("n"))
    up = F.sum("n").over(Window.orderBy("missing"))  # a row for each number of missing samples
    return counts.select("missing", "n", up.alias("cumulative"), F.try_divide(up * 100.0, F.sum("n").over(Window.partitionBy())).alias("share"))


def upset(x: DataFrame, obs: DataFrame, group: str, groups: list[str]) -> DataFrame:
    """pattern (a bit for each of ``groups`` in order), n: features by the groups that have them; a value of 0 counts as absent."""
    rows = present(x.where("value <> 0"), obs, group)
    flags = [F.max((F.col("group") == g).cast("int")).cast("string").alias(f"b{i}") for i, g in enumerate(groups)]
    per = rows.groupBy("var_id").agg(*flags)
    return per.groupBy(F.concat(*(F.col(f"b{i}") for i in range(len(groups)))).alias("pattern")).agg(F.count("*").alias("n"))


def group_correlation(x: DataFrame, obs: DataFrame, group: str, method: str = "pearson") -> DataFrame:
    """Correlation of the groups' median profiles, lower triangle."""
    medians = _grouped(x, obs, group).groupBy("group", "var_id").agg(F.median("value").alias("value")).withColumnRenamed("group", "obs_id")
    return multivariate.corr(medians, "value", method).where("obs_i >= obs_j")


def scatter(embedding: DataFrame, obs: DataFrame, group: str) -> DataFrame:
    """An embedding with its samples' group."""
    return embedding.join(obs.select("obs_id", F.col(group).alias("group")), "obs_id")


