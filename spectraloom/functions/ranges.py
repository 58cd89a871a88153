"""Running sums and minima over a global order without a single task.

An unpartitioned window moves all rows to one task. Here rows are dealt to ordered ranges by quantiles
of the leading sort column; windows run inside a range, and what the ranges before (or after) amount to
is added from a table of one row a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 64


def with_range(df: DataFrame, by: str, ranges: int = RANGES) -> DataFrame:
    """Add ``_range``: equal values of ``by`` share one, larger values have none smaller. NULL is in range 0."""
    cuts = df.agg(F.percentile_approx(by, [i / ranges for i in range(1, ranges)], 10 * ranges).alias("c")).first().c or []
    number = F.lit(0)
    for cut in sorted(set(cuts)):
        number = number + (F.col(by) > F.lit(cut)).cast("int")
    return df.withColumn("_range", F.coalesce(number, F.lit(0)))


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Inclusive running sums over (``_range`` , ``order``); ``order`` must begin with the ranged column, ascending."""
    totals = df.groupBy("_range").agg(*(F.sum(c).alias(f"_t_{k}") for k, c in sums.items()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offset = totals.select(F.col("_range").alias("_r"), *(F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in sums))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df.select("*", *(F.sum(c).over(inside).alias(k) for k, c in sums.items())).join(F.broadcast(offset), F.col("_range") == F.col("_r"))
    for k in sums:
        out = out.withColumn(k, F.coalesce(F.col(k), F.lit(0)) + F.col(f"_o_{k}"))
    return out.drop("_r", *(f"_o_{k}" for k in sums))


def least_ahead(df: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """The least ``value`` from this row on in (``_range``, ``order``); ``order`` is ascending.

    The rows are read backwards: Spark sums up a frame that ends with the rows behind anew for each row.
    """
    totals = df.groupBy("_range").agg(F.min(value).alias("_m"))
    after = Window.orderBy(F.col("_range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    later = totals.select(F.col("_range").alias("_r"), F.min("_m").over(after).alias("_later"))
    inside = Window.partitionBy("_range").orderBy(*(c.desc() for c in order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df.withColumn(name, F.min(value).over(inside)).join(F.broadcast(later), F.col("_range") == F.col("_r"))
    return out.withColumn(name, F.least(name, "_later")).drop("_r", "_later")


def wide_median(x: DataFrame, layer: str, by: tuple = (), name: str = "_m") -> DataFrame:
    """``by`` and the exact median, for groups too large for a task each (F.median gathers a group's distinct values in one).

    A sketch gives values safely below and above the middle; only what lies between, a hundredth of a group and its ties, is
    ordered. Should a sketch be wrong the job fails. Groups without any value are left out.
    """
    v = F.col(layer)
    sketch = x.groupBy(*by).agg(F.percentile_approx(v, [0.495, 0.505], 2000).alias("_q"), F.count(v).alias("_n"))
    keep = [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]
    s = F.broadcast(sketch.select(*keep, F.col("_q")[0].alias("_from"), F.col("_q")[1].alias("_to"), "_n"))
    rows = x.where(v.isNotNull())
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    rows = rows.join(s, same) if by else rows.crossJoin(s)
    near = rows.where(v <= F.col("_to")).groupBy(*by, "_n", F.when(v >= F.col("_from"), v).alias("_v")).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*by).orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # The counts run over a hundredth of a group.
    low, high = F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1
    ends = near.withColumn("_u", upto).groupBy(*by).agg(F.max("_n").alias("_n"), *(F.min(F.when(F.col("_u") >= at, F.struct("_u", "_v"))).alias(k) for k, at in (("_a", low), ("_b", high))))
    a, b = F.col("_a._v"), F.col("_b._v")
    missed = F.raise_error(F.lit("the sketch of a median missed it")).cast("double")
    return ends.select(*by, F.when(F.col("_n").isNull(), None).when(a.isNull() | b.isNull(), missed).when(a == b, a).otherwise(0.5 * a + 0.5 * b).alias(name))


def average_rank(partition: list, by: str, descending: bool = False) -> Column:
    """Rank by a column with the mean rank for ties; NULL ranks last, mask it where it matters."""
    order = F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last()
    return F.rank().over(Window.partitionBy(*partition).orderBy(order)) + (F.count(F.lit(1)).over(Window.partitionBy(*partition, by)) - 1) / 2
