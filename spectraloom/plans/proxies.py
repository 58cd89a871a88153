"""The driver tables read as omics assays, and the SQL for the same views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Assay, Study


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Dense: a vector is a sample, a dimension a feature.
DENSE = """dense AS (
  SELECT vec_id::VARCHAR AS obs_id, 'd' || (generate_subscripts(embedding, 1) - 1) AS var_id, unnest(embedding)::DOUBLE AS value, label, label % 3 AS batch FROM embeddings
)"""


def dense(spark: SparkSession, sf_dir: str) -> Study:
    e = table(spark, sf_dir, "embeddings")
    x = e.select(F.col("vec_id").cast("string").alias("obs_id"), F.posexplode("embedding").alias("d", "value"))
    x = x.select("obs_id", F.concat(F.lit("d"), F.col("d").cast("string")).alias("var_id"), F.col("value").cast("double"))
    obs = e.select(F.col("vec_id").cast("string").alias("obs_id"), F.col("vec_id").alias("obs_ord"), "label", (F.col("label") % 3).alias("batch"))
    var = x.select("var_id").distinct().withColumn("var_ord", F.substring("var_id", 2, 9).cast("long"))
    return Study({"protein": Assay(x, var, None, "protein")}, obs)


# Sparse: an order line is a PSM of peptide l_partkey in sample flag + status, its discount the purity, its line number the fraction.
LINES = """lines AS (
  SELECT l_partkey::VARCHAR AS peptide, l_returnflag || l_linestatus AS obs_id, l_extendedprice AS value, l_discount AS purity, l_tax AS pep,
    l_linenumber::VARCHAR AS filename, l_partkey::VARCHAR || '_' || l_suppkey::VARCHAR AS var_id, l_suppkey FROM lineitem
)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    return table(spark, sf_dir, "lineitem").select(text("l_partkey").alias("peptide"), F.concat("l_returnflag", "l_linestatus").alias("obs_id"), F.col("l_extendedprice").alias("value"), F.col("l_discount").alias("purity"), F.col("l_tax").alias("pep"), text("l_linenumber").alias("filename"), F.concat_ws("_", text("l_partkey"), text("l_suppkey")).alias("var_id"), "l_suppkey")


# Profiles: mean price of a part (a feature) in each of the samples.
PROFILES = "profiles AS (SELECT peptide AS var_id, obs_id, avg(value) AS value FROM lines GROUP BY ALL)"


def profiles(spark: SparkSession, sf_dir: str) -> Study:
    x = lines(spark, sf_dir).groupBy(F.col("peptide").alias("var_id"), "obs_id").agg(F.avg("value").alias("value"))
    part = table(spark, sf_dir, "part")
    var = part.select(F.col("p_partkey").cast("string").alias("var_id"), F.col("p_partkey").alias("var_ord"), F.col("p_brand").alias("protein_group"), F.col("p_size").alias("size"), "p_type")
    obs = x.select("obs_id").distinct().withColumn("group", F.substring("obs_id", 1, 1)).withColumn("status", F.substring("obs_id", 2, 1)).withColumn("obs_ord", F.ascii("obs_id") * 256 + F.ascii(F.substring("obs_id", 2, 1)))
    return Study({"peptide": Assay(x, var, None, "peptide")}, obs)


def rounded(df: DataFrame, *columns: str, digits: int = 5) -> DataFrame:
    """Doubles as the SQL rounds them; adding zero takes the sign off -0."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})
