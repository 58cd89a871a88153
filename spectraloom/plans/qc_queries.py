"""Quality-control tables, exports and readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import qc
from ..sources import export, readers
from .proxies import DENSE, LINES, PROFILES, dense, lines, profiles, rounded, table
from .registry import query

PRESENT = "pr AS (SELECT DISTINCT substr(obs_id, 1, 1) AS \"group\", var_id FROM profiles)"


def _parts(spark, sf_dir):
    s = profiles(spark, sf_dir)
    return s["peptide"].x, s["peptide"].var, s.obs


@query("qc_id_counts", f'WITH {LINES}, {PROFILES}, {PRESENT} SELECT "group", count(*) AS n FROM pr GROUP BY ALL')
def id_counts(spark, sf_dir):
    x, _, obs = _parts(spark, sf_dir)
    return qc.id_counts(x, obs, "group")


@query("qc_var_counts", f'WITH {LINES}, {PROFILES}, {PRESENT} SELECT "group", p_brand AS protein_group, count(*) AS n FROM pr JOIN part ON p_partkey::VARCHAR = var_id GROUP BY ALL')
def var_counts(spark, sf_dir):
    x, var, obs = _parts(spark, sf_dir)
    return qc.var_counts(x, var, obs, "group", "protein_group")


def _box(source: str, column: str) -> str:
    q = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    return f"""b AS (SELECT "group", count({column}) AS "count", avg({column}) AS mean, stddev_samp({column}) AS std, min({column}) AS "min", {", ".join(f'quantile_cont({column}, {p}) AS {n}' for n, p in q.items())}, max({column}) AS "max" FROM {source} GROUP BY ALL)
  SELECT "group", "count", {", ".join(f'round({c}::DOUBLE, 4) + 0.0 AS {n}' for n, c in (("mean", "mean"), ("std", "std"), ('"min"', '"min"'), ("q1", "q1"), ("median", "median"), ("q3", "q3"), ('"max"', '"max"'), ("lower_fence", 'greatest("min", q1 - 1.5 * (q3 - q1))'), ("upper_fence", 'least("max", q3 + 1.5 * (q3 - q1))')))} FROM b"""


STATS = ("mean", "std", "min", "q1", "median", "q3", "max", "lower_fence", "upper_fence")


def _doubles(df):
    return rounded(df.withColumns({c: F.col(c).cast("double") for c in STATS}), *STATS, digits=4)


@query("qc_var_box", f'WITH {LINES}, {PROFILES}, {PRESENT}, j AS (SELECT "group", p_size FROM pr JOIN part ON p_partkey::VARCHAR = var_id), {_box("j", "p_size")}')
def var_box(spark, sf_dir):
    x, var, obs = _parts(spark, sf_dir)
    return _doubles(qc.var_box(x, var, obs, "group", "size"))


@query("qc_intensity_box", f'WITH {LINES}, {PROFILES}, j AS (SELECT substr(obs_id, 1, 1) AS "group", value FROM profiles), {_box("j", "value")}')
def intensity_box(spark, sf_dir):
    x, _, obs = _parts(spark, sf_dir)
    return _doubles(qc.intensity_box(x, obs, "group"))


@query("qc_intensity_histogram", f"""WITH {LINES}, {PROFILES}, v AS (SELECT substr(obs_id, 1, 1) AS "group", value FROM profiles), s AS (SELECT min(value) AS lo, (max(value) - min(value)) / 30 AS w, count(*) AS n FROM v),
  c AS (SELECT "group", least(30, greatest(1, ceil((value - lo) / w)))::INT AS bin, count(*) AS n FROM v, s GROUP BY ALL), g AS (SELECT DISTINCT "group" FROM v)
  SELECT g."group", t.bin::INT AS bin, round(lo + (t.bin - 1) * w, 4) AS "left", round(lo + t.bin * w, 4) AS "right", coalesce(c.n, 0) AS n, round(coalesce(c.n, 0) * 100.0 / s.n, 6) AS frequency
  FROM g CROSS JOIN range(1, 31) t(bin) CROSS JOIN s LEFT JOIN c ON c."group" = g."group" AND c.bin = t.bin""")
def histogram(spark, sf_dir):
    x, _, obs = _parts(spark, sf_dir)
    out = qc.intensity_histogram(x, obs, "group", 30)
    return rounded(rounded(out.withColumn("n", F.col("n").cast("long")).withColumn("frequency", F.col("frequency").cast("double")), "left", "right", digits=4), "frequency", digits=6)


@query("qc_missingness", f"""WITH {LINES}, {PROFILES}, k AS (SELECT count(DISTINCT obs_id) AS k FROM profiles), p AS (SELECT k - count(profiles.obs_id) AS missing FROM part CROSS JOIN k LEFT JOIN profiles ON var_id = p_partkey::VARCHAR GROUP BY p_partkey, k),
  a AS (SELECT missing, 1 AS c FROM p UNION ALL SELECT 0, 0 UNION ALL SELECT k, 0 FROM k), n AS (SELECT missing, sum(c)::BIGINT AS n FROM a GROUP BY ALL)
  SELECT missing, n, (sum(n) OVER (ORDER BY missing))::BIGINT AS cumulative, round((sum(n) OVER (ORDER BY missing)) * 100.0 / sum(n) OVER (), 6) AS share FROM n""")
def missingness(spark, sf_dir):
    x, var, obs = _parts(spark, sf_dir)
    out = qc.missingness(x, var, obs.count())
    return rounded(out.withColumn("share", F.col("share").cast("double")), "share", digits=6)


@query("qc_upset", f"""WITH {LINES}, {PROFILES}, f AS (SELECT var_id, bool_or(obs_id LIKE 'A%') AS a, bool_or(obs_id LIKE 'N%') AS n, bool_or(obs_id LIKE 'R%') AS r FROM profiles WHERE value <> 0 GROUP BY ALL)
  SELECT a::INT || '' || n::INT || r::INT AS pattern, count(*) AS n FROM f GROUP BY ALL""")
def upset(spark, sf_dir):
    x, _, obs = _parts(spark, sf_dir)
    return qc.upset(x, obs, "group", ["A", "N", "R"])


@query("qc_group_correlation", f"""WITH {LINES}, {PROFILES}, m AS (SELECT substr(obs_id, 1, 1) AS g, var_id, median(value) AS v FROM profiles GROUP BY ALL)
  SELECT a.g AS obs_i, b.g AS obs_j, round(corr(a.v, b.v), 5) + 0.0 AS r FROM m a JOIN m b USING (var_id) WHERE a.g >= b.g GROUP BY ALL""")
def group_correlation(spark, sf_dir):
    x, _, obs = _parts(spark, sf_dir)
    return rounded(qc.group_correlation(x, obs, "group"), "r")


@query("qc_describe", f"""WITH {DENSE} SELECT label, count(*) AS "count", round(avg(value), 5) + 0.0 AS mean, round(stddev_samp(value), 5) AS std, round(min(value), 5) AS "min", round(quantile_cont(value, 0.25), 5) + 0.0 AS q1, round(quantile_cont(value, 0.5), 5) + 0.0 AS median, round(quantile_cont(value, 0.75), 5) + 0.0 AS q3, round(max(value), 5) AS "max" FROM dense GROUP BY ALL""")
def describe(spark, sf_dir):
    s = dense(spark, sf_dir)
    out = qc.describe(s["protein"].x.join(s.obs.select("obs_id", "label"), "obs_id"), ["label"], "value")
    return rounded(out, "mean", "std", "min", "q1", "median", "q3", "max")


@query("export_readable", f"""WITH {LINES}, {PROFILES} SELECT p_partkey::VARCHAR AS var_id, p_size AS size, {", ".join(f"round(max(value) FILTER (obs_id = '{o}'), 5) AS {o}" for o in ("AF", "AO", "NF", "NO", "RF", "RO"))}
  FROM part LEFT JOIN profiles ON var_id = p_partkey::VARCHAR GROUP BY ALL""")
def readable(spark, sf_dir):
    samples = ["AF", "AO", "NF", "NO", "RF", "RO"]
    study = profiles(spark, sf_dir)
    study = study.with_(obs=spark.createDataFrame([(o, i) for i, o in enumerate(samples)], "obs_id string, obs_ord int"))
    return rounded(export.to_readable(study, "peptide", include=["var_id", "size"]), *samples, digits=5)


@query("read_diann", f"""WITH {LINES}, t AS (SELECT peptide, obs_id, min(value) AS v, min(pep) AS pep FROM lines GROUP BY ALL)
  SELECT obs_id || '.' || peptide AS var_id, obs_id, v AS value FROM t WHERE peptide::BIGINT % 10 <> 0 AND v <> 0""")
def read_diann(spark, sf_dir):
    t = lines(spark, sf_dir).groupBy("peptide", "obs_id").agg(F.min("value").alias("v"), F.min("pep").alias("pep"))
    raw = t.select(F.col("obs_id").alias("Run"), F.col("peptide").alias("Precursor.Id"), F.concat(F.lit("sp|P"), "peptide", F.lit("|X")).alias("Protein.Ids"), F.concat(F.lit("PEPK"), "peptide").alias("Modified.Sequence"), F.lit("PEPK").alias("Stripped.Sequence"), F.lit(2).alias("Precursor.Charge"), F.lit(0.0).alias("Lib.Q.Value"), F.col("pep").alias("Global.Q.Value"), F.col("pep").alias("PEP"), (F.col("peptide").cast("long") % 10 == 0).alias("Decoy"), F.lit(1.0).alias("RT"), F.lit(400.0).alias("Precursor.Mass"), F.col("v").alias("Precursor.Quantity"))
    return readers.read_diann(spark, raw)["psm"].x.select("var_id", "obs_id", "value")


@query("read_sage_tmt", """SELECT obs_id, count(*) AS n, round(sum(value), 3) AS total FROM (SELECT unnest(['126', '127', '128', '129', '130', '131']) AS obs_id,
  unnest([o_totalprice, o_totalprice * 2, (o_custkey % 5)::DOUBLE, 1.5, o_totalprice / 2, 3.0]) AS value, o_orderstatus FROM orders) WHERE value <> 0 AND o_orderstatus <> 'P' GROUP BY ALL""")
def read_sage_tmt(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    key = F.concat(F.lit("controllerType=0 scan="), F.col("o_orderkey").cast("string"))
    ident = o.select(F.concat(F.lit("sp|P"), F.col("o_custkey").cast("string"), F.lit("|X")).alias("proteins"), F.lit("run/one.mzML").alias("filename"), key.alias("scannr"), F.concat(F.lit("PEPTIDEK"), F.lit("[+229.16]")).alias("peptide"), F.when(F.col("o_orderstatus") == "P", -1).otherwise(1).alias("label"), F.lit(-2.0).alias("posterior_error"), F.lit(8).alias("peptide_len"), F.lit(0.001).alias("spectrum_q"), F.lit(2).alias("charge"), F.lit(0).alias("missed_cleavages"), F.lit(0).alias("semi_enzymatic"), F.lit(1.0).alias("rt"), F.lit(900.0).alias("calcmass"))
    price = F.col("o_totalprice")
    quant = o.select(F.lit("run/one.mzML").alias("filename"), key.alias("scannr"), F.lit(1.0).alias("ion_injection_time"), *(v.cast("double").alias(f"tmt_{i}") for i, v in enumerate((price, price * 2, F.col("o_custkey") % 5, F.lit(1.5), price / 2, F.lit(3.0)), 1)))
    x = readers.read_sage(spark, ident, "tmt", quant)["psm"].x
    return x.groupBy("obs_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))
