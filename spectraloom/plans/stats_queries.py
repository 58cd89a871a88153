"""Error rates, normalisation, batch correction, tests, inference, correlation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ranges import average_rank
from ..operators import batch, de, fdr, inference, multivariate, normalise
from .proxies import DENSE, LINES, PROFILES, dense, lines, profiles, rounded, table
from .registry import query

SCORED = "scored AS (SELECT o_orderkey, o_totalprice / 1e6 AS PEP, o_orderstatus = 'P' AS is_decoy FROM orders)"


def _scored(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 1e6).alias("PEP"), (F.col("o_orderstatus") == "P").alias("is_decoy"))


@query("target_decoy_q", f"""WITH {SCORED}, c AS (SELECT *, count(*) FILTER (is_decoy) OVER w AS d, count(*) FILTER (NOT is_decoy) OVER w AS t FROM scored WINDOW w AS (ORDER BY PEP, is_decoy, o_orderkey ROWS UNBOUNDED PRECEDING)),
  f AS (SELECT *, CASE WHEN t > 0 THEN least(1.0, (d + 1)::DOUBLE / t) END AS fdr FROM c)
  SELECT o_orderkey, round(CASE WHEN fdr IS NOT NULL THEN min(fdr) OVER (ORDER BY PEP, is_decoy, o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) END, 8) AS q_value FROM f""")
def target_decoy_q(spark, sf_dir):
    return rounded(fdr.target_decoy(_scored(spark, sf_dir), "PEP", "is_decoy", "o_orderkey").select("o_orderkey", "q_value"), "q_value", digits=8)


P = "p AS (SELECT o_orderkey, least(1.0, o_totalprice / (SELECT max(o_totalprice) FROM orders)) AS p FROM orders)"


def _p(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    most = o.agg(F.max("o_totalprice").alias("m"))
    return o.crossJoin(F.broadcast(most)).select("o_orderkey", F.least(F.lit(1.0), F.col("o_totalprice") / F.col("m")).alias("p"))


def _steps(factor: str) -> str:
    return f"""WITH {P}, r AS (SELECT *, {factor} * p * count(*) OVER () / row_number() OVER (ORDER BY p, o_orderkey) AS q FROM p)
  SELECT o_orderkey, round(greatest(0, least(1, min(q) OVER (ORDER BY p, o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))), 8) AS q_value FROM r"""


@query("benjamini_hochberg", _steps("1"))
def bh(spark, sf_dir):
    return rounded(fdr.benjamini_hochberg(_p(spark, sf_dir), "p", "o_orderkey").select("o_orderkey", "q_value"), "q_value", digits=8)


@query("storey_q", _steps("least(1.0, (SELECT count(*) FILTER (p > 0.5) / (0.5 * count(*)) FROM p))"))
def storey(spark, sf_dir):
    return rounded(fdr.storey(_p(spark, sf_dir), "p", "o_orderkey").select("o_orderkey", "q_value"), "q_value", digits=8)


@query("log2_transform", f"WITH {LINES}, {PROFILES} SELECT var_id, obs_id, round(CASE WHEN value > 0 THEN log2(value) END, 5) + 0.0 AS value FROM profiles")
def log2_transform(spark, sf_dir):
    return rounded(normalise.log2_transform(profiles(spark, sf_dir), "peptide")["peptide"].x, "value")


@query("scale", f"WITH {DENSE} SELECT obs_id, var_id, round((value - avg(value) OVER (PARTITION BY var_id)) / nullif(stddev_pop(value) OVER (PARTITION BY var_id), 0), 5) + 0.0 AS value FROM dense")
def scale(spark, sf_dir):
    return rounded(normalise.scale_data(dense(spark, sf_dir), "protein")["protein"].x.select("obs_id", "var_id", "value"), "value")


@query("normalise_median_center", f"WITH {DENSE} SELECT obs_id, var_id, round(value - median(value) OVER (PARTITION BY obs_id), 5) + 0.0 AS value FROM dense")
def median_center(spark, sf_dir):
    return rounded(normalise.normalise(dense(spark, sf_dir), "median_center", "protein")["protein"].x.select("obs_id", "var_id", "value"), "value")


@query("normalise_median", f"WITH {DENSE} SELECT obs_id, var_id, round(value - median(value) OVER (PARTITION BY obs_id) + (SELECT median(value) FROM dense), 5) + 0.0 AS value FROM dense")
def median(spark, sf_dir):
    return rounded(normalise.normalise(dense(spark, sf_dir), "median", "protein")["protein"].x.select("obs_id", "var_id", "value"), "value")


FRACTIONS = "fractions AS (SELECT filename || ':' || peptide AS var_id, filename, obs_id, avg(value) AS value FROM lines GROUP BY ALL)"


@query("normalise_by_fraction", f"""WITH {LINES}, {FRACTIONS} SELECT var_id, obs_id, round(value - median(value) OVER (PARTITION BY obs_id, filename) + median(value) OVER (PARTITION BY filename), 4) + 0.0 AS value FROM fractions""")
def by_fraction(spark, sf_dir):
    from ..model import Assay, Study

    x = lines(spark, sf_dir).withColumn("var_id", F.concat_ws(":", "filename", "peptide")).groupBy("var_id", "filename", "obs_id").agg(F.avg("value").alias("value"))
    var = x.select("var_id", "filename").distinct().withColumn("var_ord", F.lit(0))
    study = Study({"psm": Assay(x.drop("filename"), var)}, x.select("obs_id").distinct())
    out = normalise.normalise(study, "median", "psm", fraction=True)["psm"].x
    return rounded(out.select("var_id", "obs_id", "value"), "value", digits=4)


@query("normalise_quantile", f"""WITH {LINES}, {PROFILES}, n AS (SELECT count(*) AS N FROM part),
  s AS (SELECT obs_id, var_id, value, count(*) OVER (PARTITION BY obs_id) AS M, rank() OVER (PARTITION BY obs_id ORDER BY value) + (count(*) OVER (PARTITION BY obs_id, value) - 1) / 2.0 AS r FROM profiles),
  l AS (SELECT obs_id, list(value ORDER BY value) AS vs, count(*) AS M FROM profiles GROUP BY ALL),
  g AS (SELECT obs_id, j, vs, M, (M - 1)::DOUBLE * j / (N - 1) AS pos FROM l, n, range(N) t(j)),
  a AS (SELECT j, avg(vs[floor(pos + 1e-9)::BIGINT + 1] + (vs[least(floor(pos + 1e-9)::BIGINT + 2, M)] - vs[floor(pos + 1e-9)::BIGINT + 1]) * greatest(0, pos - floor(pos + 1e-9))) AS y FROM g GROUP BY j),
  p AS (SELECT obs_id, var_id, (N - 1)::DOUBLE * (r - 1) / (M - 1) AS pos, N FROM s, n)
  SELECT obs_id, var_id, round(lo.y + (hi.y - lo.y) * greatest(0, pos - floor(pos + 1e-9)), 4) + 0.0 AS value FROM p JOIN a lo ON lo.j = floor(pos + 1e-9)::BIGINT JOIN a hi ON hi.j = least(floor(pos + 1e-9)::BIGINT + 1, N - 1)""")
def quantile(spark, sf_dir):
    out = normalise.normalise(profiles(spark, sf_dir), "quantile", "peptide")["peptide"].x
    return rounded(out.select("obs_id", "var_id", "value"), "value", digits=4)


SITES = """sites AS (SELECT var_id, obs_id, log2(value) AS value, p_brand AS protein_group FROM profiles JOIN part ON p_partkey::VARCHAR = var_id),
  prot AS (SELECT protein_group, obs_id, median(value) AS p FROM sites GROUP BY ALL)"""


def _sites(spark, sf_dir):
    study = profiles(spark, sf_dir)
    x = study["peptide"].x.join(study["peptide"].var.select("var_id", "protein_group"), "var_id").withColumn("value", F.log2("value"))
    return x, x.groupBy("protein_group", "obs_id").agg(F.median("value").alias("value"))


@query("ptm_ratio_adjust", f"WITH {LINES}, {PROFILES}, {SITES} SELECT var_id, obs_id, round(value - p, 5) + 0.0 AS value FROM sites JOIN prot USING (protein_group, obs_id)")
def ratio(spark, sf_dir):
    x, p = _sites(spark, sf_dir)
    return rounded(normalise.ratio_adjusted(x, p).select("var_id", "obs_id", "value"), "value")


@query("ptm_ridge_adjust", f"""WITH {LINES}, {PROFILES}, {SITES}, j AS (SELECT var_id, obs_id, value AS y, p AS x FROM sites JOIN prot USING (protein_group, obs_id)),
  f AS (SELECT var_id, avg(y) AS my, avg(x) AS mx, covar_pop(y, x) * count(*) / (var_pop(x) * count(*) + 100) AS b FROM j GROUP BY var_id HAVING count(*) > 2)
  SELECT var_id, obs_id, round(y - my - b * (x - mx), 5) + 0.0 AS value FROM j JOIN f USING (var_id)""")
def ridge(spark, sf_dir):
    x, p = _sites(spark, sf_dir)
    return rounded(normalise.ridge_adjusted(x, p).select("var_id", "obs_id", "value"), "value")


BATCHED = "factors AS (SELECT batch, var_id, {} AS f FROM dense {} GROUP BY ALL)"


@query("batch_median_center", f"WITH {DENSE}, {BATCHED.format('median(value)', '')} SELECT obs_id, var_id, round(value - f + (SELECT median(value) FROM dense), 5) + 0.0 AS value FROM dense JOIN factors USING (batch, var_id)")
def batch_median(spark, sf_dir):
    out = batch.correct_batch_effect(dense(spark, sf_dir), "protein", "median_center", "batch")
    return rounded(out["protein"].x.select("obs_id", "var_id", "value"), "value")


@query("batch_gis", f"""WITH {LINES}, {PROFILES}, b AS (SELECT *, substr(obs_id, 1, 1) AS batch FROM profiles), f AS (SELECT batch, var_id, avg(value) AS f FROM b WHERE obs_id LIKE '%F' GROUP BY ALL)
  SELECT var_id, obs_id, round(value / f + (SELECT median(value) FROM profiles), 4) + 0.0 AS value FROM b LEFT JOIN f USING (batch, var_id) WHERE obs_id LIKE '%O'""")
def batch_gis(spark, sf_dir):
    study = profiles(spark, sf_dir)
    standards = [r.obs_id for r in study.obs.where("status = 'F'").collect()]
    out = batch.correct_batch_effect(study, "peptide", "gis", "group", gis_samples=standards, log_transformed=False)
    return rounded(out["peptide"].x.select("var_id", "obs_id", "value"), "value", digits=4)


@query("batch_combat")
def batch_combat(spark, sf_dir):
    out = batch.correct_batch_effect(dense(spark, sf_dir), "protein", "combat", "batch")
    return rounded(out["protein"].x.select("obs_id", "var_id", "value"), "value")


@query("batch_continuous")
def batch_continuous(spark, sf_dir):
    study = profiles(spark, sf_dir)
    out = batch.correct_batch_effect(study, "peptide", "continuous", "obs_ord")
    return rounded(out["peptide"].x.select("var_id", "obs_id", "value"), "value", digits=4)


GROUPS = "g AS (SELECT var_id, count(*) FILTER (label = 0) AS nc, avg(value) FILTER (label = 0) AS mc, var_samp(value) FILTER (label = 0) AS vc, median(value) FILTER (label = 0) AS dc, count(*) FILTER (label = 1) AS ne, avg(value) FILTER (label = 1) AS me, var_samp(value) FILTER (label = 1) AS ve, median(value) FILTER (label = 1) AS d1 FROM dense GROUP BY var_id)"


def _tested(spark, sf_dir, method):
    study = dense(spark, sf_dir)
    x = study["protein"].x.join(study.obs.select("obs_id", "label"), "obs_id").where("label in (0, 1)").withColumn("is_ctrl", F.col("label") == 0)
    if method == "wilcoxon":
        x = x.withColumn("rank", average_rank(["var_id"], "value"))
    return de.statistics(x, ["var_id"], method, pvalues=False)


@query("de_welch", f"WITH {DENSE}, {GROUPS} SELECT var_id, round((me - mc) / sqrt(vc / nc + ve / ne), 5) + 0.0 AS stat, round((vc / nc + ve / ne) ** 2 / ((vc / nc) ** 2 / (nc - 1) + (ve / ne) ** 2 / (ne - 1)), 5) AS df FROM g")
def welch(spark, sf_dir):
    return rounded(_tested(spark, sf_dir, "welch"), "stat", "df")


@query("de_student", f"WITH {DENSE}, {GROUPS} SELECT var_id, round((me - mc) / sqrt(((nc - 1) * vc + (ne - 1) * ve) / (nc + ne - 2) * (1.0 / nc + 1.0 / ne)), 5) + 0.0 AS stat, (nc + ne - 2)::DOUBLE AS df FROM g")
def student(spark, sf_dir):
    return rounded(_tested(spark, sf_dir, "student"), "stat", "df")


@query("de_wilcoxon", f"""WITH {DENSE}, r AS (SELECT var_id, label, rank() OVER (PARTITION BY var_id ORDER BY value) + (count(*) OVER (PARTITION BY var_id, value) - 1) / 2.0 AS r FROM dense WHERE label IN (0, 1)),
  s AS (SELECT var_id, sum(r) FILTER (label = 0) AS s, count(*) FILTER (label = 0) AS nc, count(*) FILTER (label = 1) AS ne FROM r GROUP BY var_id)
  SELECT var_id, round((s - nc * (nc + ne + 1) / 2.0) / sqrt(nc * ne * (nc + ne + 1) / 12.0), 5) + 0.0 AS stat FROM s""")
def wilcoxon(spark, sf_dir):
    return rounded(_tested(spark, sf_dir, "wilcoxon"), "stat")


# Two-sided p of Student's t for whole degrees of freedom, by its finite sum over the angle with tangent |t| / sqrt(df).
TAILS = """a AS (SELECT *, atan(abs(stat) / sqrt(df)) AS th FROM t), p AS (SELECT *, 1 - CASE WHEN df % 2 = 0
    THEN sin(th) * (1 + coalesce(list_sum(list_transform(range(1, df // 2), lambda k: cos(th) ** (2 * k) * exp(lgamma(k + 0.5) - lgamma(k + 1.0)) / sqrt(pi()))), 0))
    ELSE 2 / pi() * (th + CASE WHEN df > 1 THEN sin(th) * cos(th) * (1 + coalesce(list_sum(list_transform(range(1, (df - 1) // 2), lambda k: cos(th) ** (2 * k) * exp(lgamma(k + 1.0) - lgamma(k + 1.5)) * sqrt(pi()) / 2)), 0)) ELSE 0 END) END AS p_value FROM a)"""
STUDENT = f"t AS (SELECT var_id, dc, d1, nc, ne, nc + ne - 2 AS df, (me - mc) / sqrt(((nc - 1) * vc + (ne - 1) * ve) / (nc + ne - 2) * (1.0 / nc + 1.0 / ne)) AS stat FROM g), {TAILS}"
RATES = "r AS (SELECT *, p_value * count(*) OVER () / row_number() OVER (ORDER BY p_value, var_id) AS q FROM p), b AS (SELECT *, greatest(0, least(1, min(q) OVER (ORDER BY p_value, var_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))) AS q_value FROM r)"
SAMPLES = "o AS (SELECT count(*) FILTER (label = 0) AS oc, count(*) FILTER (label = 1) AS oe FROM embeddings)"


def _student(spark, sf_dir):
    return de.run_de(dense(spark, sf_dir), "protein", "label", "0", "1", stat_method="student", n_resamples=None, fdr="bh")


@query("run_de_student", f"""WITH {DENSE}, {GROUPS}, {STUDENT}, {RATES}, {SAMPLES}
  SELECT var_id AS features, round(dc, 5) + 0.0 AS repr_ctrl, round(d1, 5) + 0.0 AS repr_expr, round(nc * 100.0 / oc, 5) AS pct_ctrl, round(ne * 100.0 / oe, 5) AS pct_expr, round(d1 - dc, 5) + 0.0 AS log2fc, round(stat, 5) + 0.0 AS stat, round(p_value, 6) + 0.0 AS p_value, round(q_value, 6) + 0.0 AS q_value FROM b, o""")
def run_de_student(spark, sf_dir):
    t = _student(spark, sf_dir).table
    return rounded(rounded(t, "repr_ctrl", "repr_expr", "pct_ctrl", "pct_expr", "log2fc", "stat"), "p_value", "q_value", digits=6)


@query("run_de_volcano", f"""WITH {DENSE}, {GROUPS}, {STUDENT}, {RATES}
  SELECT var_id AS features, round(-log10(greatest(p_value, 1e-300)), 4) + 0.0 AS logp, CASE WHEN p_value < 0.5 AND d1 - dc >= 0.01 THEN 'UP' WHEN p_value < 0.5 AND d1 - dc <= -0.01 THEN 'DOWN' ELSE 'nonDE' END AS de FROM b""")
def run_de_volcano(spark, sf_dir):
    return rounded(_student(spark, sf_dir).volcano(0.01, 0.5, "p_value").select("features", "logp", "de"), "logp", digits=4)


@query("run_de_top", f"""WITH {DENSE}, {GROUPS}, c AS (SELECT var_id AS features, d1 - dc AS f FROM g) SELECT features, round(f, 5) + 0.0 AS log2fc FROM (
  (SELECT * FROM c ORDER BY f DESC, features LIMIT 7) UNION ALL (SELECT * FROM c ORDER BY f, features LIMIT 7))""")
def run_de_top(spark, sf_dir):
    return rounded(_student(spark, sf_dir).top(7).select("features", "log2fc"), "log2fc")


@query("de_simple_bh")
def de_simple(spark, sf_dir):
    out = de.run_de(dense(spark, sf_dir), "protein", "label", "0", "1", n_resamples=None, fdr="bh")
    return rounded(out.table, "repr_ctrl", "repr_expr", "log2fc", "stat", "p_value", "q_value")


EXACT = """logs AS (SELECT var_id, obs_id, log2(value) AS value FROM profiles), o AS (SELECT obs_id, row_number() OVER (ORDER BY CASE WHEN obs_id LIKE '%F' THEN 0 ELSE 1 END, obs_id) - 1 AS i FROM (SELECT DISTINCT obs_id FROM profiles)),
  k AS (SELECT count(*) FILTER (obs_id LIKE '%F') AS nc, count(*) AS n FROM o), ok AS (SELECT var_id FROM logs, k GROUP BY var_id HAVING count(*) FILTER (obs_id LIKE '%F') >= any_value(nc) * 0.5 AND count(*) FILTER (obs_id NOT LIKE '%F') >= any_value(n - nc) * 0.5),
  x AS (SELECT var_id, value, i FROM logs JOIN ok USING (var_id) JOIN o USING (obs_id)),
  perms AS (SELECT m FROM k, range((1 << n::INT)::BIGINT) t(m) WHERE bit_count(m) = nc),
  mom AS (SELECT m, var_id, count(*) FILTER (m >> i & 1 = 1) AS nc, avg(value) FILTER (m >> i & 1 = 1) AS mc, var_samp(value) FILTER (m >> i & 1 = 1) AS vc, count(*) FILTER (m >> i & 1 = 0) AS ne, avg(value) FILTER (m >> i & 1 = 0) AS me, var_samp(value) FILTER (m >> i & 1 = 0) AS ve FROM x, perms GROUP BY ALL),
  st AS (SELECT m, var_id, CASE WHEN nc > 1 AND ne > 1 AND vc / nc + ve / ne > 0 THEN round(abs(me - mc) / sqrt(vc / nc + ve / ne), 7) END AS s FROM mom),
  seen AS (SELECT var_id, s FROM st, k WHERE m = (1 << k.nc::INT) - 1), pool AS (SELECT s, count(*) AS c FROM st WHERE s IS NOT NULL GROUP BY s),
  ge AS (SELECT s, sum(c) OVER (ORDER BY s DESC) AS fp, sum(c) OVER () AS total FROM pool)"""


@query("de_permutation_exact", f"WITH {LINES}, {PROFILES}, {EXACT} SELECT seen.var_id AS features, round((fp + 1)::DOUBLE / (total + 1), 4) AS p_value FROM seen LEFT JOIN ge USING (s)")
def de_permutation(spark, sf_dir):
    study = normalise.log2_transform(profiles(spark, sf_dir), "peptide")
    ctrl = sorted(r.obs_id for r in study.obs.where("status = 'F'").collect())
    expr = sorted(r.obs_id for r in study.obs.where("status <> 'F'").collect())
    kind, plan = de.permutations(ctrl, expr, 1000)
    x = study["peptide"].x
    rows = [(i, o, o in c) for i, c in enumerate(plan) for o in (*ctrl, *expr)]
    perms = F.broadcast(spark.createDataFrame(rows, "perm_id int, obs_id string, is_ctrl boolean"))
    sides = F.col("obs_id").isin(ctrl)
    enough = x.where("value is not null").groupBy("var_id").agg(F.count_if(sides).alias("c"), F.count_if(~sides).alias("e")).where((F.col("c") >= 0.5 * len(ctrl)) & (F.col("e") >= 0.5 * len(expr)))
    spread = x.join(enough.select("var_id"), "var_id", "left_semi").join(perms, "obs_id")
    # Statistics are rounded so that ties between permutations are the same on any engine.
    null = de.cut(de.statistics(spread, ["perm_id", "var_id"], "welch", pvalues=False).withColumn("stat", F.round(F.abs("stat"), 7)))
    first = next(i for i, c in enumerate(plan) if c == set(ctrl))
    out = fdr.pooled_pvalues(null.where(F.col("perm_id") == first).select("var_id", "stat"), null.select("var_id", "stat"))
    return rounded(out.select(F.col("var_id").alias("features"), "p_value"), "p_value", digits=4)


@query("de_empirical")
def de_empirical(spark, sf_dir):
    study = normalise.log2_transform(profiles(spark, sf_dir), "peptide")
    out = de.run_de(study, "peptide", "status", "F", "O")
    return rounded(out.volcano(), "repr_ctrl", "repr_expr", "log2fc", "stat", "p_value", "q_value", "logp", digits=4)


EDGES = "e AS (SELECT DISTINCT 'o' || l_orderkey AS peptide, 'p' || l_partkey AS protein FROM lineitem)"


def _edges(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("peptide"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("protein")).distinct()


@query("protein_degrees", f"WITH {EDGES}, d AS (SELECT peptide, count(*) AS n FROM e GROUP BY ALL) SELECT protein, count(*) FILTER (n > 1) AS shared_peptides, count(*) FILTER (n = 1) AS unique_peptides FROM e JOIN d USING (peptide) GROUP BY ALL")
def protein_degrees(spark, sf_dir):
    return inference.degrees(_edges(spark, sf_dir))[1]


SETS = "e AS (SELECT DISTINCT o_orderpriority AS peptide, 'c' || o_custkey AS protein FROM orders)"


def _sets(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("peptide"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("protein")).distinct()


@query("protein_indistinguishable", f"""WITH {SETS}, s AS (SELECT protein, list(peptide ORDER BY peptide) AS ps FROM e GROUP BY ALL), g AS (SELECT ps, string_agg(protein, ',' ORDER BY protein) AS names, count(*) AS n FROM s GROUP BY ALL)
  SELECT protein, sha256(names) AS members FROM s JOIN g USING (ps) WHERE n > 1""")
def same_sets(spark, sf_dir):
    members, names = inference.same_peptides(_sets(spark, sf_dir))
    return members.join(names.select("id", F.sha2("group", 256).alias("members")), "id").select("protein", "members")


@query("protein_subsets", """WITH e AS (SELECT DISTINCT l_partkey AS peptide, l_orderkey AS protein FROM lineitem), l AS (SELECT protein, list(peptide ORDER BY peptide) AS ps FROM e GROUP BY protein),
  s AS (SELECT min(protein)::VARCHAR AS protein, len(ps) AS n, unnest(ps) AS peptide FROM l GROUP BY ps),
  i AS (SELECT a.protein AS parent, b.protein AS child FROM s a JOIN s b USING (peptide) WHERE a.n > b.n GROUP BY a.protein, b.protein, b.n HAVING count(*) = b.n), r AS (SELECT * FROM i WHERE parent NOT IN (SELECT child FROM i))
  SELECT child AS protein, max(parent) AS "group" FROM r GROUP BY ALL""")
def protein_subsets(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("peptide"), F.col("l_orderkey").alias("protein")).distinct()
    names = edges.groupBy("protein").agg(F.sort_array(F.collect_set("peptide")).alias("ps")).groupBy("ps").agg(F.min("protein").cast("string").alias("protein"))
    return inference.subsets(names.select(F.explode("ps").alias("peptide"), "protein"))


@query("infer_protein")
def infer_protein(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_set("l_partkey")), lambda p: F.concat(F.lit("p"), p.cast("string"))), ";").alias("proteins"))
    return inference.infer(rows.select(F.col("l_orderkey").cast("string").alias("stripped_peptide"), "proteins"))[1]


@query("corr_pearson", f"""WITH {LINES}, {PROFILES} SELECT a.obs_id AS obs_i, b.obs_id AS obs_j, round(corr(a.value, b.value), 5) + 0.0 AS r FROM profiles a JOIN profiles b USING (var_id) GROUP BY ALL""")
def corr_pearson(spark, sf_dir):
    return rounded(multivariate.corr(profiles(spark, sf_dir)["peptide"].x), "r")


@query("corr_spearman", f"""WITH {LINES}, {PROFILES}, j AS (SELECT a.obs_id AS obs_i, b.obs_id AS obs_j, a.value AS a, b.value AS b FROM profiles a JOIN profiles b USING (var_id)),
  r AS (SELECT obs_i, obs_j, rank() OVER (PARTITION BY obs_i, obs_j ORDER BY a) + (count(*) OVER (PARTITION BY obs_i, obs_j, a) - 1) / 2.0 AS a, rank() OVER (PARTITION BY obs_i, obs_j ORDER BY b) + (count(*) OVER (PARTITION BY obs_i, obs_j, b) - 1) / 2.0 AS b FROM j)
  SELECT obs_i, obs_j, round(corr(a, b), 5) + 0.0 AS r FROM r GROUP BY ALL""")
def corr_spearman(spark, sf_dir):
    return rounded(multivariate.corr(profiles(spark, sf_dir)["peptide"].x, method="spearman"), "r")


@query("corr_kendall", f"""WITH {LINES}, {PROFILES}, j AS (SELECT a.obs_id AS obs_i, b.obs_id AS obs_j, var_id, a.value AS a, b.value AS b FROM profiles a JOIN profiles b USING (var_id)),
  s AS (SELECT x.obs_i, x.obs_j, sum(sign(x.a - y.a) * sign(x.b - y.b)) AS score, count(*) FILTER (x.a <> y.a) AS na, count(*) FILTER (x.b <> y.b) AS nb FROM j x JOIN j y ON x.obs_i = y.obs_i AND x.obs_j = y.obs_j AND x.var_id < y.var_id GROUP BY ALL)
  SELECT obs_i, obs_j, round(score / sqrt(na::DOUBLE * nb), 5) + 0.0 AS r FROM s""")
def corr_kendall(spark, sf_dir):
    return rounded(multivariate.corr(profiles(spark, sf_dir)["peptide"].x, method="kendall"), "r")


@query("pca_gram", f"""WITH {LINES}, {PROFILES}, w AS (SELECT var_id FROM profiles GROUP BY var_id HAVING count(*) = (SELECT count(DISTINCT obs_id) FROM profiles)),
  c AS (SELECT obs_id, var_id, value - avg(value) OVER (PARTITION BY var_id) AS v FROM profiles JOIN w USING (var_id))
  SELECT a.obs_id AS obs_i, b.obs_id AS obs_j, round(sum(a.v * b.v) / 1e6, 4) + 0.0 AS g FROM c a JOIN c b USING (var_id) WHERE a.obs_id <= b.obs_id GROUP BY ALL""")
def pca_gram(spark, sf_dir):
    from ..operators.filters import complete_features

    study = profiles(spark, sf_dir)
    g = multivariate.gram(complete_features(study["peptide"].x, study.obs.count()))
    return rounded(g.withColumn("g", F.col("g") / 1e6), "g", digits=4)


@query("pca_scores")
def pca_scores(spark, sf_dir):
    out = multivariate.pca(profiles(spark, sf_dir)["peptide"].x)["scores"]
    return rounded(out, *(c for c in out.columns if c != "obs_id"), digits=3)


@query("umap_layout")
def umap_layout(spark, sf_dir):
    return multivariate.umap(profiles(spark, sf_dir)["peptide"].x, n_neighbors=3)
