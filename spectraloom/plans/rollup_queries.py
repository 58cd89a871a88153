"""Roll-up, filter, rank and identification queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import peptide as pep
from ..functions.ranges import average_rank
from ..model import Assay, Study
from ..operators import filters, merge, ptm, rollup
from ..operators.inference import representative
from .proxies import LINES, PROFILES, lines, profiles, rounded, table
from .registry import query


def _by_peptide(method: str):
    def run(spark, sf_dir):
        x = lines(spark, sf_dir).where("purity > 0.02").select("peptide", "obs_id", "value")
        return rounded(rollup.values_by_group(x, "peptide", method), "value")

    return run


for _name, _method, _sql in (("rollup_to_peptide", "median", "median"), ("rollup_mean", "mean", "avg"), ("rollup_sum", "sum", "sum")):
    query(_name, f"WITH {LINES} SELECT peptide, obs_id, round({_sql}(value), 5) + 0.0 AS value FROM lines WHERE purity > 0.02 GROUP BY ALL")(_by_peptide(_method))


@query("rollup_sum_missing_as_zero", f"""WITH {LINES}, g AS (SELECT DISTINCT peptide FROM lines), o AS (SELECT DISTINCT obs_id FROM lines), s AS (SELECT peptide, obs_id, sum(value) AS v FROM lines WHERE purity > 0.05 GROUP BY ALL)
  SELECT g.peptide, o.obs_id, round(coalesce(v, 0), 5) + 0.0 AS value FROM g CROSS JOIN o LEFT JOIN s ON s.peptide = g.peptide AND s.obs_id = o.obs_id""")
def sum_with_zero(spark, sf_dir):
    rows = lines(spark, sf_dir)
    values = rollup.values_by_group(rows.where("purity > 0.05").select("peptide", "obs_id", "value"), "peptide", "sum")
    return rounded(rollup.with_missing_as_zero(values, "peptide", rows, rows.select("obs_id").distinct()), "value")


@query("peptide_identifications", f"WITH {LINES} SELECT peptide, count(*) AS count_psm, min(pep) AS PEP, round(-log10(min(pep) + 1e-10), 5) + 0.0 AS picked_score FROM lines GROUP BY ALL")
def identifications(spark, sf_dir):
    rows = lines(spark, sf_dir).withColumnRenamed("pep", "PEP")
    out = rows.groupBy("peptide").agg(F.count("*").alias("count_psm"), rollup.best_pep().alias("PEP"), rollup.picked_score().alias("picked_score"))
    return rounded(out, "picked_score")


@query("protein_identifications", f"""WITH {LINES}, p AS (SELECT peptide, count(*) AS c, min(pep) AS pep FROM lines GROUP BY ALL)
  SELECT p_brand AS protein_group, sum(c)::BIGINT AS count_psm, count(DISTINCT p_type) AS count_stripped_peptide, min(pep) AS PEP FROM p JOIN part ON p_partkey::VARCHAR = peptide GROUP BY ALL""")
def protein_identifications(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("peptide"), F.col("p_brand").alias("protein_group"), F.col("p_type").alias("stripped_peptide"))
    rows = lines(spark, sf_dir).groupBy("peptide").agg(F.count("*").alias("count_psm"), F.min("pep").alias("PEP")).join(part, "peptide").withColumn("var_ord", F.lit(0))
    return rollup.protein_rows(rows).drop("var_ord")


FEATURES = "features AS (SELECT var_id, peptide, obs_id, avg(value) AS value FROM lines GROUP BY ALL)"
RANKED = """scores AS (SELECT var_id, peptide, round(sum(value), 5) AS score FROM features GROUP BY ALL),
 ranked AS (SELECT *, rank() OVER (PARTITION BY peptide ORDER BY score DESC) + (count(*) OVER (PARTITION BY peptide, score) - 1) / 2.0 AS rnk FROM scores)"""


def _features(spark, sf_dir):
    x = lines(spark, sf_dir).groupBy("var_id", "peptide", "obs_id").agg(F.avg("value").alias("value"))
    return x.select("var_id", "obs_id", "value"), x.select("var_id", "peptide").distinct()


@query("feature_ranks", f"WITH {LINES}, {FEATURES}, {RANKED} SELECT var_id, peptide, rnk::DOUBLE AS rank FROM ranked")
def feature_ranks(spark, sf_dir):
    x, var = _features(spark, sf_dir)
    return rollup.feature_ranks(x, var, "peptide", "total_intensity")


@query("rollup_top_n", f"""WITH {LINES}, {FEATURES}, {RANKED}
  SELECT f.peptide, obs_id, round(median(value), 5) + 0.0 AS value FROM features f JOIN ranked r USING (var_id) WHERE rnk <= 3 GROUP BY ALL""")
def top_n(spark, sf_dir):
    x, var = _features(spark, sf_dir)
    x = rollup.top_features(x, var, "peptide", 3, "total_intensity").join(var, "var_id")
    return rounded(rollup.values_by_group(x, "peptide", "median"), "value")


@query("rollup_to_protein", f"""WITH {LINES}, {PROFILES}, s AS (SELECT var_id, protein_group, median(value) AS score FROM profiles JOIN (SELECT p_partkey::VARCHAR AS var_id, p_brand AS protein_group FROM part) USING (var_id) GROUP BY ALL),
  r AS (SELECT *, rank() OVER (PARTITION BY protein_group ORDER BY score DESC) + (count(*) OVER (PARTITION BY protein_group, score) - 1) / 2.0 AS rnk FROM s)
  SELECT protein_group AS var_id, obs_id, round(median(value), 5) + 0.0 AS value FROM profiles JOIN r USING (var_id) WHERE rnk <= 3 GROUP BY ALL""")
def to_protein(spark, sf_dir):
    study = profiles(spark, sf_dir)
    a = study["peptide"]
    var = a.var.withColumn("peptide_type", F.lit("unique")).withColumn("count_psm", F.lit(1)).withColumn("stripped_peptide", F.col("var_id"))
    out = rollup.to_protein(study.with_assay("peptide", a.with_(var=var)), top_n=3)
    return rounded(out["protein"].x.select("var_id", "obs_id", "value"), "value")


KEEP_SQL = {"eq": "p_size = 25", "ne": "p_size IS DISTINCT FROM 25", "lt": "p_size < 25", "le": "p_size <= 25", "gt": "p_size > 25", "ge": "p_size >= 25"}


@query("filter_predicates", "SELECT p_partkey, " + ", ".join(f"coalesce({s}, false) AS size_{k}" for k, s in KEEP_SQL.items()) + ", regexp_matches(p_type, 'BR|TIN$') AS type_contains, NOT regexp_matches(p_type, 'BR|TIN$') AS type_not_contains FROM part")
def predicates(spark, sf_dir):
    columns = [filters.predicate("p_size", k, 25).alias(f"size_{k}") for k in KEEP_SQL]
    columns += [filters.predicate("p_type", k, "BR|TIN$").alias(f"type_{k}") for k in ("contains", "not_contains")]
    return table(spark, sf_dir, "part").select("p_partkey", *columns)


@query("filter_apply", f"""WITH {LINES}, {PROFILES} SELECT var_id, obs_id, round(value, 5) + 0.0 AS value FROM profiles
  WHERE var_id IN (SELECT p_partkey::VARCHAR FROM part WHERE p_size >= 10 AND p_size < 40 AND NOT regexp_matches(p_brand, '3$'))""")
def apply(spark, sf_dir):
    study = profiles(spark, sf_dir)
    for column, keep, value in (("size", "ge", 10), ("size", "lt", 40), ("protein_group", "not_contains", "3$")):
        study = filters.add_filter(study, "peptide", column, keep, value)
    return rounded(filters.apply_filter(study, "peptide")["peptide"].x, "value")


@query("subset_samples_and_features", f"""WITH {LINES}, {PROFILES} SELECT var_id, obs_id, round(value, 5) + 0.0 AS value FROM profiles
  WHERE obs_id LIKE '%O' AND var_id IN (SELECT p_partkey::VARCHAR FROM part WHERE p_size % 2 = 0)""")
def subset(spark, sf_dir):
    return rounded(filters.subset(profiles(spark, sf_dir), "peptide", cond_var="size % 2 = 0", cond_obs="status = 'O'")["peptide"].x, "value")


@query("split_sets", f"""WITH {LINES} SELECT obs_id || '_' || CASE WHEN filename::INT % 2 = 0 THEN 'even' ELSE 'odd' END AS obs_id, count(*) AS n, round(sum(value), 2) AS total FROM lines GROUP BY ALL""")
def split_sets(spark, sf_dir):
    rows = lines(spark, sf_dir)
    rows = rows.withColumn("var_id", F.concat_ws(":", "filename", "peptide"))
    var = rows.select("var_id", "filename").distinct().withColumn("var_ord", F.lit(0))
    obs = rows.select("obs_id").distinct().withColumn("obs_ord", F.lit(0))
    names = {r.filename: "even" if int(r.filename) % 2 == 0 else "odd" for r in rows.select("filename").distinct().collect()}
    study = filters.split_sets(Study({"psm": Assay(rows.select("obs_id", "var_id", "value"), var)}, obs), names)
    return study["psm"].x.groupBy("obs_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("reindex_samples", f"WITH {LINES}, {PROFILES} SELECT substr(obs_id, 2, 1) || substr(obs_id, 1, 1) AS obs_id, count(*) AS n FROM profiles GROUP BY ALL")
def reindex(spark, sf_dir):
    study = profiles(spark, sf_dir)
    study = study.with_(obs=study.obs.withColumn("turned", F.concat("status", "group")))
    return filters.reindex_obs(study, "turned")["peptide"].x.groupBy("obs_id").agg(F.count("*").alias("n"))


@query("complete_features", f"""WITH {LINES}, {PROFILES} SELECT var_id, obs_id, round(value, 5) + 0.0 AS value FROM profiles
  WHERE var_id IN (SELECT var_id FROM profiles GROUP BY var_id HAVING count(*) = (SELECT count(DISTINCT obs_id) FROM profiles))""")
def complete(spark, sf_dir):
    study = profiles(spark, sf_dir)
    return rounded(filters.complete_features(study["peptide"].x, study.obs.count()), "value")


@query("merge_studies", f"""WITH {LINES}, {PROFILES}, a AS (SELECT * FROM profiles WHERE obs_id LIKE '%F'), b AS (SELECT * FROM profiles WHERE obs_id LIKE '%O')
  SELECT CASE WHEN obs_id LIKE '%F' THEN 'first' ELSE 'second' END AS dataset, obs_id, count(*) AS n, round(sum(value), 2) AS total FROM profiles GROUP BY ALL""")
def merged(spark, sf_dir):
    study = profiles(spark, sf_dir)
    parts = {name: filters.subset(study, cond_obs=f"status = '{s}'") for name, s in (("first", "F"), ("second", "O"))}
    out = merge.merge_studies(parts)
    return out["peptide"].x.join(F.broadcast(out.obs.select("obs_id", "dataset")), "obs_id").groupBy("dataset", "obs_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("add_quant", "SELECT var_id, obs_id, value FROM (SELECT p_partkey::VARCHAR AS var_id, unnest(['one', 'two']) AS obs_id, unnest([p_retailprice, CASE WHEN p_size % 3 = 0 THEN 0 ELSE p_size END::DOUBLE]) AS value FROM part) WHERE value <> 0")
def add_quant(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    wide = part.select(F.col("p_partkey").cast("string").alias("Sequence"), F.col("p_retailprice").alias("Intensity_one"), F.when(F.col("p_size") % 3 == 0, 0).otherwise(F.col("p_size")).alias("Intensity_two"), F.lit(1.0).alias("Intensity_three"))
    obs = spark.createDataFrame([("one", 0), ("two", 1)], "obs_id string, obs_ord int")
    return merge.add_quant(Study({}, obs), wide, "flashlfq")["peptide"].x.select("var_id", "obs_id", "value")


@query("category_order", "WITH f AS (SELECT o_orderpriority AS p, min(o_orderkey) AS k FROM orders GROUP BY ALL) SELECT p AS o_orderpriority, row_number() OVER (ORDER BY k) - 1 AS place FROM f")
def category_order(spark, sf_dir):
    out = merge.with_order(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderkey")
    return out.select("o_orderpriority", F.col("o_orderpriority_ord").cast("long").alias("place")).distinct()


LETTERS = "upper(regexp_replace(text, '[^A-Za-z]', '', 'g'))"


@query("peptide_functions", f"""WITH d AS (SELECT doc_id, {LETTERS} AS p FROM documents WHERE text IS NOT NULL)
  SELECT doc_id, len(regexp_extract_all(p, '[KR]')) - len(regexp_extract_all(p, '[KR]P')) AS missed, sha256(p) AS stripped, length(p) AS n, round((length(p) * 111.1 + 2 * 1.007276466812) / 2, 5) AS mz FROM d""")
def peptide_functions(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("p"))
    # A mass after the sequence must not change what is left of it.
    return d.select("doc_id", pep.missed_cleavages(F.col("p")).cast("long").alias("missed"), F.sha2(pep.stripped(F.concat(F.col("p"), F.lit("[+57.02]"))), 256).alias("stripped"), F.length("p").cast("long").alias("n"), F.round(pep.mass_to_charge(F.length("p") * F.lit(111.1), F.lit(2)), 5).alias("mz"))


@query("accession_parse", "SELECT p_partkey, 'rev_P' || p_partkey || ';contam_Q' || p_size || ';R' || p_partkey AS proteins FROM part")
def accession_parse(spark, sf_dir):
    listed = F.concat(F.lit("rev_sp|P"), F.col("p_partkey").cast("string"), F.lit("|N;contam_tr|Q"), F.col("p_size").cast("string"), F.lit("|M;R"), F.col("p_partkey").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", pep.accessions(listed).alias("proteins"))


@query("file_stems", "SELECT page_id, regexp_replace(regexp_extract(url, '([^/]+)$', 1), '\\.[^.]*$', '') AS stem FROM pages")
def stems(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", pep.file_stem(F.col("url")).alias("stem"))


@query("ptm_sites", f"""WITH d AS (SELECT doc_id, {LETTERS} AS s FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, s, substr(s, 11, 12) AS p FROM d WHERE length(s) >= 40),
  k AS (SELECT doc_id, p, list_transform(string_split(s, p), lambda x: length(x)) AS ls FROM p),
  o AS (SELECT doc_id, p, list_transform(range(1, len(ls)), lambda i: list_sum(ls[1:i])::BIGINT + (i - 1) * 12 + 1) AS starts FROM k)
  SELECT doc_id, array_to_string(list_transform(starts, lambda x: 'A' || doc_id || '|' || substr(p, 5, 1) || (x + 4)), '/') AS protein_site, 'A' || doc_id AS modified_protein FROM o""")
def ptm_sites(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.concat(F.lit("A"), F.col("doc_id").cast("string")).alias("accession"), F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("sequence"))
    d = d.where(F.length("sequence") >= 40).withColumn("stripped_peptide", F.substring("sequence", 11, 12))
    var = d.select(F.col("doc_id").alias("var_id"), F.concat(F.substring("stripped_peptide", 1, 5), F.lit("[+79.97]"), F.substring("stripped_peptide", 6, 9)).alias("peptide"), "stripped_peptide", F.col("accession").alias("protein_group"))
    out = ptm.sites(var, d.select("accession", "sequence"), "[+79.97]")
    return out.select(F.col("var_id").alias("doc_id"), "protein_site", "modified_protein")


@query("representative_protein", """WITH g AS (SELECT o_orderkey, list_distinct(list(l_partkey ORDER BY l_partkey)) AS ps FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL),
  s AS (SELECT array_to_string(list_sort(ps), ',') AS protein_group, list_sort(ps) AS ps FROM g), u AS (SELECT DISTINCT * FROM s),
  m AS (SELECT protein_group, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM u), c AS (SELECT *, CASE p % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 4 END AS k FROM m),
  b AS (SELECT protein_group, min(k) AS k FROM c GROUP BY ALL)
  SELECT protein_group, string_agg(CASE k WHEN 1 THEN p::VARCHAR WHEN 2 THEN p || '-2' WHEN 3 THEN p::VARCHAR ELSE 'contam_sp_' || p END, ',' ORDER BY i) AS representative FROM c JOIN b USING (protein_group, k) GROUP BY ALL""")
def representative_protein(spark, sf_dir):
    part = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey"), F.col("l_partkey")).join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    groups = part.groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_set("l_partkey")), lambda p: p.cast("string")), ",").alias("protein_group")).select("protein_group")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("p"), F.col("p_partkey").cast("string").alias("accession"))
    kind = F.when(F.col("p") % 4 == 0, F.concat(F.lit("sp_"), "accession")).when(F.col("p") % 4 == 1, F.concat(F.lit("sp_"), "accession", F.lit("-2"))).when(F.col("p") % 4 == 2, F.concat(F.lit("tr_"), "accession")).otherwise(F.concat(F.lit("contam_sp_"), "accession"))
    return representative(groups, p.select("accession", kind.alias("kind_id")))


@query("average_ranks", "SELECT p_partkey, (rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0)::DOUBLE AS rank FROM part")
def average_ranks(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", average_rank(["p_brand"], "p_size").alias("rank"))
