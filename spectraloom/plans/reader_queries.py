"""Readers, FASTA annotation, whole roll-ups with error rates and sites, over driver tables in the shape of each engine's results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import Assay, Study
from ..operators import ptm, rollup
from ..sources import fasta, readers
from ..sources.tables import read_table
from .proxies import rounded, table
from .registry import query


def _s(column: str):
    return F.col(column).cast("string")


def _long(df, *columns):
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders")


def _totals(x):
    return x.groupBy("obs_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


# -- FragPipe


def _fragpipe(spark, sf_dir):
    o, c = _orders(spark, sf_dir), _s("o_custkey")
    price = F.col("o_totalprice")
    return o.select(
        F.concat(F.lit("run"), (F.col("o_custkey") % 3).cast("string"), F.lit("."), _s("o_orderkey"), F.lit("."), _s("o_orderkey"), F.lit(".2")).alias("Spectrum"),
        F.concat(F.when(F.col("o_orderstatus") == "P", "rev_").otherwise(""), F.lit("sp|P"), c, F.lit("|X")).alias("Protein"),
        F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("sp|Q"), c, F.lit("|Y, tr|R1|Z"))).alias("Mapped Proteins"),
        F.lit("PEPTIDEK").alias("Peptide"),
        F.when(F.col("o_custkey") % 4 == 0, "PEPT[80]IDEK").otherwise("").alias("Modified Peptide"),
        F.lit(2).alias("Charge"),
        F.lit(8).alias("Peptide Length"),
        F.lit(1).alias("Number of Missed Cleavages"),
        price.alias("Retention"),
        F.lit(900.5).alias("Calculated Peptide Mass"),
        price.alias("a"),
        (F.col("o_custkey") % 5).cast("double").alias("b"),
    )


@query("read_fragpipe_identifications", """SELECT 'run' || (o_custkey % 3) || '.' || o_orderkey AS var_id, 'P' || o_custkey || CASE WHEN o_custkey % 2 = 0 THEN ';Q' || o_custkey || ';R1' ELSE '' END AS proteins,
  CASE WHEN o_custkey % 4 = 0 THEN 'PEPT[80]IDEK' ELSE 'PEPTIDEK' END AS peptide, 'PEPTIDEK' AS stripped_peptide, 'run' || (o_custkey % 3) AS filename, o_orderkey::BIGINT AS scan_num, 2::BIGINT AS charge,
  8::BIGINT AS peptide_length, 1::BIGINT AS missed_cleavages, round(o_totalprice / 60, 5) AS rt, 900.5::DOUBLE AS calcmass FROM orders WHERE o_orderstatus <> 'P'""")
def fragpipe_identifications(spark, sf_dir):
    var = readers.read_fragpipe(spark, _fragpipe(spark, sf_dir), "tmt")["psm"].var.drop("var_ord")
    return rounded(_long(var, "scan_num", "charge", "peptide_length", "missed_cleavages"), "rt", "calcmass")


@query("read_fragpipe_tmt", """SELECT obs_id, count(*) AS n, round(sum(value), 3) AS total FROM (SELECT unnest(['a', 'b']) AS obs_id, unnest([o_totalprice, (o_custkey % 5)::DOUBLE]) AS value FROM orders WHERE o_orderstatus <> 'P') WHERE value <> 0 GROUP BY ALL""")
def fragpipe_tmt(spark, sf_dir):
    return _totals(readers.read_fragpipe(spark, _fragpipe(spark, sf_dir), "tmt")["psm"].x)


@query("read_fragpipe_lfq", """SELECT * FROM (SELECT 'SEQ' || p_partkey AS var_id, unnest(['a', 'b']) AS obs_id, unnest([(p_size % 7)::DOUBLE, p_retailprice]) AS value FROM part) WHERE value <> 0""")
def fragpipe_lfq(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    quant = part.select(F.concat(F.lit("SEQ"), _s("p_partkey")).alias("Modified Sequence"), (F.col("p_size") % 7).cast("double").alias("a Intensity"), F.col("p_retailprice").alias("b Intensity"))
    return readers.read_fragpipe(spark, _fragpipe(spark, sf_dir).drop("a", "b"), "label_free", quantification_file=quant)["peptide"].x.select("var_id", "obs_id", "value")


# -- MaxQuant


def _maxquant(spark, sf_dir):
    o, c = _orders(spark, sf_dir), _s("o_custkey")
    decoy, contaminant = F.col("o_orderstatus") == "P", F.col("o_custkey") % 11 == 0
    return o.select(
        F.when(F.col("o_orderpriority").startswith("1"), "MULTI-SECPEP").otherwise("MULTI-MSMS").alias("Type"),
        F.lit("PEPTIDEK").alias("Sequence"),
        F.concat(F.lit("_PEP"), (F.col("o_custkey") % 50).cast("string"), F.lit("_")).alias("Modified sequence"),
        F.lit(8).alias("Length"),
        F.lit(0).alias("Missed cleavages"),
        F.lit(3).alias("Charge"),
        F.concat(F.lit("f"), (F.col("o_custkey") % 3).cast("string")).alias("Raw file"),
        F.col("o_orderkey").alias("MS/MS scan number"),
        F.col("o_totalprice").alias("Retention time"),
        F.concat(F.when(contaminant, "CON__").otherwise(""), F.lit("P"), c).alias("Proteins"),
        F.concat(F.lit("REV__P"), c).alias("Leading proteins"),
        F.when(decoy, "+").alias("Reverse"),
        F.when(contaminant, "+").alias("Potential contaminant"),
        (F.col("o_custkey") % 5 * 1.5).alias("Intensity"),
        F.col("o_totalprice").alias("Reporter intensity corrected 1"),
        (F.col("o_custkey") % 5).cast("double").alias("Reporter intensity corrected 2"),
    )


SPECTRA = "m AS (SELECT *, 'f' || (o_custkey % 3) AS filename FROM orders WHERE o_orderpriority NOT LIKE '1%')"


@query("read_maxquant_identifications", f"""WITH {SPECTRA} SELECT filename || '.' || o_orderkey AS var_id, CASE WHEN o_custkey % 11 = 0 THEN 'contam_' ELSE '' END || 'P' || o_custkey AS proteins, '_PEP' || (o_custkey % 50) || '_' AS peptide,
  'PEPTIDEK' AS stripped_peptide, filename, o_orderkey::BIGINT AS scan_num, 3::BIGINT AS charge, 8::BIGINT AS peptide_length, 0::BIGINT AS missed_cleavages, (o_custkey % 11 = 0)::BIGINT AS contaminant, round(o_totalprice, 5) AS rt FROM m WHERE o_orderstatus <> 'P'""")
def maxquant_identifications(spark, sf_dir):
    var = readers.read_maxquant(spark, _maxquant(spark, sf_dir), "tmt")["psm"].var.drop("var_ord")
    return rounded(_long(var, "scan_num", "charge", "peptide_length", "missed_cleavages", "contaminant"), "rt")


@query("read_maxquant_decoys", f"WITH {SPECTRA} SELECT filename || '.' || o_orderkey AS var_id, 'rev_P' || o_custkey AS proteins FROM m WHERE o_orderstatus = 'P'")
def maxquant_decoys(spark, sf_dir):
    return readers.read_maxquant(spark, _maxquant(spark, sf_dir), "tmt")["psm"].decoy.select("var_id", "proteins")


@query("read_maxquant_tmt", f"""WITH {SPECTRA} SELECT obs_id, count(*) AS n, round(sum(value), 3) AS total FROM (SELECT unnest(['126', '127']) AS obs_id, unnest([o_totalprice, (o_custkey % 5)::DOUBLE]) AS value FROM m WHERE o_orderstatus <> 'P') WHERE value <> 0 GROUP BY ALL""")
def maxquant_tmt(spark, sf_dir):
    return _totals(readers.read_maxquant(spark, _maxquant(spark, sf_dir), "tmt")["psm"].x)


@query("read_maxquant_lfq", f"""WITH {SPECTRA} SELECT '_PEP' || (o_custkey % 50) || '_' AS var_id, filename AS obs_id, round(sum((o_custkey % 5)::DOUBLE * 1.5), 3) AS value FROM m GROUP BY ALL HAVING sum(o_custkey % 5) <> 0""")
def maxquant_lfq(spark, sf_dir):
    return rounded(readers.read_maxquant(spark, _maxquant(spark, sf_dir), "label_free")["peptide"].x.select("var_id", "obs_id", "value"), "value", digits=3)


# -- Sage, DIA-NN


def _sage(spark, sf_dir):
    o, c = _orders(spark, sf_dir), _s("o_custkey")
    proteins = F.concat(F.when(F.col("o_custkey") % 11 == 0, "contam_").otherwise(""), F.lit("sp|P"), c, F.lit("|X;tr|Q"), c, F.lit("|Y"))
    fixed = {"peptide_len": F.lit(8), "charge": F.lit(2), "missed_cleavages": F.lit(0), "semi_enzymatic": F.lit(1), "calcmass": F.lit(900.5)}
    return o.select(proteins.alias("proteins"), F.lit("run/one.mzML").alias("filename"), F.concat(F.lit("controllerType=0 scan="), _s("o_orderkey")).alias("scannr"), F.lit("[+229.16]-PEPTK[+229.16]IDE").alias("peptide"), F.when(F.col("o_orderstatus") == "P", -1).otherwise(1).alias("label"), (F.col("o_custkey") % 4 - 5).cast("double").alias("posterior_error"), (F.col("o_totalprice") / 1e6).alias("spectrum_q"), F.col("o_totalprice").alias("rt"), *(v.alias(k) for k, v in fixed.items()))


@query("read_sage_identifications", """SELECT 'one.' || o_orderkey AS var_id, CASE WHEN o_custkey % 11 = 0 THEN 'contam_' ELSE '' END || 'P' || o_custkey || ';Q' || o_custkey AS proteins, '[+229.16]-PEPTK[+229.16]IDE' AS peptide, 'PEPTKIDE' AS stripped_peptide,
  'one' AS filename, o_orderkey::BIGINT AS scan_num, 2::BIGINT AS charge, 8::BIGINT AS peptide_length, 0::BIGINT AS missed_cleavages, 1::BIGINT AS semi_enzymatic, (o_custkey % 11 = 0)::BIGINT AS contaminant,
  round(10.0 ** (o_custkey % 4 - 5), 8) AS PEP, round(o_totalprice / 1e6, 8) AS q_value, round(o_totalprice, 8) AS rt, 900.5::DOUBLE AS calcmass FROM orders WHERE o_orderstatus <> 'P'""")
def sage_identifications(spark, sf_dir):
    var = readers.read_sage(spark, _sage(spark, sf_dir), "tmt")["psm"].var.drop("var_ord")
    return rounded(_long(var, "scan_num", "charge", "peptide_length", "missed_cleavages", "semi_enzymatic", "contaminant"), "PEP", "q_value", "rt", "calcmass", digits=8)


@query("read_sage_lfq", """SELECT p_brand AS var_id, obs_id, round(sum(value), 3) AS value FROM (SELECT p_brand, unnest(['a', 'b']) AS obs_id, unnest([p_retailprice, (p_size % 7)::DOUBLE]) AS value FROM part) GROUP BY ALL HAVING sum(value) <> 0""")
def sage_lfq(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    quant = part.select(F.col("p_brand").alias("peptide"), F.lit(2).alias("charge"), F.lit("sp|P1|X").alias("proteins"), F.lit(0.0).alias("q_value"), F.lit(1.0).alias("score"), F.lit(1.0).alias("spectral_angle"), F.col("p_retailprice").alias("run/a.mzML"), (F.col("p_size") % 7).cast("double").alias("run/b.mzML"))
    return rounded(readers.read_sage(spark, _sage(spark, sf_dir), "label_free", quant)["peptide"].x.select("var_id", "obs_id", "value"), "value", digits=3)


@query("read_diann_identifications", """SELECT 'r' || (p_size % 4) || '.pre' || p_partkey AS var_id, 'P' || p_partkey || ';Q' || p_size AS proteins, 'PEPK(UniMod:1)RP' AS peptide, 'PEPKRP' AS stripped_peptide, 'r' || (p_size % 4) AS filename,
  2::BIGINT AS charge, 6::BIGINT AS peptide_length, 1::BIGINT AS missed_cleavages, CASE WHEN p_size % 5 <> 0 THEN round(p_retailprice / 1e5, 8) END AS PEP, round(p_retailprice / 1e6, 8) AS q_value, 1.5::DOUBLE AS rt, 400.25::DOUBLE AS calcmass, 'pre' || p_partkey AS precursor FROM part""")
def diann_identifications(spark, sf_dir):
    part, price = table(spark, sf_dir, "part"), F.col("p_retailprice")
    pep = F.when(F.col("p_size") % 5 == 0, float("nan")).otherwise(price / 1e5)
    raw = part.select(F.concat(F.lit("r"), (F.col("p_size") % 4).cast("string")).alias("Run"), F.concat(F.lit("pre"), _s("p_partkey")).alias("Precursor.Id"), F.concat(F.lit("sp|P"), _s("p_partkey"), F.lit("|X;Q"), _s("p_size")).alias("Protein.Ids"), F.lit("PEPK(UniMod:1)RP").alias("Modified.Sequence"), F.lit("PEPKRP").alias("Stripped.Sequence"), F.lit(2).alias("Precursor.Charge"), F.lit(0.0).alias("Lib.Q.Value"), (price / 1e6).alias("Global.Q.Value"), pep.alias("PEP"), F.lit(1.5).alias("RT"), F.lit(400.25).alias("Precursor.Mass"), price.alias("Precursor.Quantity"))
    var = readers.read_diann(spark, raw)["psm"].var.drop("var_ord")
    return rounded(_long(var, "charge", "peptide_length", "missed_cleavages"), "PEP", "q_value", "rt", "calcmass", digits=8)


@query("read_table_parquet", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def parquet_table(spark, sf_dir):
    return _long(read_table(spark, f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name"), "n_nationkey")


# -- FASTA


@query("map_fasta", """WITH g AS (SELECT DISTINCT 'P' || l_partkey || ',P' || (l_partkey + 1) || ';P' || l_suppkey AS protein_group, l_partkey AS a, l_partkey + 1 AS b, l_suppkey AS c FROM lineitem),
  m AS (SELECT protein_group, 0 AS nth, unnest([a, b]) AS p FROM g UNION ALL SELECT protein_group, 1, c FROM g), j AS (SELECT DISTINCT protein_group, nth, p_brand FROM m JOIN part ON p_partkey = p),
  e AS (SELECT protein_group, nth, string_agg(p_brand, ',' ORDER BY p_brand) AS v FROM j GROUP BY ALL) SELECT protein_group, string_agg(v, ';' ORDER BY nth) AS Gene FROM e GROUP BY ALL""")
def map_fasta(spark, sf_dir):
    part, text = table(spark, sf_dir, "part"), lambda c: F.concat(F.lit("P"), c.cast("string"))
    info = part.select(text(F.col("p_partkey")).alias("accession"), F.col("p_brand").alias("Gene"))
    groups = F.concat(text(F.col("l_partkey")), F.lit(","), text(F.col("l_partkey") + 1), F.lit(";"), text(F.col("l_suppkey")))
    var = table(spark, sf_dir, "lineitem").select(groups.alias("protein_group")).distinct().withColumn("var_id", F.col("protein_group"))
    study = Study({"protein": Assay(spark.createDataFrame([], "obs_id string, var_id string, value double"), var, None, "protein")}, spark.createDataFrame([], "obs_id string"), {"protein_info": info})
    return fasta.map_fasta(study, "protein", ["Gene"])["protein"].var.select("protein_group", "Gene")


# -- PSMs to peptides, with purity, decoys and q; peptides to sites


def _psms(spark, sf_dir) -> Study:
    o = _orders(spark, sf_dir).withColumns({"var_id": _s("o_orderkey"), "peptide": F.concat(F.lit("p"), _s("o_custkey")), "PEP": F.col("o_totalprice") / 1e6, "purity": F.col("o_orderkey") % 10 / 10.0, "var_ord": F.col("o_orderkey"), "proteins": F.lit("P"), "stripped_peptide": F.lit("K")})
    var = ["var_id", "peptide", "PEP", "purity", "var_ord", "proteins", "stripped_peptide"]
    x = o.select("var_id", F.explode(F.create_map(F.lit("126"), F.col("o_totalprice"), F.lit("127"), (F.col("o_custkey") % 5 + 1).cast("double"))).alias("obs_id", "value")).select("obs_id", "var_id", "value")
    decoy = F.col("o_orderstatus") == "P"
    return Study({"psm": Assay(x, o.where(~decoy).select(*var), o.where(decoy).select(*var), "psm", "tmt")}, spark.createDataFrame([("126", 0), ("127", 1)], "obs_id string, obs_ord int"))


@query("to_peptide_error_rates", """WITH r AS (SELECT 'p' || o_custkey AS peptide, o_orderstatus = 'P' AS is_decoy, count(*) AS count_psm, min(o_totalprice / 1e6) AS PEP FROM orders GROUP BY ALL),
  c AS (SELECT *, count(*) FILTER (is_decoy) OVER w AS d, count(*) FILTER (NOT is_decoy) OVER w AS t FROM r WINDOW w AS (ORDER BY PEP, is_decoy, peptide ROWS UNBOUNDED PRECEDING)),
  f AS (SELECT *, CASE WHEN t > 0 THEN least(1.0, (d + 1)::DOUBLE / t) END AS fdr FROM c)
  SELECT peptide, is_decoy, count_psm, round(PEP, 8) AS PEP, round(CASE WHEN fdr IS NOT NULL THEN min(fdr) OVER (ORDER BY PEP, is_decoy, peptide ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) END, 8) AS q_value FROM f""")
def to_peptide_error_rates(spark, sf_dir):
    found = rollup.to_peptide(_psms(spark, sf_dir))["peptide"]
    rows = [df.select("peptide", F.lit(flag).alias("is_decoy"), "count_psm", "PEP", "q_value") for df, flag in ((found.var, False), (found.decoy, True))]
    return rounded(rows[0].unionByName(rows[1]), "PEP", "q_value", digits=8)


@query("to_peptide_pure_values", """SELECT 'p' || o_custkey AS var_id, obs_id, round(median(value), 5) AS value FROM (SELECT *, unnest(['126', '127']) AS obs_id, unnest([o_totalprice, (o_custkey % 5 + 1)::DOUBLE]) AS value FROM orders)
  WHERE o_orderstatus <> 'P' AND o_orderkey % 10 / 10.0 > 0.7 GROUP BY ALL""")
def to_peptide_pure_values(spark, sf_dir):
    return rounded(rollup.to_peptide(_psms(spark, sf_dir))["peptide"].x.select("var_id", "obs_id", "value"), "value")


# Two peptides a document that carry the same modified residue, the fifteenth letter.
SEQUENCES = "d AS (SELECT doc_id, n_chars, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS s FROM documents WHERE text IS NOT NULL), q AS (SELECT doc_id, n_chars, s, unnest([0, 1]) AS k, unnest([substr(s, 11, 12), substr(s, 9, 16)]) AS p, unnest([5, 7]) AS res FROM d WHERE length(s) >= 40)"
PLACES = "k AS (SELECT *, list_transform(string_split(s, p), lambda x: length(x)) AS ls FROM q), o AS (SELECT *, list_transform(range(1, len(ls)), lambda i: list_sum(ls[1:i])::BIGINT + (i - 1) * length(p) + res) AS places FROM k), z AS (SELECT *, array_to_string(list_transform(places, lambda x: 'A' || doc_id || '|' || substr(p, res, 1) || x), '/') AS site FROM o)"


def _modified(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "n_chars", F.concat(F.lit("A"), _s("doc_id")).alias("accession"), F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("Sequence")).where(F.length("Sequence") >= 40)
    both = [(0, F.substring("Sequence", 11, 12), 5), (1, F.substring("Sequence", 9, 16), 7)]
    rows = [d.select(F.concat(_s("doc_id"), F.lit(f"_{k}")).alias("var_id"), F.concat(F.substring(p, 1, at), F.lit("[+79.97]"), F.substring(p, at + 1, 99)).alias("peptide"), p.alias("stripped_peptide"), F.col("accession").alias("protein_group"), F.lit(k + 1).alias("count_psm"), (F.col("n_chars") + k).cast("double").alias("value")) for k, p, at in both]
    rows = rows[0].unionByName(rows[1])
    x = rows.select(F.lit("one").alias("obs_id"), "var_id", "value")
    return Study({"peptide": Assay(x, rows.drop("value"), None, "peptide")}, spark.createDataFrame([("one", 0)], "obs_id string, obs_ord int"), {"protein_info": d.select("accession", "Sequence")})


@query("to_ptm_values", f"WITH {SEQUENCES}, {PLACES} SELECT site AS var_id, 'one' AS obs_id, round(median(n_chars + k), 5) AS value FROM z GROUP BY ALL")
def to_ptm_values(spark, sf_dir):
    return rounded(ptm.to_ptm(_modified(spark, sf_dir), "phospho", "[+79.97]")["phospho_site"].x.select("var_id", "obs_id", "value"), "value")


@query("to_ptm_identifications", f"""WITH {SEQUENCES}, {PLACES} SELECT site AS protein_site, sum(k + 1)::BIGINT AS count_psm, count(DISTINCT p) AS count_peptide, count(DISTINCT p) AS count_stripped_peptide, min('A' || doc_id) AS protein_group, min('A' || doc_id) AS modified_protein FROM z GROUP BY ALL""")
def to_ptm_identifications(spark, sf_dir):
    var = ptm.to_ptm(_modified(spark, sf_dir), "phospho", "[+79.97]")["phospho_site"].var
    return _long(var.select("protein_site", "count_psm", "count_peptide", "count_stripped_peptide", "protein_group", "modified_protein"), "count_psm")
