"""Localisation of modified residues in proteins, and roll-up of peptides to sites."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Assay, Study, logged
from . import rollup


def peptide_sites(peptide: Column, modification: str) -> Column:
    """Structs of residue and place (from 1) of each residue that carries ``modification`` (literal text after it).

    Other modifications in brackets or parentheses are no residues.
    """
    parts = F.split(peptide, re.escape(modification))
    bare = F.transform(parts, lambda p: F.regexp_replace(p, r"\[[^\]]*\]|\([^)]*\)|[^A-Z]", ""))
    lead = F.slice(bare, 1, F.size(bare) - 1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<residue:string,place:int>>").alias("found"))

    def step(acc: Column, p: Column) -> Column:
        at = acc["at"] + F.length(p)
        return F.struct(at.alias("at"), F.concat(acc["found"], F.array(F.struct(F.right(p, F.lit(1)).alias("residue"), at.alias("place")))).alias("found"))

    return F.filter(F.aggregate(lead, start, step)["found"], lambda s: s["residue"] != "")


def occurrences(sequence: Column, peptide: Column) -> Column:
    """Starts (from 1) of the non-overlapping occurrences of a peptide, left to right."""
    pieces = F.split(sequence, F.concat(F.lit("\\Q"), peptide, F.lit("\\E")), -1)
    ahead = F.sequence(F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(1)))
    starts = F.transform(ahead, lambda i: F.aggregate(F.slice(pieces, 1, i), F.lit(0), lambda a, p: a + F.length(p)) + (i - 1) * F.length(peptide) + 1)
    return F.when(F.size(pieces) > 1, starts).otherwise(F.array().cast("array<int>"))


def sites(var: DataFrame, fasta: DataFrame, modification: str) -> DataFrame:
    """One row for each peptide and protein site.

    ``var`` has var_id, peptide, stripped_peptide, protein_group and count_psm; ``fasta`` accession and
    sequence. The site of a group member is ``ACC|S12``, several places in one protein are joined by ``/``, members by
    ``,`` and groups by ``;``. Members that the FASTA lacks are left out, peptides without any site too.
    """
    rows = var.where(F.contains("peptide", F.lit(modification)))
    rows = rows.select("var_id", "peptide", "stripped_peptide", "protein_group", *[c for c in ("count_psm", "PEP") if c in var.columns], F.explode(peptide_sites(F.col("peptide"), modification)).alias("site"))
    rows = rows.select("*", F.posexplode(F.split("protein_group", ";")).alias("nth_group", "group"))
    rows = rows.select("*", F.posexplode(F.split("group", ",")).alias("nth", "accession"))
    rows = rows.join(fasta.select("accession", "sequence"), "accession")
    place = F.transform(occurrences(F.col("sequence"), F.col("stripped_peptide")), lambda s: F.concat(F.col("accession"), F.lit("|"), F.col("site.residue"), (s + F.col("site.place") - 1).cast("string")))
    rows = rows.withColumn("protein_site", F.array_join(place, "/")).where("protein_site <> ''").drop("sequence")
    joined = lambda sep, by: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(by, "protein_site"))), lambda x: x.protein_site), sep).alias("protein_site")
    keys = ["var_id", "peptide", "stripped_peptide", "protein_group", "site"]
    more = [F.sum("count_psm").alias("count_psm")] if "count_psm" in var.columns else []
    more += [F.min("PEP").alias("PEP")] if "PEP" in var.columns else []
    members = rows.groupBy(*keys, "nth_group", "group").agg(joined(",", "nth"), *more)
    whole = members.groupBy(*keys).agg(joined(";", "nth_group"), *more)
    return whole.withColumn("modified_protein", F.array_join(F.array_distinct(F.transform(F.split("protein_site", "[;,/]"), lambda s: F.split_part(s, F.lit("|"), F.lit(1)))), ",")).drop("site")


def site_rows(found: DataFrame) -> DataFrame:
    """Identifications by protein_site."""
    aggs = [F.array_join(F.array_sort(F.collect_set("peptide")), ";").alias("peptides"), F.countDistinct("peptide").alias("count_peptide"), F.countDistinct("stripped_peptide").alias("count_stripped_peptide"), F.min_by("protein_group", "var_id").alias("protein_group"), F.min_by("modified_protein", "var_id").alias("modified_protein")]
    if "count_psm" in found.columns:
        aggs.insert(0, F.sum("count_psm").alias("count_psm"))
    if "PEP" in found.columns:
        aggs.append(F.min("PEP").alias("PEP"))
    return found.groupBy("protein_site").agg(*aggs)


@logged
def to_ptm(study: Study, modi_name: str, modification: str, layer: str = "value", agg_method: str = "median", top_n: int | None = None, rank_method: str = "median_intensity") -> Study:
    """Peptides to sites ``{modi_name}_site``; needs the study's protein_info (``attach_fasta``)."""
    if "protein_info" not in study.tables:
        raise ValueError("attach_fasta first")
    pep = study["peptide"]
    fasta = study.tables["protein_info"].select("accession", F.col("Sequence").alias("sequence"))
    found = sites(pep.var, fasta, modification)
    x = pep.x.withColumn("value", F.col(layer)).join(found.select("var_id", "protein_site").distinct(), "var_id")
    if top_n is not None:
        ranks = rollup.feature_ranks(pep.x.withColumn("value", F.col(layer)), found.select("var_id", "protein_site").distinct(), "protein_site", rank_method).where(F.col("rank") <= top_n)
        x = x.join(ranks.select("var_id", "protein_site"), ["var_id", "protein_site"], "left_semi")
    x = rollup.values_by_group(x, "protein_site", agg_method).withColumnRenamed("protein_site", "var_id")
    rows = site_rows(found)
    name = f"{modi_name}_site"
    var = rows.withColumn("var_id", F.col("protein_site")).withColumn("var_ord", F.xxhash64("protein_site"))
    return study.with_assay(name, Assay(x, var, None, "ptm", pep.label, pep.engine))
