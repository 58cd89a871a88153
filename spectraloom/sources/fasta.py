"""FASTA files as tables, and annotation of protein groups with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Study, logged


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """accession, Entry Type, Accession, Protein ID, Gene, Description, Organism, Sequence, kind_id, by one distributed scan.

    Records are split at ``>`` after a line feed. Contaminants have the prefix ``contam_`` in accession.
    """
    text = spark.read.option("lineSep", "\n>").text(path).withColumn("value", F.regexp_replace("value", r"^>|\r", ""))
    head = F.regexp_extract("value", r"^([^\n]*)", 1)
    rows = text.where(F.length(F.trim("value")) > 0).select(head.alias("head"), F.regexp_replace(F.regexp_replace("value", r"^[^\n]*", ""), r"\s", "").alias("Sequence"))
    ident = F.split(F.regexp_extract("head", r"^(\S*)", 1), r"\|")
    kind = F.when(F.size(ident) >= 3, F.get(ident, F.lit(0))).otherwise(F.lit(""))
    bare = F.when(F.size(ident) >= 2, F.get(ident, F.lit(1))).otherwise(F.get(ident, F.lit(0)))
    gene, organism = F.regexp_extract("head", r"GN=(\S+)", 1), F.regexp_extract("head", r"OS=(\S.+?) OX=", 1)
    about = F.when(F.contains("head", F.lit(" OS=")), F.regexp_extract("head", r"^\S+ (.*?) OS=", 1)).otherwise(F.col("head"))
    out = rows.select(
        F.when(kind.startswith("contam"), F.concat(F.lit("contam_"), bare)).otherwise(bare).alias("accession"),
        kind.alias("Entry Type"),
        bare.alias("Accession_"),
        F.coalesce(F.get(ident, F.lit(2)), F.lit("")).alias("Protein ID"),
        F.when(gene != "", gene).otherwise("Unknown").alias("Gene"),
        about.alias("Description"),
        F.when(organism != "", organism).otherwise("Unknown").alias("Organism"),
        "Sequence",
    )
    kind_id = F.concat_ws("_", F.when(F.col("Entry Type") == "", "sp").otherwise(F.col("Entry Type")), F.col("Accession_"))
    return out.withColumn("kind_id", kind_id)


@logged
def attach_fasta(study: Study, fasta_file: str | None) -> Study:
    if fasta_file is None:
        raise NotImplementedError("fetching protein data from UniProt")
    return study.with_(tables={**study.tables, "protein_info": read_fasta(study.obs.sparkSession, fasta_file)})


@logged
def map_fasta(study: Study, modality: str, categories: list[str], column: str = "protein_group") -> Study:
    """Add a FASTA category to features by their protein groups: distinct inside a group (commas), groups by semicolons, sorted."""
    if "protein_info" not in study.tables:
        raise ValueError("attach_fasta first")
    assay, info = study[modality], study.tables["protein_info"]
    groups = assay.var.select(column).distinct()
    rows = groups.select(column, F.posexplode(F.split(column, ";")).alias("nth", "group")).select(column, "nth", F.explode(F.split("group", ",")).alias("accession")).join(info.select("accession", *(F.col(f"`{c}`") for c in categories)), "accession")

    def joined(c: str):
        found = F.sort_array(F.collect_set(F.struct("nth", F.col(f"`{c}`").alias("v"))))
        groups = F.array_distinct(F.transform(found, lambda x: x.nth))
        return F.array_join(F.transform(groups, lambda n: F.array_join(F.transform(F.filter(found, lambda x: x.nth == n), lambda x: x.v), ",")), ";").alias(c)

    whole = rows.groupBy(column).agg(*(joined(c) for c in categories))
    return study.with_assay(modality, assay.with_(var=assay.var.drop(*categories).join(whole, column, "left")))
