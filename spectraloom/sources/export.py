"""Wide tables for people and other tools."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Study

FLASHLFQ = {"filename": "File Name", "rt": "Scan Retention Time", "charge": "Precursor Charge", "stripped_peptide": "Base Sequence", "peptide": "Full Sequence", "calcmass": "Peptide Monoisotopic Mass", "proteins": "Protein Accession"}


def to_readable(study: Study, modality: str, include=None, exclude=None, quantification: bool = True) -> DataFrame:
    """Features with chosen columns and a column of values for each sample, in sample order."""
    assay = study[modality]
    names = lambda x: [x] if isinstance(x, str) else list(x or [])
    columns = [c for c in assay.var.columns if (not include or c in names(include)) and c not in names(exclude)]
    out = assay.var.select("var_id", *(c for c in columns if c != "var_id"))
    if quantification:
        samples = [r.obs_id for r in study.obs.orderBy("obs_ord", "obs_id").select("obs_id").collect()]  # they become columns
        wide = assay.x.groupBy("var_id").pivot("obs_id", samples).agg(F.first("value"))
        out = out.join(wide, "var_id", "left")
    return out if "var_id" in columns else out.drop("var_id")


def write_csv(study: Study, modality: str, filename: str, sep: str, include=None, exclude=None, quantification: bool = True) -> None:
    """One delimited file in the folder ``filename``."""
    to_readable(study, modality, include, exclude, quantification).coalesce(1).write.mode("overwrite").options(header=True, sep=sep).csv(filename)


def flashlfq_input(study: Study) -> DataFrame:
    return study["psm"].var.select(*(F.col(c).alias(n) for c, n in FLASHLFQ.items()))


def write_flashlfq_input(study: Study, filename: str) -> None:
    flashlfq_input(study).coalesce(1).write.mode("overwrite").options(header=True, sep="\t").csv(filename)
