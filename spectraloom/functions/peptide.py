"""Expressions over peptide sequences and protein accessions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PROTON = 1.007276466812


def stripped(peptide: Column) -> Column:
    """The runs of capital letters, without masses in brackets."""
    return F.array_join(F.regexp_extract_all(peptide, F.lit(r"([A-Z]+)|(\[\+\d+\.\d+\])"), F.lit(1)), "")


def missed_cleavages(peptide: Column) -> Column:
    """K or R not before P, the last residue included."""
    return F.regexp_count(peptide, F.lit(r"[KR](?!P)"))


def mass_to_charge(mass: Column, charge: Column) -> Column:
    return F.try_divide(mass + charge * PROTON, charge)


def file_stem(path: Column) -> Column:
    """File name without folder and last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]+)$", 1), r"\.[^.]*$", "")


def without_suffix(name: Column, suffix: str = ".mzML") -> Column:
    return F.when(name.endswith(suffix), F.substring(name, F.lit(1), F.length(name) - len(suffix))).otherwise(name)


def _prefix(item: Column) -> Column:
    return F.regexp_extract(item, r"^(rev_|contam_)", 1)


def accession(item: Column) -> Column:
    """``P1`` of ``sp|P1|NAME``, with a leading ``rev_`` or ``contam_`` kept once; other text as it is."""
    prefix = _prefix(item)
    bare = F.regexp_replace(item, r"^(rev_|contam_)", "")
    parts = F.split(bare, r"\|")
    own = F.when(F.size(parts) >= 3, F.get(parts, F.lit(1))).otherwise(bare)
    return F.concat(prefix, own)


def accessions(proteins: Column) -> Column:
    """``accession`` of each item of a list joined by semicolons."""
    return F.array_join(F.transform(F.split(proteins, ";"), accession), ";")


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value.cast("double")), value)


def zero_to_null(value: Column) -> Column:
    return F.nullif(nan_to_null(value.cast("double")), F.lit(0.0))
