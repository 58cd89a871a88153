"""Readers of search-engine results. Each gives a study from one lazy plan per table.

A reader names the columns of its engine in ``identifications`` and its measurements in ``quantities``;
what follows is shared: keys, decoys apart, zeros to missing, assays and samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.peptide import accessions, file_stem, missed_cleavages, nan_to_null, stripped, zero_to_null
from ..model import Assay, Study
from ..operators.merge import unpivoted
from .tables import read_table

CORE = ("proteins", "peptide", "stripped_peptide", "filename", "scan_num", "charge", "peptide_length")


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`")


class SearchResultReader:
    """Subclass with ``engine``, ``label``, ``identifications`` and ``quantities``.

    ``identifications`` returns the PSM table with CORE columns and decoy; ``quantities`` a table of key, obs_id and
    value and the level (psm or peptide) it belongs to, or None.
    """

    engine: str
    label: str | None = None
    extra: tuple[str, ...] = ()

    def __init__(self, spark: SparkSession, identification, quantification=None):
        self.spark = spark
        self.raw = read_table(spark, identification)
        self.quant = read_table(spark, quantification) if quantification is not None else None

    def identifications(self) -> DataFrame:
        raise NotImplementedError

    def quantities(self, rows: DataFrame) -> tuple[DataFrame, str] | None:
        raise NotImplementedError

    def key(self) -> Column:
        return F.concat_ws(".", "filename", F.col("scan_num").cast("string"))

    def read(self) -> Study:
        rows = self.identifications()
        # Several hits of a spectrum share its name; a number tells them apart.
        rows = rows.withColumn("_base", self.key())
        nth = F.row_number().over(Window.partitionBy("_base").orderBy("peptide", "proteins"))
        rows = rows.withColumn("_nth", nth).withColumn("var_id", F.when(F.col("_nth") == 1, F.col("_base")).otherwise(F.concat_ws("_", "_base", "_nth")))
        rows = rows.withColumn("var_ord", F.xxhash64("var_id"))
        keep = ["var_id", "var_ord", *(c for c in (*CORE, *self.extra) if c in rows.columns)]
        decoys = F.coalesce(F.col("decoy").cast("int") == 1, F.lit(False))
        var = rows.where(~decoys).select(*keep)
        decoy = rows.where(decoys).select(*keep)
        measured = self.quantities(rows)
        empty = var.select(F.lit("").alias("obs_id"), "var_id", F.lit(None).cast("double").alias("value")).where("false")
        assays: dict[str, Assay] = {}
        if measured is None:
            assays["psm"] = Assay(empty, var, decoy, "psm", self.label, self.engine)
            samples = var.select(F.col("filename").alias("obs_id")).distinct()
        else:
            values, level = measured
            values = values.where(F.col("value").isNotNull())
            samples = values.select("obs_id").distinct()
            if level == "psm":
                # Measurements are joined on the spectrum, as the engine reports them once for it.
                x = rows.where(~decoys).select("var_id", F.col("_base").alias("key")).join(values, "key").select("obs_id", "var_id", "value")
                assays["psm"] = Assay(x, var, decoy, "psm", self.label, self.engine)
            else:
                assays["psm"] = Assay(empty, var, decoy, "psm", self.label, self.engine)
                x = values.select("obs_id", F.col("key").alias("var_id"), "value")
                names = x.select("var_id").distinct().withColumn("peptide", F.col("var_id")).withColumn("var_ord", F.xxhash64("var_id"))
                assays["peptide"] = Assay(x, names, None, "peptide", self.label, self.engine)
        obs = samples.withColumn("obs_ord", F.row_number().over(Window.orderBy("obs_id")) - 1)  # a row for each sample
        return Study(assays, obs)


class SageReader(SearchResultReader):
    engine, extra = "sage", ("missed_cleavages", "semi_enzymatic", "contaminant", "PEP", "q_value", "rt", "calcmass")
    LFQ_KEYS = ("peptide", "charge", "proteins", "q_value", "score", "spectral_angle")

    def __init__(self, spark: SparkSession, identification, label: str, quantification=None):
        if label not in ("tmt", "label_free"):
            raise ValueError(f"label is {label!r}; it can be tmt or label_free")
        super().__init__(spark, identification, quantification)
        self.label = label

    @staticmethod
    def scan(column: str) -> Column:
        return F.try_to_number(F.regexp_extract(column, r"scan=(\d+)", 1), F.lit("999999999999")).cast("int")

    def identifications(self) -> DataFrame:
        d = self.raw.withColumn("proteins", accessions(F.col("proteins"))).withColumn("filename", file_stem(F.col("filename")))
        d = d.withColumn("scan_num", self.scan("scannr")).withColumn("stripped_peptide", stripped(F.col("peptide")))
        d = d.withColumn("decoy", (F.col("label") == -1).cast("int")).withColumn("contaminant", F.contains("proteins", F.lit("contam_")).cast("int"))
        d = d.withColumn("PEP", F.pow(F.lit(10.0), nan_to_null(F.col("posterior_error"))))
        return d.withColumnsRenamed({"peptide_len": "peptide_length", "spectrum_q": "q_value"})

    def quantities(self, rows: DataFrame):
        if self.quant is None:
            return None
        if self.label == "tmt":
            channels = sorted((c for c in self.quant.columns if c.startswith("tmt_")), key=lambda c: int(c[4:]))
            q = self.quant.withColumn("key", F.concat_ws(".", file_stem(F.col("filename")), self.scan("scannr").cast("string")))
            return unpivoted(q, ["key"], dict(zip(channels, labels.channels(len(channels)), strict=True))), "psm"
        files = {c: c.rsplit("/", 1)[-1].rsplit("\\", 1)[-1].rsplit(".", 1)[0] for c in self.quant.columns if c not in self.LFQ_KEYS}
        q = self.quant.groupBy("peptide").agg(*(F.sum(_quoted(c)).alias(c) for c in files)).withColumnRenamed("peptide", "key")
        return unpivoted(q, ["key"], files), "peptide"


class DiannReader(SearchResultReader):
    engine, label, extra = "diann", "label_free", ("missed_cleavages", "PEP", "q_value", "rt", "calcmass", "precursor")

    def identifications(self) -> DataFrame:
        # Match-between-runs results carry the library's q-values; else that column is all zero.
        library = self.raw.agg(F.sum("`Lib.Q.Value`")).first()[0]
        q = "Lib.Q.Value" if library else "Global.Q.Value"
        names = {"Modified.Sequence": "peptide", "Stripped.Sequence": "stripped_peptide", "Run": "filename", "Precursor.Charge": "charge", q: "q_value", "RT": "rt", "Precursor.Mass": "calcmass"}
        decoy = _quoted("Decoy").cast("int") if "Decoy" in self.raw.columns else F.lit(0)
        d = self.raw.select("*", decoy.alias("_decoy")).drop("Decoy").withColumnsRenamed(names | {"_decoy": "decoy"})
        d = d.withColumn("proteins", accessions(_quoted("Protein.Ids"))).withColumn("missed_cleavages", missed_cleavages(F.col("stripped_peptide")))
        return d.withColumn("peptide_length", F.length("stripped_peptide")).withColumn("precursor", _quoted("Precursor.Id")).withColumn("PEP", nan_to_null(F.col("PEP")))

    def key(self) -> Column:
        return F.concat_ws(".", "filename", "precursor")

    def quantities(self, rows: DataFrame):
        return rows.select(F.col("_base").alias("key"), F.col("filename").alias("obs_id"), zero_to_null(_quoted("Precursor.Quantity")).alias("value")), "psm"

    @classmethod
    def from_pg(cls, *args, **kwargs):
        raise NotImplementedError("protein-group tables of DIA-NN")


class FragpipeReader(SearchResultReader):
    engine, extra = "fragpipe", ("missed_cleavages", "rt", "calcmass")
    # Descriptor columns of the engine's PSM table; all others are channels.
    DESCRIPTORS = (
        "Spectrum", "Spectrum File", "Peptide", "Modified Peptide", "Extended Peptide", "Prev AA", "Next AA", "Peptide Length", "Charge", "Retention",
        "Observed Mass", "Calibrated Observed Mass", "Observed M/Z", "Calibrated Observed M/Z", "Calculated Peptide Mass", "Calculated M/Z", "Delta Mass",
        "Expectation", "Hyperscore", "Nextscore", "PeptideProphet Probability", "Number of Enzymatic Termini", "Number of Missed Cleavages", "Protein Start",
        "Protein End", "Intensity", "Assigned Modifications", "Observed Modifications", "Compensation Voltage", "Purity", "Is Unique", "Protein", "Protein ID",
        "Entry Name", "Gene", "Protein Description", "Mapped Genes", "Mapped Proteins", "Quan Usage",
    )

    def __init__(self, spark: SparkSession, identification, label: str, acquisition: str = "dda", quantification=None):
        if acquisition != "dda" or label not in ("tmt", "label_free"):
            raise ValueError(f"no reader for {acquisition} with label {label!r}; there are dda with tmt or label_free")
        super().__init__(spark, identification, quantification)
        self.label = label

    def identifications(self) -> DataFrame:
        part = F.split("Spectrum", r"\.")
        listed = F.concat_ws(",", _quoted("Protein").cast("string"), _quoted("Mapped Proteins").cast("string"))
        members = F.filter(F.transform(F.split(listed, ","), F.trim), lambda p: ~p.isin("nan", ""))
        d = self.raw.withColumn("filename", part[0]).withColumn("scan_num", part[1].cast("int")).withColumn("proteins", F.array_join(members, ";"))
        d = d.withColumn("proteins", accessions(F.col("proteins"))).withColumn("stripped_peptide", _quoted("Peptide"))
        d = d.withColumn("_peptide", F.coalesce(F.nullif(_quoted("Modified Peptide"), F.lit("")), _quoted("Peptide"))).withColumn("decoy", F.contains("proteins", F.lit("rev_")).cast("int"))
        d = d.drop("Peptide").withColumnRenamed("_peptide", "peptide").withColumn("rt", F.col("Retention") / 60.0)
        return d.withColumnsRenamed({"Charge": "charge", "Peptide Length": "peptide_length", "Number of Missed Cleavages": "missed_cleavages", "Calculated Peptide Mass": "calcmass"})

    def quantities(self, rows: DataFrame):
        if self.label == "tmt":
            channels = [c for c in self.raw.columns if c not in self.DESCRIPTORS]
            return unpivoted(rows.select(F.col("_base").alias("key"), *(_quoted(c) for c in channels)), ["key"], {c: c for c in channels}), "psm"
        if self.quant is None:
            return None
        columns = {c: c.removesuffix(" Intensity") for c in self.quant.columns if c.endswith(" Intensity")}
        return unpivoted(self.quant.withColumnRenamed("Modified Sequence", "key"), ["key"], columns), "peptide"


class MaxquantReader(SearchResultReader):
    engine, extra = "maxquant", ("missed_cleavages", "contaminant", "score", "rt", "purity")
    NAMES = {"Sequence": "stripped_peptide", "Modified sequence": "peptide", "Length": "peptide_length", "Missed cleavages": "missed_cleavages", "Charge": "charge", "Raw file": "filename", "MSMS scan number": "scan_num", "Retention time": "rt", "hyperscore": "score"}

    def __init__(self, spark: SparkSession, identification, label: str, acquisition: str = "dda", quantification: bool = True):
        if acquisition == "dia":
            raise NotImplementedError("DIA results of MaxQuant")
        if label not in ("tmt", "label_free"):
            raise ValueError(f"label is {label!r}; it can be tmt or label_free")
        super().__init__(spark, identification)
        self.label, self.quantified = label, quantification

    def identifications(self) -> DataFrame:
        d = self.raw.toDF(*(c.replace("/", "") for c in self.raw.columns)).where(~F.col("Type").eqNullSafe("MULTI-SECPEP"))
        flag = lambda c: _quoted(c).cast("string").eqNullSafe("+").cast("int")
        d = d.withColumn("decoy", flag("Reverse")).withColumn("contaminant", flag("Potential contaminant"))
        text = F.when(F.col("decoy") == 1, _quoted("Leading proteins")).otherwise(_quoted("Proteins"))
        text = F.replace(F.replace(text, F.lit("REV__"), F.lit("rev_")), F.lit("CON__"), F.lit("contam_"))
        return d.withColumn("_proteins", text).drop("Proteins").withColumnsRenamed(self.NAMES | {"_proteins": "proteins"})

    def quantities(self, rows: DataFrame):
        if self.label == "tmt":
            start = "Reporter intensity corrected "
            found = sorted((c for c in rows.columns if c.startswith(start) and c[len(start) :].isdigit()), key=lambda c: int(c[len(start) :]))
            names = dict(zip(found, labels.channels(len(found)), strict=True))
            return unpivoted(rows.select(F.col("_base").alias("key"), *(_quoted(c) for c in found)), ["key"], names), "psm"
        if not self.quantified:
            return None
        q = rows.groupBy(F.col("peptide").alias("key"), F.col("filename").alias("obs_id")).agg(F.sum("Intensity").alias("value"))
        return q.withColumn("value", zero_to_null(F.col("value"))), "peptide"


def read_sage(spark: SparkSession, identification_file, label: str, quantification_file=None) -> Study:
    return SageReader(spark, identification_file, label, quantification_file).read()


def read_diann(spark: SparkSession, identification_file) -> Study:
    return DiannReader(spark, identification_file).read()


def read_fragpipe(spark: SparkSession, identification_file, label: str, acquisition: str = "dda", quantification_file=None) -> Study:
    return FragpipeReader(spark, identification_file, label, acquisition, quantification_file).read()


def read_maxquant(spark: SparkSession, identification_file, label: str, acquisition: str = "dda", quantification: bool = True) -> Study:
    return MaxquantReader(spark, identification_file, label, acquisition, quantification).read()


def read_comet(*args, **kwargs) -> Study:
    raise NotImplementedError("results of Comet")


def read_protdiscov(*args, **kwargs) -> Study:
    raise NotImplementedError("results of Proteome Discoverer")
