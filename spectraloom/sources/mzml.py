"""Precursor isolation purity from mzML files.

A file is parsed in one task as a stream of spectra, so memory holds two spectra; the last MS1 spectrum before an MS2
gives the signal in its isolation window. Purity is the share of that signal within ``tolerance`` of the precursor's isotope peaks.
"""

from __future__ import annotations

import base64
import io
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.peptide import without_suffix
from ..model import Study, logged

ISOTOPE = 1.003355


def _array(node) -> tuple[str | None, np.ndarray]:
    terms = {p.get("accession") for p in node.iter() if p.tag.endswith("cvParam")}
    data = base64.b64decode(next((p.text or "" for p in node.iter() if p.tag.endswith("binary")), ""))
    if "MS:1000574" in terms:
        data = zlib.decompress(data)
    values = np.frombuffer(data, "<f4" if "MS:1000521" in terms else "<f8").astype(float)
    return ("mz" if "MS:1000514" in terms else "intensity" if "MS:1000515" in terms else None), values


def spectra(content: bytes) -> Iterator[dict]:
    """level, mz, intensity and, for MS2, target, lower, upper and charge, in file order."""
    for _, node in ElementTree.iterparse(io.BytesIO(content)):
        if not node.tag.endswith("}spectrum") and node.tag != "spectrum":
            continue
        out: dict = {"level": 1, "mz": np.zeros(0), "intensity": np.zeros(0), "charge": 0, "lower": 0.0, "upper": 0.0, "target": None}
        for p in node.iter():
            if p.tag.endswith("cvParam"):
                name, value = p.get("accession"), p.get("value")
                if name == "MS:1000511":
                    out["level"] = int(value)
                elif name == "MS:1000744" or (name == "MS:1000827" and out["target"] is None):
                    out["target"] = float(value)
                elif name == "MS:1000828":
                    out["lower"] = float(value)
                elif name == "MS:1000829":
                    out["upper"] = float(value)
                elif name == "MS:1000041":
                    out["charge"] = int(value)
            elif p.tag.endswith("binaryDataArray"):
                kind, values = _array(p)
                if kind:
                    out[kind] = values
        node.clear()
        yield out


def purity(ms1: dict, ms2: dict, tolerance: float, ppm: bool) -> float | None:
    """Intensity of the precursor's isotopes over all intensity in the isolation window; missing for an empty window."""
    inside = (ms1["mz"] >= ms2["target"] - ms2["lower"]) & (ms1["mz"] <= ms2["target"] + ms2["upper"])
    mz, intensity = ms1["mz"][inside], ms1["intensity"][inside]
    total = intensity.sum()
    if not total:
        return None
    reach = ms2["target"] * tolerance * 1e-6 if ppm else tolerance
    charge = max(ms2["charge"], 1)
    steps = np.round((mz - ms2["target"]) * charge / ISOTOPE)
    own = np.abs(mz - ms2["target"] - steps * ISOTOPE / charge) <= reach
    return float(intensity[own].sum() / total)


def purities(spark: SparkSession, paths: str | list[str], tolerance: float = 20.0, unit_ppm: bool = True) -> DataFrame:
    """filename, scan_num (from 1), purity of every MS2 spectrum."""
    if tolerance <= 0:
        raise ValueError("tolerance must be positive")
    files = spark.read.format("binaryFile").load([paths] if isinstance(paths, str) else list(paths))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"], strict=True):
                last, rows = None, []
                for i, s in enumerate(spectra(content)):
                    if s["level"] == 1:
                        last = s
                    elif s["level"] == 2 and s["target"] is not None:
                        rows.append((path.rsplit("/", 1)[-1], i + 1, purity(last, s, tolerance, unit_ppm) if last else None))
                yield pd.DataFrame(rows, columns=["filename", "scan_num", "purity"]).astype({"purity": float})

    out = files.select("path", "content").mapInPandas(run, "filename string, scan_num int, purity double")
    return out.withColumn("purity", F.when(~F.isnan("purity"), F.col("purity")))


@logged
def compute_precursor_isolation_purity(study: Study, mzml_paths: str | list[str], tolerance: float = 20.0, unit_ppm: bool = True) -> Study:
    """Add ``purity`` to PSMs by file and scan."""
    psm = study["psm"]
    for c in ("filename", "scan_num"):
        if c not in psm.var.columns:
            raise ValueError(f"PSMs have no {c}")
    found = purities(study.obs.sparkSession, mzml_paths, tolerance, unit_ppm).withColumn("filename", without_suffix(F.col("filename")))
    return study.with_assay("psm", psm.with_(var=psm.var.drop("purity").join(found, ["filename", "scan_num"], "left")))
