"""Reading delimited, Parquet, JSON and spreadsheet files by their suffix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SEPARATORS = {"csv": ",", "tsv": "\t", "tab": "\t", "txt": "\t"}


def read_table(spark: SparkSession, path: str | DataFrame, **options) -> DataFrame:
    """A DataFrame passes through; xlsx and xls are read on the driver, as such files are small."""
    if isinstance(path, DataFrame):
        return path
    suffix = str(path).rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix in SEPARATORS:
        return spark.read.options(**{"header": True, "inferSchema": True, "sep": SEPARATORS[suffix], "nanValue": "nan"} | options).csv(str(path))
    if suffix == "parquet":
        return spark.read.options(**options).parquet(str(path))
    if suffix == "json":
        return spark.read.options(**{"multiLine": True} | options).json(str(path))
    if suffix in ("xlsx", "xls"):
        import pandas as pd

        return spark.createDataFrame(pd.read_excel(path, **options))
    raise ValueError(f"{path}: no reader for .{suffix}; there are csv, tsv, tab, txt, parquet, json, xlsx, xls")
