"""Intermediate tables in the folder that all executors share.

Lineage is cut by writing a table and reading it again. The folder is the one named in
``spark.checkpoint.dir``; only where that is unset and Spark runs on one machine (tests, notebooks) a local one is
made, on a cluster its absence is an error. Results are lazy and read these tables, so they stay until
``clear`` removes all that the application has written.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def root(spark: SparkSession) -> str:
    """The application's own path under the shared folder."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir names no folder; executors need one that all of them share")
        shared = _LOCAL.setdefault("root", tempfile.mkdtemp(prefix="spectraloom-"))
    return f"{shared.rstrip('/')}/spectraloom/{spark.sparkContext.applicationId}"


def folder(spark: SparkSession) -> str:
    """A new, empty path under the shared folder."""
    return f"{root(spark)}/{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Remove all tables that this application has written here; results that aren't collected or written yet are lost."""
    remove(spark, root(spark))


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return the table read back."""
    spark = df.sparkSession
    path = path or folder(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through the file system that holds it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession, rows: int = 2000, size: int = 32 << 20) -> None:
    """Keep Arrow batches of whole texts small: lower their most rows and bytes, never raise them. Lazy results are run under the
    session's settings, so they stay lowered."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(key).rstrip("bB")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))
