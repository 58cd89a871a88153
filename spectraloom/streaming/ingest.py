"""Streaming ingest: new search-result files become rows of a table as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def watch(spark: SparkSession, folder: str, schema: T.StructType | str, sep: str = "\t") -> DataFrame:
    """A stream over delimited files with a header; each row has the file it came from."""
    return spark.readStream.schema(schema).options(header=True, sep=sep).csv(folder).withColumn("source_file", F.input_file_name())


def append_to(stream: DataFrame, table: str, checkpoint: str, once: bool = False):
    """Append each batch to a Parquet table. A batch goes to its own folder, so that one that is run again after a failure replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def counts_by_window(stream: DataFrame, time: str, length: str, late: str, keys: list[str]) -> DataFrame:
    """Rows by time window and keys; rows later than ``late`` behind the newest are dropped with their window's state."""
    return stream.withWatermark(time, late).groupBy(F.window(time, length), *keys).agg(F.count("*").alias("n"))
