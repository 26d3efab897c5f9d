"""Streams: windowed sums and deduplication with watermarks, written batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table_stream(spark: SparkSession, path: str, files_a_batch: int = 100) -> DataFrame:
    """A stream of the Parquet files below a path, or of the one file there, with the schema of those that are there now."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(f"{path}*")


def tumbling(events: DataFrame, ts: str, keys: list[str], width: str, late: str, *sums: Column) -> DataFrame:
    """Sums for each window and key; rows later than ``late`` are left out."""
    return events.withWatermark(ts, late).groupBy(*keys, F.window(ts, width).alias("w")).agg(*sums)


def sliding(events: DataFrame, ts: str, keys: list[str], width: str, step: str, late: str, *sums: Column) -> DataFrame:
    """Sums for each key and each window of so much width that begins at every step, so that a row counts in several.

    A row is left out of the windows that end ``late`` or more before the newest time of the batches before its own.
    """
    return events.withWatermark(ts, late).groupBy(*keys, F.window(ts, width, step).alias("w")).agg(*sums)


def arriving(parts: list[DataFrame], path: str, build: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """What the stream that build makes gives when parts arrive one after the other; the query stops and starts again
    between them, and goes on from its checkpoint with the watermark of all that it has seen."""
    out = None
    for part in parts:
        part.write.mode("append").parquet(f"{path}/in")
        out = drain(build(table_stream(part.sparkSession, f"{path}/in")), path, mode)
    return out


def once_within(events: DataFrame, ts: str, keys: list[str], late: str) -> DataFrame:
    """The first row of each key within the watermark; state of older keys is given up."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def drain(stream: DataFrame, path: str, mode: str) -> DataFrame:
    """Runs a stream over all that is there now; the rows that it gave, each with the number of its batch.

    A batch that is run again after a failure writes to the same folder, so no row counts twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/log").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return stream.sparkSession.read.parquet(f"{path}/rows")


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows of updates, the last of each key."""
    return rows.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(F.col("batch").desc()))).where("_k = 1").drop("_k", "batch")
