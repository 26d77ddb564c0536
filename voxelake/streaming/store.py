"""Ingestion of stored objects as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def incoming(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 8, format: str = "parquet", name: str | None = None) -> DataFrame:
    """A stream of a landing folder; ``files_per_trigger`` bounds how much a batch takes, as a bounded queue would.
    ``name``, a glob, restricts it to files of that name."""
    reader = spark.readStream.format(format).schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return (reader.option("pathGlobFilter", name) if name else reader).load(path)


def store(stream: DataFrame, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None, key: str | None = None, now: bool = False) -> StreamingQuery:
    """Write a stream's batches to Parquet, each batch to a folder of its own, so that a batch which is repeated after
    a failure replaces itself. ``transform`` (de-identification, validation) is applied to each batch; ``key`` drops
    repeated objects within a batch. ``now`` drains what is there and stops."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch if transform is None else transform(batch)
        batch = batch if key is None else batch.dropDuplicates([key])
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if now else writer).start()


def counts(stream: DataFrame, time_col: str, key_col: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Stored objects per window and key, with a watermark so that state stays bounded."""
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, window).alias("window"), F.col(key_col)).agg(F.count("*").alias("n"))
