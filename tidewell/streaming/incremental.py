"""Incremental ingest: new result files are read as a stream, and the peaks of the groups that they touch renewed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewell.operators.ensemble import arg_max
from tidewell.sources import versions


def merge_peaks(known: DataFrame | None, new: DataFrame, keys: Sequence[str], value: str, ties: Sequence[str]) -> DataFrame:
    """Peaks of the known peaks and the new rows together."""
    return arg_max(new if known is None else known.unionByName(new), keys, value, ties)


def peaks(spark: SparkSession, target: str, schema: str, version: int | None = None) -> DataFrame:
    """The peaks of a version, the latest without one."""
    return versions.read(spark, target, schema, version)


def stream_peaks(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, keys: Sequence[str], value: str, ties: Sequence[str]) -> StreamingQuery:
    """Reads the Parquet files that appear in ``source`` and keeps the peak of each group in ``target``.

    Each batch commits a version that takes the place of the last one, under the batch's number, so that a batch that is run
    again changes nothing; what is older than these two goes.
    """

    def renew(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        merged = merge_peaks(peaks(own, target, schema), batch, keys, value, ties).select(*batch.columns)
        if versions.append(merged, target, f"{checkpoint}#{number}", replaces=True):
            versions.vacuum(own, target, keep=2)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(renew).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_append(stream: DataFrame, target: str, checkpoint: str, by: Sequence[str] = ()) -> StreamingQuery:
    """Adds each batch of a stream to a table of whole versions, once."""

    def add(batch: DataFrame, number: int) -> None:
        versions.append(batch, target, f"{checkpoint}#{number}", by)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_maximum(stream: DataFrame, time: str, key: str, value: str, size: str, late: str) -> DataFrame:
    """The greatest value by key and tumbling window; later rows than the watermark are dropped by Spark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size), key).agg(F.max(value).alias(value))
