"""Streams of readings: repeated deliveries dropped, windows closed by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def readings(spark: SparkSession, folder: str, schema: str, files_a_batch: int = 16) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def windowed(stream: DataFrame, at: str, key: str, id: str, value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Per key and window of ``width``: readings, mean and population deviation.

    A reading delivered again within ``late`` counts once; later ones than that are dropped
    with the closed window, so the state kept is bounded by the watermark.
    """
    once = stream.withWatermark(at, late).dropDuplicatesWithinWatermark([id])
    v = F.when(F.abs(F.col(value)) < float("inf"), F.col(value))
    out = once.groupBy(F.window(at, width).alias("w"), key).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("deviation"))
    return out.select(F.col("w.start").alias("start"), key, "n", "mean", "deviation")
