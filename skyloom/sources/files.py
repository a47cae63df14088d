"""File listings without their contents, and CSV manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def listing(spark: SparkSession, root: str, pattern: str = "*_cal.fits") -> DataFrame:
    """``(name, path, length, modified)`` of the files under ``root``; no content is read. Of equal names the last path counts."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "length", F.col("modificationTime").alias("modified"))
    f = f.withColumn("name", F.element_at(F.split("path", "/"), -1))
    return f.withColumn("r", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("path")))).filter("r = 1").select("name", "path", "length", "modified")


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def write_manifest(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
