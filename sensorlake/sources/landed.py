"""Landed text and documents: metric scrapes, container logs, inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorlake import schemas
from sensorlake.operators import inventory, logs, metrics
from sensorlake.sources import growing

LOG_GLOB = "/var/log/pods/*/*/*.log"
# Rotated files keep their name with a time after it.
GROWING_GLOB = "/var/log/pods/*/*/*.log*"


def metric_files(
    spark: SparkSession, path: str, *, stamp: Column | None = None, strip_lines: bool = True
) -> DataFrame:
    """Samples from scrape files. A file is one scrape and gives all its rows one time."""
    lines = spark.read.text(path).select("value", "_metadata.file_modification_time")
    stamp = F.col("file_modification_time") if stamp is None else stamp
    return metrics.parse_lines(lines, stamp, strip_lines=strip_lines)


def log_files(spark: SparkSession, path: str = LOG_GLOB) -> DataFrame:
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"))
    return logs.parse_logs(lines, keep=["path"])


def log_stream(
    spark: SparkSession, path: str = LOG_GLOB, *, max_files: int | None = None
) -> DataFrame:
    """Log files that are landed whole, as a stream; lines added to one later are not read (``log_tail``)."""
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    lines = reader.load(path).select("value", F.col("_metadata.file_path").alias("path"))
    return logs.parse_logs(lines, keep=["path"])


def log_tail(spark: SparkSession, path: str = GROWING_GLOB, *, fail_on_loss: bool = True, part_bytes: int = growing.PART_BYTES) -> DataFrame:
    """The lines of log files that grow and are rotated, each once, as a stream.

    A file that vanishes with lines unread fails the stream, unless
    ``fail_on_loss`` is off.
    """
    spark.dataSource.register(growing.GrowingText)
    reader = spark.readStream.format("growing_text").option("path", path)
    lines = reader.option("fail_on_loss", str(fail_on_loss).lower()).option("part_bytes", part_bytes).load()
    return logs.parse_logs(lines, keep=["path"])


def inventory_files(
    spark: SparkSession, path: str, item: T.StructType, *, one_per_file: bool = True
) -> DataFrame:
    """Items of inventory documents, one document per file or one per line."""
    reader = spark.read.schema(schemas.item_list(item))
    documents = reader.option("multiLine", str(one_per_file).lower()).json(path)
    return inventory.explode_items(documents, item, value=None)
