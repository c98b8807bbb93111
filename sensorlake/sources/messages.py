"""Message streams: a broker topic, or files holding the same envelope."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sensorlake import schemas
from sensorlake.sources.tables import load


def topic_stream(
    spark: SparkSession,
    *,
    servers: str,
    topic: str,
    group_id: str | None = None,
    starting_offsets: str = "earliest",
    max_offsets: int | None = None,
    options: dict[str, str] | None = None,
) -> DataFrame:
    """A topic as a stream.

    ``starting_offsets`` counts for the first run only; later runs go on from
    the checkpoint. ``max_offsets`` bounds a micro-batch.
    """
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", starting_offsets)
    )
    if group_id:
        reader = reader.option("kafka.group.id", group_id)
    if max_offsets:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    return load(reader.options(**(options or {})), "kafka")


def file_stream(
    spark: SparkSession,
    path: str,
    *,
    fmt: str = "parquet",
    max_files: int | None = None,
) -> DataFrame:
    """Files of message envelopes as a stream, a new file being new messages."""
    reader = spark.readStream.format(fmt).schema(schemas.MESSAGE)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)
