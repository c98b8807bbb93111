"""Metric exposition text to samples, points and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorlake.functions import plan, text

# The metrics the collector keeps.
IMPORTANT_METRICS = (
    "kafka_server_brokertopicmetrics_messagesin_total",
    "kafka_server_brokertopicmetrics_bytesin_total",
    "kafka_server_brokertopicmetrics_bytesout_total",
    "kafka_server_replicamanager_partitioncount",
    "kafka_server_replicamanager_leadercount",
    "kafka_server_replicamanager_offlinereplicacount",
    "kafka_server_replicamanager_underreplicatedpartitions",
)


def split_payload(df: DataFrame, payload: str = "value", *, keep: Sequence[str] = ()) -> DataFrame:
    """Whole scrape responses to one row per line."""
    lines = F.split(F.col(payload).cast("string"), text.LINE_END)
    return df.select(*keep, F.explode(lines).alias("value"))


def parse_lines(
    df: DataFrame,
    stamp: Column,
    *,
    line: str = "value",
    strip_lines: bool = True,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Metric lines to ``metric`` (with its labels), ``value`` and ``timestamp``.

    Blank and comment lines, lines without a space, and values that are not
    numbers are skipped; ``NaN`` and infinities are numbers. ``stamp`` is one
    time per scrape. With ``strip_lines`` off, outer blanks are significant.
    """
    body = F.col(line).cast("string")
    body = text.strip(body) if strip_lines else body
    lines = df.select(*keep, stamp.alias("timestamp"), plan.once(body).alias("_line"))
    lines = lines.filter((F.col("_line") != "") & ~F.col("_line").startswith("#"))
    parts = lines.select(
        *keep,
        text.strip(text.before_last_space(F.col("_line"))).alias("metric"),
        F.when(F.contains("_line", F.lit(" ")), text.strip(text.after_last_space(F.col("_line"))))
        .alias("_text"),
        "timestamp",
    )
    samples = parts.select(
        *keep, "metric", plan.once(text.number(F.col("_text"))).alias("value"), "timestamp"
    )
    return samples.filter(F.col("value").isNotNull())


def name_filter(
    df: DataFrame, names: Sequence[str] = IMPORTANT_METRICS, *, column: str = "metric"
) -> DataFrame:
    """Rows whose metric text contains one of the names."""
    return df.filter(text.contains_any(F.col(column), names))


def row_text(metric: str = "metric", value: str = "value") -> Column:
    return F.concat_ws(": ", F.col(metric), F.col(value).cast("string"))


def to_points(
    df: DataFrame,
    measurement: str,
    *,
    tags: Sequence[str] = ("metric",),
    field: str = "value",
    time: str = "timestamp",
) -> DataFrame:
    """Samples to narrow points. Tags stay columns, so a scan can filter on them."""
    return df.select(
        F.col(time).alias("_time"),
        F.lit(measurement).alias("_measurement"),
        *[F.col(tag) for tag in tags],
        F.lit(field).alias("_field"),
        F.col(field).cast("double").alias("_value"),
    )


def rename(
    df: DataFrame,
    rules: Sequence[text.RenameRule] = text.BROKER_RULES,
    *,
    column: str = "name",
    drop_unmatched: bool = True,
) -> DataFrame:
    """Add ``metric``: the name given by the first rule that matches ``column``."""
    named = df.withColumn("metric", plan.once(text.renamed(F.col(column), rules)))
    return named.filter(F.col("metric").isNotNull()) if drop_unmatched else named


def relabel(
    df: DataFrame,
    *,
    column: str = "labels",
    prefixes: Sequence[str] = text.LABEL_PREFIXES,
    copies: Sequence[tuple[str, str]] = text.LABEL_COPIES,
) -> DataFrame:
    """Apply the label rules to a map column."""
    return df.withColumn(column, plan.once(text.relabel(F.col(column), prefixes, copies)))
