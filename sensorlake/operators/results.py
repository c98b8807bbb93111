"""Experiment result rows and the table a chart is drawn from."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorlake import schemas
from sensorlake.functions import times


def experiment_row(
    summary: DataFrame,
    *,
    label: str | Column,
    resolution: str | Column,
    reference_time_kst: str,
    duration_minutes: int,
    start: datetime,
    stop: datetime,
    only_with_data: bool = True,
) -> DataFrame:
    """A traffic summary with the experiment's labels and window; nothing when empty.

    Labels may be columns of a summary that has one row per experiment.
    """
    if only_with_data:
        summary = summary.filter(F.col("total_records") > 0)
    fixed = {
        "experiment_label": F.lit(label),
        "resolution": F.lit(resolution),
        "reference_time_kst": F.lit(reference_time_kst),
        "duration_minutes": F.lit(duration_minutes),
        "query_start_utc": F.lit(times.utc(start).isoformat(timespec="seconds")),
        "query_end_utc": F.lit(times.utc(stop).isoformat(timespec="seconds")),
        "actual_data_start": times.iso_seconds(F.col("time_range_start")),
        "actual_data_end": times.iso_seconds(F.col("time_range_end")),
    }
    columns = []
    for field in schemas.EXPERIMENT_RESULT.fields:
        if field.name in fixed:
            value = fixed[field.name]
        elif field.name in summary.columns:
            value = F.col(field.name)
        else:
            value = F.lit(None)
        columns.append(value.cast(field.dataType).alias(field.name))
    return summary.select(*columns)


def chart_rows(
    df: DataFrame,
    *,
    resolution: str | None = None,
    label: str = "experiment_label",
    mean: str = "avg_tx_mibps",
    deviation: str = "std_tx_mibps",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Label, mean and error bar of the rows that have a mean.

    ``resolution`` is compared without regard to case; a missing deviation is 0.
    """
    if resolution:
        df = df.filter(F.upper(F.col("resolution").cast("string")) == resolution.upper())
    return df.na.drop(subset=[mean]).na.fill({deviation: 0.0}).select(*keep, label, mean, deviation)


def bar_text(mean: str | Column = "avg_tx_mibps") -> Column:
    """The mean to one place, as written on its bar."""
    return F.format_string("%.1f", mean)
