"""Network traffic experiments: window, pivot, summary, result row."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame

from sensorlake.functions import times
from sensorlake.operators import aggregates, results, series

MEASUREMENT = "network_traffic"
FIELDS = aggregates.TRAFFIC


def traffic_table(
    points: DataFrame,
    start: datetime,
    stop: datetime,
    *,
    host: str | None = None,
    fields: Sequence[str] = FIELDS,
    order: str | None = None,
    date: str | None = None,
) -> DataFrame:
    """Wide traffic rows of a window, one per time, host and interface."""
    rows = series.range_scan(points, start, stop, date=date)
    rows = series.series_filter(
        rows, measurement=MEASUREMENT, fields=fields, tags={"host": host}
    )
    wide = series.pivot(rows, ["_time", "host", "interfaces"], "_field", fields, order=order)
    return series.keep_columns(wide, ["_time", "host", "interfaces", *fields])


def traffic_summary(
    points: DataFrame, start: datetime, stop: datetime, *, host: str | None = None, **options
) -> DataFrame:
    return aggregates.summary(traffic_table(points, start, stop, host=host, **options))


def experiment(
    points: DataFrame,
    *,
    label: str,
    resolution: str,
    reference_time_kst: str,
    duration_minutes: int = 1,
    host: str | None = None,
    **options,
) -> DataFrame:
    """The result row of one experiment, given its local start time and length."""
    start, stop = times.kst_window(reference_time_kst, duration_minutes)
    return results.experiment_row(
        traffic_summary(points, start, stop, host=host, **options),
        label=label,
        resolution=resolution,
        reference_time_kst=reference_time_kst,
        duration_minutes=duration_minutes,
        start=start,
        stop=stop,
    )
