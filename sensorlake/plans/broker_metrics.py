"""Broker metrics: scrape text to points, and the views over stored points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorlake.functions import times
from sensorlake.operators import aggregates, metrics, series

MEASUREMENT = "kafka_metrics"

# The metrics the report covers, and the one its rate is of.
REPORTED = (
    "kafka_server_brokertopicmetrics_messagesin_total",
    "kafka_server_replicamanager_partitioncount",
    "kafka_server_replicamanager_underreplicatedpartitions",
)
RATED = REPORTED[0]


def collect(
    lines: DataFrame,
    stamp: Column,
    *,
    names: Sequence[str] = metrics.IMPORTANT_METRICS,
    **options,
) -> DataFrame:
    """Scrape lines to the points that are stored."""
    samples = metrics.parse_lines(lines, stamp, strip_lines=False, **options)
    return metrics.to_points(metrics.name_filter(samples, names), MEASUREMENT)


def recent_metrics(
    points: DataFrame,
    *,
    names: Sequence[str] | None = None,
    hours: int = 1,
    as_of: times.Instant = None,
    keys: Sequence[str] = ("_time",),
    order: str | None = None,
) -> DataFrame:
    """One column per metric over the last hours; the names found unless given."""
    rows = _recent(points, as_of=as_of, hours=hours)
    if names is None:
        return series.pivot_found(rows, keys, "metric", order=order)
    return series.pivot(rows, keys, "metric", names, order=order)


def statistics(
    points: DataFrame,
    *,
    names: Sequence[str] | None = REPORTED,
    hours: int = 1,
    as_of: times.Instant = None,
    unique: bool = False,
) -> DataFrame:
    """Statistics of each metric; ``unique`` as in ``first_last``, and known of stored points."""
    rows = _recent(points, as_of=as_of, hours=hours)
    return aggregates.metric_stats(rows, names=names, unique=unique or _unique(points))


def rates(
    points: DataFrame,
    *,
    names: Sequence[str] | None = (RATED,),
    minutes: int = 5,
    as_of: times.Instant = None,
    unique: bool = False,
) -> DataFrame:
    """Change per second of each metric over the last minutes, also as text."""
    rows = _recent(points, as_of=as_of, mins=minutes)
    if names is not None:
        rows = rows.filter(F.col("metric").isin(*names))
    changes = aggregates.rate_of_change(rows, unique=unique or _unique(points))
    return changes.withColumn("rate_text", aggregates.rate_text())


def _recent(points: DataFrame, *, as_of: times.Instant, **span: int) -> DataFrame:
    """Points of the span, each as written last; of stored points only its dates are read."""
    rows = series.series_filter(points, measurement=MEASUREMENT)
    date = "date" if "date" in points.columns else None
    return series.latest(series.recent(rows, as_of=as_of, date=date, **span))


def _unique(points: DataFrame) -> bool:
    return series.WRITTEN in points.columns
