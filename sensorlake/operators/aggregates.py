"""Summaries of series: statistics, first and last values, rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorlake.functions import quantiles, times
from sensorlake.operators.series import TIME

TRAFFIC = ("rx_mibps", "tx_mibps")


def summary(
    df: DataFrame,
    *,
    columns: Sequence[str] = TRAFFIC,
    deviations: Sequence[str] = ("tx_mibps",),
    time: str = TIME,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Row count, time extent, means, maxima and deviations in one pass.

    Columns that are not there are skipped; missing values and NaN do not
    count. Without ``keys`` an empty input gives one row: zero and nulls.
    """
    present = [name for name in columns if name in df.columns]
    aggregates = [
        F.count("*").alias("total_records"),
        F.min(time).alias("time_range_start"),
        F.max(time).alias("time_range_end"),
        *[F.avg(quantiles.clean(name)).alias(f"avg_{name}") for name in present],
        *[F.max(quantiles.clean(name)).alias(f"max_{name}") for name in present],
        *[
            F.stddev_samp(quantiles.clean(name)).alias(f"std_{name}")
            for name in deviations
            if name in present
        ],
    ]
    return df.groupBy(*keys).agg(*aggregates)


def describe(
    df: DataFrame,
    *,
    keys: Sequence[str] = ("_field",),
    value: str = "_value",
    saved: bool = False,
) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles of narrow rows."""
    return quantiles.describe(df, keys, value, saved=saved)


def describe_columns(df: DataFrame, columns: Sequence[str] = TRAFFIC) -> DataFrame:
    """The same for the wide columns that exist; one row per column.

    Wide rows come from a pivot, so their values are saved before the passes.
    """
    present = [name for name in columns if name in df.columns]
    doubles = df.select(*[F.col(name).cast("double") for name in present])
    narrow = doubles.unpivot([], present, "column", "value")
    return quantiles.describe(narrow, ["column"], "value", saved=True)


def metric_stats(
    df: DataFrame,
    *,
    keys: Sequence[str] = ("metric",),
    value: str = "_value",
    time: str = TIME,
    tie: str | None = None,
    unique: bool = False,
    names: Sequence[str] | None = None,
) -> DataFrame:
    """Statistics of every metric in one pass; a metric without rows has no row.

    ``tie`` and ``unique`` as in ``first_last``.
    """
    if names is not None:
        df = df.filter(F.col(keys[0]).isin(*names))
    number = quantiles.clean(value)
    return (
        df.groupBy(*keys)
        .agg(
            F.avg(number).alias("mean"),
            F.min(number).alias("min"),
            F.max(number).alias("max"),
            F.stddev_samp(number).alias("std"),
            F.count("*").alias("count"),
            F.max_by(value, _moment(time, tie, value, unique)).alias("last_value"),
            F.min(time).alias("_first"),
            F.max(time).alias("_last"),
        )
        .select(
            *keys,
            "mean",
            "min",
            "max",
            "std",
            "count",
            "last_value",
            F.concat_ws(" to ", times.utc_text(F.col("_first")), times.utc_text(F.col("_last"))).alias(
                "timestamp_range"
            ),
        )
    )


def first_last(
    df: DataFrame,
    *,
    keys: Sequence[str] = ("metric",),
    value: str = "_value",
    time: str = TIME,
    tie: str | None = None,
    unique: bool = False,
) -> DataFrame:
    """First and last value of every series, with their times, in one pass.

    ``tie`` names a column that orders equal times; without it the value does,
    so row order never matters. That costs a sort, because Spark's hash aggregate
    cannot hold a compound key. ``unique`` says that no series has a time twice,
    as in points read from the point store, and saves it.
    """
    moment = _moment(time, tie, value, unique)
    return df.groupBy(*keys).agg(
        F.min(time).alias("first_time"),
        F.min_by(value, moment).alias("first_value"),
        F.max(time).alias("last_time"),
        F.max_by(value, moment).alias("last_value"),
    )


def rate_of_change(
    df: DataFrame,
    *,
    keys: Sequence[str] = ("metric",),
    value: str = "_value",
    time: str = TIME,
    tie: str | None = None,
    unique: bool = False,
) -> DataFrame:
    """Change per second between the first and last value; zero without a time span.

    A counter that was reset in between is not corrected.
    """
    ends = first_last(df, keys=keys, value=value, time=time, tie=tie, unique=unique)
    seconds = (
        F.unix_micros(F.col("last_time").cast("timestamp"))
        - F.unix_micros(F.col("first_time").cast("timestamp"))
    ) / F.lit(1e6)
    change = F.col("last_value") - F.col("first_value")
    rate = F.when(seconds > 0, change / F.nullif(seconds, F.lit(0.0))).otherwise(F.lit(0.0))
    return ends.select(*keys, "first_value", "last_value", seconds.alias("seconds"), rate.alias("rate"))


def rate_text(rate: str | Column = "rate") -> Column:
    """The rate to two places."""
    return F.format_string("%.2f", rate)


def _moment(time: str, tie: str | None, value: str, unique: bool) -> Column:
    return F.col(time) if unique else F.struct(time, tie or value)
