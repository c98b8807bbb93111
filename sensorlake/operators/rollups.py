"""Summaries of series that are kept up to date, date by date.

A state holds what is needed to merge summaries: counts, mean and second
moment, extremes, first and last value with their times, and a quantile sketch.
States are made of new rows only and appended; a report merges the states of any
dates. Merged states equal one pass over all rows, whatever the order and the
batches they came in; quantiles are those of a KLL sketch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorlake.functions import quantiles
from sensorlake.operators.series import TIME

DATE = "date"
#: Size of a quantile sketch, and the share of ranks by which a quantile may be off at that size:
#: 2.296 / SKETCH_K ** 0.9723 with 99 percent confidence, here with three times as much room.
SKETCH_K = 1000
RANK_ERROR = 0.0085
QUANTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def states(rows: DataFrame, keys: Sequence[str], *, value: str = "_value", time: str = TIME) -> DataFrame:
    """One state for each series and date of the rows. Missing values and NaN count as rows only."""
    number, moment = quantiles.clean(value), F.struct(F.col(time).alias("t"), quantiles.clean(value).alias("v"))
    seen = F.when(number.isNotNull(), moment)
    return rows.groupBy(*keys, F.to_date(time).alias(DATE)).agg(
        F.count("*").alias("rows"),
        F.count(number).alias("n"),
        F.avg(number).alias("mean"),
        (F.var_pop(number) * F.count(number)).alias("m2"),
        F.min(number).alias("low"),
        F.max(number).alias("high"),
        F.min(time).alias("begin"),
        F.max(time).alias("end"),
        F.min(seen).alias("first"),
        F.max(seen).alias("last"),
        F.kll_sketch_agg_double(number, SKETCH_K).alias("sketch"),
    )


def merged(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Summaries of the states' rows by series.

    Columns: count (rows), mean, std (sample), min, max, first_time, last_time
    (of all rows), first_value and last_value (of equal times the smallest and
    the largest), and the quartiles, off by ``RANK_ERROR`` of the ranks at most.
    The second moments are taken about the mean of all states, so nothing is lost
    to cancellation.
    """
    every = Window.partitionBy(*keys)
    mean = F.sum(F.col("n") * F.col("mean")).over(every) / F.sum("n").over(every)
    off = F.coalesce(F.col("n") * F.pow(F.col("mean") - F.col("_mean"), F.lit(2)), F.lit(0.0))
    n = F.sum("n")
    return (
        found.withColumn("_mean", mean)
        .withColumn("_m2", F.coalesce("m2", F.lit(0.0)) + off)
        .groupBy(*keys)
        .agg(
            F.sum("rows").alias("count"),
            F.first("_mean").alias("mean"),
            F.when(n > 1, F.sqrt(F.sum("_m2") / (n - 1))).alias("std"),
            F.min("low").alias("min"),
            F.max("high").alias("max"),
            F.min("begin").alias("first_time"),
            F.max("end").alias("last_time"),
            F.min("first")["v"].alias("first_value"),
            F.max("last")["v"].alias("last_value"),
            F.kll_merge_agg_double(F.when(F.col("n") > 0, F.col("sketch"))).alias("_sketch"),
            n.alias("_n"),
        )
        .withColumns({
            name: F.when(F.col("_n") > 0, F.kll_sketch_get_quantile_double("_sketch", F.lit(share))) for name, share in QUANTILES.items()
        })
        .drop("_sketch", "_n")
    )
