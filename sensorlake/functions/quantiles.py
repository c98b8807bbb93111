"""Describe-style statistics with exact quartiles, spread over all tasks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorlake.session import ensure_checkpoint_dir, work_dir

# A group of at most this many values may be ranked within one task.
DIRECT_ROWS = 100_000
# Broadcast the per-group ranges up to this many groups (about 150 bytes each).
BROADCAST_GROUPS = 20_000

# Points read from a sketch, and its accuracy (one over the rank error).
_GRID = 500
_ACCURACY = 2_000


def clean(value: str | Column) -> Column:
    """The value with NaN read as missing, as the statistics skip both."""
    column = F.col(value) if isinstance(value, str) else value
    return F.nanvl(column.cast("double"), F.lit(None).cast("double"))


def describe(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    *,
    saved: bool = False,
    direct_rows: int = DIRECT_ROWS,
) -> DataFrame:
    """Count, mean, deviation, minimum, exact quartiles and maximum per group.

    The input is read several times. ``saved`` writes its keys and values to
    the shared folder first; use it when the input is more than a scan.
    """
    quartiles = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    stats = {
        "count": F.count("_v"),
        "mean": F.avg("_v"),
        "std": F.stddev_samp("_v"),
        "min": F.min("_v"),
        "max": F.max("_v"),
    }
    if saved:
        path = work_dir(df.sparkSession, "describe")
        df.select(*keys, value).write.parquet(path)
        df = df.sparkSession.read.parquet(path)
    result = grouped_quantiles(df, keys, value, quartiles, stats=stats, direct_rows=direct_rows)
    return result.select(*keys, "count", "mean", "std", "min", *quartiles, "max")


def grouped_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    quantiles: dict[str, float],
    *,
    stats: dict[str, Column] | None = None,
    direct_rows: int = DIRECT_ROWS,
) -> DataFrame:
    """Exact quantiles per group, interpolated linearly between neighbouring ranks.

    ``stats`` are further aggregates over the cleaned value ``_v``; they are
    worked out in the first pass, which also yields the group sizes. Spark's own
    ``percentile`` ranks the small groups. For the large ones each round narrows
    the group to the value range that must hold the wanted rank, found from a
    sketch with a known rank error, until what is left is small; values below
    the range are only counted. The first pass and the ranges are checkpointed,
    so all tasks, also repeated ones, use the same ranges.
    """
    keys = list(keys)
    if not keys:
        raise ValueError("name at least one grouping column")
    accuracy = min(direct_rows // 10, _ACCURACY)
    if accuracy < 1:
        raise ValueError("direct_rows must be at least ten")
    ensure_checkpoint_dir(df.sparkSession)

    data = df.select(*keys, clean(value).alias("_v"))
    sizes = (
        data.groupBy(*keys)
        .agg(
            F.count("_v").alias("_size"),
            *[column.alias(name) for name, column in (stats or {}).items()],
        )
        .checkpoint()
    )
    big = F.col("_size") > direct_rows
    groups, large = sizes.agg(F.count("*"), F.count_if(big)).first()
    data = data.filter(F.col("_v").isNotNull())
    if not large:
        found = _direct(data, keys, quantiles)
    else:
        large_sizes = sizes.filter(big).select(*keys, "_size")
        found = _narrowed(data, large_sizes, keys, quantiles, large, direct_rows, accuracy)
        if large < groups:
            rest = _join(data, _sized(large_sizes.select(*keys), large), keys, "left_anti")
            found = found.unionByName(_direct(rest, keys, quantiles))
    return _join(sizes, _sized(found, groups), keys, "left").drop("_size")


def _direct(data: DataFrame, keys: list[str], quantiles: dict[str, float]) -> DataFrame:
    points = F.array(*[F.lit(float(p)) for p in quantiles.values()])
    ranked = data.groupBy(*keys).agg(F.percentile("_v", points).alias("_q"))
    return ranked.select(*keys, *[F.col("_q")[i].alias(q) for i, q in enumerate(quantiles)])


def _narrowed(
    data: DataFrame,
    sizes: DataFrame,
    keys: list[str],
    quantiles: dict[str, float],
    groups: int,
    direct_rows: int,
    accuracy: int,
) -> DataFrame:
    names = list(quantiles)
    ranges = sizes.select(
        *keys,
        *[
            ((F.col("_size") - 1) * F.lit(float(p))).alias(f"_rank_{q}")
            for q, p in quantiles.items()
        ],
        *[F.lit(float("-inf")).alias(f"_lo_{q}") for q in names],
        *[F.lit(float("inf")).alias(f"_hi_{q}") for q in names],
    )
    turn = 0
    while True:
        joined = _with_ranges(data, ranges, keys, groups)
        # All ranges are still the same in the first turn: one sketch serves them.
        ranges = _tighter(joined, keys, names, direct_rows, accuracy, shared=turn == 0).checkpoint()
        turn += 1
        wide = [
            (F.col(f"_held_{q}") > direct_rows) & (F.col(f"_lo_{q}") < F.col(f"_hi_{q}"))
            for q in names
        ]
        if ranges.filter(reduce(lambda a, b: a | b, wide)).isEmpty():
            break
    found = _ranked(_with_ranges(data, ranges, keys, groups), keys, names).checkpoint()
    missed = found.filter("_missed")
    if missed.isEmpty():
        return found.drop("_missed")
    # A range that lost its rank starts anew from the whole group, with a finer sketch.
    again = _join(data, _sized(missed.select(*keys), groups), keys, "left_semi")
    rest = _join(sizes, _sized(missed.select(*keys), groups), keys, "left_semi")
    wider = _narrowed(again, rest, keys, quantiles, groups, direct_rows, 2 * accuracy)
    return found.filter("not _missed").drop("_missed").unionByName(wider)


def _sized(small: DataFrame, groups: int) -> DataFrame:
    """Broadcast one row per group where there are few enough groups.

    Beyond the bound the rows meet by key, and AQE splits hot keys.
    """
    return F.broadcast(small) if groups <= BROADCAST_GROUPS else small


def _with_ranges(data: DataFrame, ranges: DataFrame, keys: list[str], groups: int) -> DataFrame:
    return _join(data, _sized(ranges, groups), keys, "inner")


def _join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    marks = {k: f"_key_{i}" for i, k in enumerate(keys)}
    renamed = right.withColumnsRenamed(marks)
    same = [left[k].eqNullSafe(renamed[mark]) for k, mark in marks.items()]
    return left.join(renamed, reduce(lambda a, b: a & b, same), how).drop(*marks.values())


def _tighter(
    joined: DataFrame,
    keys: list[str],
    names: list[str],
    direct_rows: int,
    accuracy: int,
    shared: bool,
) -> DataFrame:
    """One pass: sketch the values strictly inside each range, cut it around its rank.

    Values equal to a bound are counted apart, so a value held by very many
    rows becomes a bound and stops counting towards the width.
    """
    grid = F.array(*[F.lit(i / _GRID) for i in range(_GRID + 1)])
    fixed = [f"_{part}_{q}" for q in names for part in ("rank", "lo", "hi")]
    aggregates = []
    sketched = names[:1] if shared else names
    for q in sketched:
        lo, hi, v = F.col(f"_lo_{q}"), F.col(f"_hi_{q}"), F.col("_v")
        inside = F.when((v > lo) & (v < hi), v)
        aggregates += [
            F.count(F.when(v < lo, 1)).alias(f"_below_{q}"),
            F.count(F.when(v == lo, 1)).alias(f"_at_{q}"),
            F.count(inside).alias(f"_inside_{q}"),
            F.percentile_approx(inside, grid, accuracy).alias(f"_sketch_{q}"),
        ]
    seen = joined.groupBy(*keys, *fixed).agg(*aggregates)
    columns: list[Column] = [F.col(k) for k in keys]
    for q in names:
        seen_as = names[0] if shared else q
        lo, hi, sketch = F.col(f"_lo_{q}"), F.col(f"_hi_{q}"), F.col(f"_sketch_{seen_as}")
        inside = F.col(f"_inside_{seen_as}")
        # Both neighbouring ranks, counted from the first value strictly inside.
        start = F.col(f"_below_{seen_as}") + F.col(f"_at_{seen_as}")
        low = F.floor(f"_rank_{q}") - start
        high = F.ceil(f"_rank_{q}") - start
        # Two sketch errors of room on either side; the sketch is off by one.
        slack = F.lit(2.0 / accuracy)
        width = F.greatest(inside, F.lit(1))
        first = F.floor((low / width - slack) * _GRID).cast("int")
        last = F.ceil(((high + 1) / width + slack) * _GRID).cast("int")
        cut = inside > direct_rows
        cut_low, cut_high = cut & (first >= 1), cut & (last <= _GRID - 1)
        new_lo = (
            F.when(lo == hi, lo)
            .when(high < 0, lo)
            .when(low >= inside, hi)
            .when(cut_low, F.get(sketch, first))
            .otherwise(lo)
        )
        new_hi = (
            F.when(lo == hi, hi)
            .when(high < 0, lo)
            .when(low >= inside, hi)
            .when(cut_high, F.get(sketch, last))
            .otherwise(hi)
        )
        share = (
            F.when(cut_high, last).otherwise(_GRID) - F.when(cut_low, first).otherwise(0)
        ) / F.lit(float(_GRID)) + slack
        columns += [
            F.col(f"_rank_{q}"),
            new_lo.alias(f"_lo_{q}"),
            new_hi.alias(f"_hi_{q}"),
            F.when(cut, inside * share).otherwise(inside).cast("double").alias(f"_held_{q}"),
        ]
    return seen.select(*columns)


def _ranked(joined: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Rank the distinct values left in each range by their counts."""
    wanted = [
        F.struct(
            F.lit(q).alias("_q"),
            F.col(f"_rank_{q}").alias("_rank"),
            (F.col("_v") <= F.col(f"_hi_{q}")).alias("_keep"),
            # Values below the range share one null entry, sorted first.
            F.when(F.col("_v") >= F.col(f"_lo_{q}"), F.col("_v")).alias("_x"),
        )
        for q in names
    ]
    kept = joined.select(*keys, F.inline(F.filter(F.array(*wanted), lambda w: w["_keep"])))
    counts = kept.groupBy(*keys, "_q", "_rank", "_x").agg(F.count("*").alias("_n"))
    order = Window.partitionBy(*keys, "_q").orderBy(F.col("_x").asc_nulls_first())
    upto = F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    low = F.floor("_rank")
    high = F.ceil("_rank")
    ends = (
        counts.withColumn("_upto", upto)
        .groupBy(*keys, "_q", "_rank")
        .agg(
            F.min(F.when(F.col("_upto") > low, F.col("_x"))).alias("_a"),
            F.min(F.when(F.col("_upto") > high, F.col("_x"))).alias("_b"),
            F.max(F.when(F.col("_x").isNull(), F.col("_n")).otherwise(0)).alias("_under"),
            F.max("_upto").alias("_all"),
        )
    )
    # The sketch's error bound puts the rank inside; were it not, the group is marked.
    held = (low >= F.col("_under")) & (high < F.col("_all"))
    part = F.col("_rank") - low
    between = F.when(part == 0, F.col("_a")).otherwise(
        (high - F.col("_rank")) * F.col("_a") + part * F.col("_b")
    )
    values = ends.select(*keys, "_q", between.alias("_quantile"), (~held).alias("_out"))
    return values.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_q") == q, F.col("_quantile"))).alias(q) for q in names],
        F.max("_out").alias("_missed"),
    )
