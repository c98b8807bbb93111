"""Filters and reshaping of time series kept as narrow rows.

A series row has ``_time``, ``_measurement``, tag columns, ``_field`` and
``_value``. Every filter compares the bare column with a literal, so it reaches
the Parquet scan; tables partitioned by ``date`` get the same range as a
partition filter.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorlake.functions import plan, times

TIME = "_time"
#: Columns that a pivot may find.
MOST_COLUMNS = 10_000
#: The number of the write of a stored point; the last write of a point counts.
WRITTEN = "_written"


def range_scan(
    df: DataFrame,
    start: datetime | Column,
    stop: datetime | Column,
    *,
    time: str = TIME,
    date: str | None = None,
) -> DataFrame:
    """Rows from ``start`` on and before ``stop``."""
    low, high = times.column_instant(df, time, start), times.column_instant(df, time, stop)
    result = df.filter((_column(time) >= low) & (_column(time) < high))
    if date:
        result = result.filter(
            (F.col(date) >= low.cast("date")) & (F.col(date) <= high.cast("date"))
        )
    return result


def recent(
    df: DataFrame,
    *,
    as_of: times.Instant = None,
    time: str = TIME,
    date: str | None = None,
    **span: int,
) -> DataFrame:
    """Rows of the last ``hours``, ``mins`` or ``days`` before ``as_of`` (default now)."""
    stop = times.column_instant(df, time, as_of)
    return range_scan(df, stop - times.interval(**span), stop, time=time, date=date)


def older_than(
    df: DataFrame,
    *,
    as_of: times.Instant = None,
    time: str = TIME,
    date: str | None = None,
    **age: int,
) -> DataFrame:
    """Rows at least ``age`` old at ``as_of`` (default now)."""
    limit = times.column_instant(df, time, as_of) - times.interval(**age)
    result = df.filter(_column(time) <= limit)
    return result.filter(F.col(date) <= limit.cast("date")) if date else result


def latest(points: DataFrame) -> DataFrame:
    """One row for each point: the one written last. Points without a time of writing stay as they are.

    A write holds a point once, so times of writing of one point differ and the
    grouping is a hash aggregate.
    """
    if WRITTEN not in points.columns:
        return points
    keys = [name for name in points.columns if name not in ("_value", WRITTEN)]
    found = points.groupBy(*keys).agg(F.max_by("_value", WRITTEN).alias("_value"))
    return found.select(*[_column(name) for name in points.columns if name != WRITTEN])


def older_than_count(
    df: DataFrame, *, as_of: times.Instant = None, time: str = TIME, **age: int
) -> DataFrame:
    """All rows and rows at least ``age`` old, counted in one pass."""
    limit = times.column_instant(df, time, as_of) - times.interval(**age)
    return df.agg(
        F.count("*").alias("total_rows"), F.count_if(_column(time) <= limit).alias("older_rows")
    )


def retention_cut(
    df: DataFrame,
    *,
    hours: int,
    as_of: times.Instant = None,
    time: str = TIME,
    date: str | None = None,
) -> DataFrame:
    """Rows still within the retention time; whole expired dates are not read."""
    limit = times.column_instant(df, time, as_of) - times.interval(hours=hours)
    result = df.filter(_column(time) >= limit)
    return result.filter(F.col(date) >= limit.cast("date")) if date else result


def series_filter(
    df: DataFrame,
    *,
    measurement: str | None = None,
    fields: Sequence[str] | None = None,
    tags: Mapping[str, str | None] | None = None,
) -> DataFrame:
    """Rows of one measurement, a set of fields, and the tags that are given."""
    if measurement is not None:
        df = df.filter(F.col("_measurement") == measurement)
    if fields is not None:
        df = df.filter(F.col("_field").isin(*fields))
    for tag, wanted in (tags or {}).items():
        if wanted is not None:
            df = df.filter(_column(tag) == wanted)
    return df


def keep_columns(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The wanted columns that exist, in the order asked for."""
    return df.select(*[_column(name) for name in wanted if name in df.columns])


def pivot(
    df: DataFrame,
    keys: Sequence[str],
    names: str,
    values: Sequence[str],
    *,
    value: str = "_value",
    order: str | None = None,
) -> DataFrame:
    """One row per key with a column for each of ``values`` found in ``names``.

    One shuffle on the keys after a map-side combine. When a key has several
    rows of one name, the one last in ``order`` is kept, and without ``order`` the
    one last written, where that is known, and else the largest value. ``order``
    must tell the rows of a cell apart, as the time of writing does.
    """
    order = order or (WRITTEN if WRITTEN in df.columns else None)
    cells = []
    for name in values:
        hit = F.col(names) == name
        cell = F.when(hit, F.col(value))
        kept = F.max_by(cell, F.when(hit, F.col(order))) if order else F.max(cell)
        cells.append(kept.alias(name))
    return df.filter(F.col(names).isin(*values)).groupBy(*keys).agg(*cells)


def pivot_found(
    df: DataFrame,
    keys: Sequence[str],
    names: str,
    *,
    value: str = "_value",
    order: str | None = None,
) -> DataFrame:
    """Pivot on the names present, ``MOST_COLUMNS`` at most.

    Finding the names is a job of its own over that one column. They become
    columns of the plan, so more of them are an error; ``pivot_map`` takes any number.
    """
    found = df.select(names).filter(F.col(names).isNotNull()).distinct().limit(MOST_COLUMNS + 1).collect()
    if len(found) > MOST_COLUMNS:
        raise ValueError(f"{names} has more than {MOST_COLUMNS} names; use pivot_map")
    return pivot(df, keys, names, sorted(row[0] for row in found), value=value, order=order)


def pivot_map(
    df: DataFrame,
    keys: Sequence[str],
    names: str,
    *,
    value: str = "_value",
    order: str | None = None,
) -> DataFrame:
    """One row per key with a map of name to value, for names without a bound; ``order`` as in ``pivot``."""
    order = order or (WRITTEN if WRITTEN in df.columns else None)
    cells = df.filter(F.col(names).isNotNull()).groupBy(*keys, names)
    cells = cells.agg((F.max_by(value, order) if order else F.max(value)).alias(value))
    entries = F.sort_array(F.collect_list(F.struct(names, value)))
    return cells.groupBy(*keys).agg(F.map_from_entries(entries).alias("values"))


def union_series(tables: Sequence[DataFrame]) -> DataFrame:
    """All rows of several tables; a column a table lacks is null there."""
    first, *rest = tables
    for table in rest:
        first = first.unionByName(table, allowMissingColumns=True)
    return first


def coerce_time(df: DataFrame, time: str = TIME) -> DataFrame:
    """Read the time column as a timestamp and drop rows where that fails."""
    if df.schema[time].dataType.typeName() == "string":
        df = df.withColumn(time, plan.once(F.try_to_timestamp(_column(time))))
    return df.na.drop(subset=[time])


def _column(name: str) -> Column:
    return F.col(f"`{name}`")
