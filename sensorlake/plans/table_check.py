"""A look at a stored table: columns, rows, counts and time readings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from sensorlake.functions import times
from sensorlake.operators import report, series


@dataclass(frozen=True)
class TableCheck:
    columns: DataFrame
    sample: DataFrame
    counts: DataFrame
    shifted: DataFrame
    older: DataFrame


def table_check(
    df: DataFrame,
    *,
    time: str = "@timestamp",
    as_of: times.Instant = None,
    minutes: int = 1,
    rows: int = 30,
) -> TableCheck:
    """The parts of the check; each is lazy. The two counts take one pass."""
    older = series.older_than(df, as_of=as_of, time=time, mins=minutes)
    return TableCheck(
        columns=report.schema_report(df),
        sample=df.limit(rows),
        counts=series.older_than_count(df, as_of=as_of, time=time, mins=minutes),
        shifted=report.shifted_times(df, time).limit(rows),
        older=older.limit(rows // 3),
    )
