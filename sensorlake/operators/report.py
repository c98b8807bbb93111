"""First and last rows, and the columns of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def head_n(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The first ``n`` rows by ``order``: a top-k in each task, then one merge."""
    return df.orderBy(*_columns(order)).limit(n)


def tail_n(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The last ``n`` rows by ``order``."""
    return df.orderBy(*[column.desc() for column in _columns(order)]).limit(n)


def schema_report(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type, and the table's row count."""
    entries = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(field.name).alias("column_name"),
                F.lit(field.dataType.simpleString()).alias("data_type"),
            )
            for i, field in enumerate(df.schema.fields)
        ]
    )
    return df.agg(F.count("*").alias("row_count")).select(F.inline(entries), "row_count")


def shifted_times(df: DataFrame, time: str, zone: str = "Asia/Seoul") -> DataFrame:
    """The raw time beside its two readings: UTC shown in ``zone``, and the reverse."""
    raw = F.col(f"`{time}`").cast("timestamp")
    return df.select(
        raw.alias("raw_ts"),
        F.from_utc_timestamp(raw, zone).alias("as_local_if_utc"),
        F.to_utc_timestamp(raw, zone).alias("as_utc_if_local"),
    )


def named(df: DataFrame, name: str) -> DataFrame:
    """Make a result known to SQL under a name."""
    df.createOrReplaceTempView(name)
    return df


def _columns(names: Sequence[str]) -> list[Column]:
    return [F.col(f"`{name}`") for name in names]
