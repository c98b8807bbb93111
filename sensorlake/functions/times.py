"""Instants, time zones and time text."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Instant = datetime | Column | None


def utc(moment: datetime) -> datetime:
    """``moment`` in UTC; a datetime without zone is taken as UTC already."""
    if moment.tzinfo is None:
        return moment.replace(tzinfo=timezone.utc)
    return moment.astimezone(timezone.utc)


def instant(moment: Instant, dtype: T.DataType) -> Column:
    """A value comparable with a column of ``dtype`` without casting the column.

    Casting the literal, not the column, keeps the comparison a filter that
    Parquet can apply. ``None`` means now.
    """
    zoneless = isinstance(dtype, T.TimestampNTZType)
    if moment is None:
        return F.localtimestamp() if zoneless else F.current_timestamp()
    if isinstance(moment, Column):
        return moment.cast(dtype)
    text = utc(moment).strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(text if zoneless else text + "+00:00").cast(dtype)


def column_instant(df: DataFrame, time: str, moment: Instant) -> Column:
    return instant(moment, df.schema[time].dataType)


def interval(**parts: int) -> Column:
    """A day-time interval from ``days``, ``hours``, ``mins`` and ``secs``."""
    return F.make_dt_interval(**{name: F.lit(n) for name, n in parts.items()})


def kst_window(reference: str, minutes: int) -> tuple[datetime, datetime]:
    """UTC start and stop of a window given by its local (UTC+9) start text."""
    local = datetime.strptime(reference, "%Y-%m-%d %H:%M:%S")
    start = local.replace(tzinfo=timezone(timedelta(hours=9))).astimezone(timezone.utc)
    return start, start + timedelta(minutes=minutes)


def local_text_to_utc(
    text: Column, pattern: str = "yyyy-MM-dd HH:mm:ss", offset: str = "+09:00"
) -> Column:
    """Parse local-time text written at a fixed offset; null when it is not a time.

    The offset is parsed with the text, so the result does not depend on the
    session time zone.
    """
    return F.try_to_timestamp(F.concat(text, F.lit(offset)), F.lit(pattern + "XXX"))


def wire_time(text: Column) -> Column:
    """ISO time text with milliseconds and a zone mark; null when it does not match."""
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSX"))


def rfc3339(moment: Column) -> Column:
    """UTC text to the second with ``Z``, whatever the session time zone."""
    return _utc_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def iso_seconds(moment: Column) -> Column:
    """UTC text to the second with a numeric offset."""
    return _utc_format(moment, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def utc_text(moment: Column) -> Column:
    """UTC text with a numeric offset; microseconds only when there are any."""
    micros = F.unix_micros(moment.cast("timestamp"))
    return F.when(
        micros % 1_000_000 == 0, _utc_format(moment, "yyyy-MM-dd HH:mm:ss'+00:00'")
    ).otherwise(_utc_format(moment, "yyyy-MM-dd HH:mm:ss.SSSSSS'+00:00'"))


def _utc_format(moment: Column, pattern: str) -> Column:
    # date_format prints in the session zone; the shift cancels that zone.
    return F.date_format(F.to_utc_timestamp(moment.cast("timestamp"), F.current_timezone()), pattern)


def age_text(created: Column, as_of: Column) -> Column:
    """``Nd`` from one day on, else ``Nh`` from one hour on, else ``Nm``."""
    seconds = F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(created.cast("timestamp"))
    rest = F.pmod(seconds, F.lit(86_400))
    hours = F.floor(rest / 3600)
    days = F.floor(seconds / 86_400)
    return (
        F.when(days > 0, F.concat(days.cast("string"), F.lit("d")))
        .when(hours > 0, F.concat(hours.cast("string"), F.lit("h")))
        .when(seconds.isNotNull(), F.concat(F.floor(rest % 3600 / 60).cast("string"), F.lit("m")))
    )
