from datetime import datetime, timedelta, timezone

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorlake.functions import times

UTC = timezone.utc


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def at(text):
    """A timestamp column for a UTC time, whatever the session zone."""
    return F.lit(text + "+00:00").cast("timestamp")


def age_rule(seconds: float) -> str:
    age = timedelta(seconds=seconds)
    hours, rest = divmod(age.seconds, 3600)
    if age.days > 0:
        return f"{age.days}d"
    return f"{hours}h" if hours > 0 else f"{rest // 60}m"


@pytest.mark.parametrize(
    "seconds,wanted", [(0, "0m"), (59 * 60, "59m"), (3600, "1h"), (86_399, "23h"), (86_400, "1d")]
)
def test_age_edges(spark, seconds, wanted):
    created = datetime(2024, 1, 1, tzinfo=UTC)
    as_of = times.instant(created + timedelta(seconds=seconds), T.TimestampType())
    assert one(spark, times.age_text(at("2024-01-01 00:00:00"), as_of)) == wanted


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(-200_000, 400_000_000), min_size=50, max_size=200))
def test_age_matches_the_plain_rule(spark, ages):
    as_of = times.instant(datetime(2024, 6, 1), T.TimestampType())
    rows = spark.createDataFrame([(a,) for a in ages], "a bigint").select(
        "a", times.age_text(F.timestamp_seconds(F.unix_seconds(as_of) - F.col("a")), as_of).alias("t")
    )
    assert all(row["t"] == age_rule(row["a"]) for row in rows.collect())


def test_age_without_a_time_is_null(spark):
    as_of = times.instant(datetime(2024, 6, 1), T.TimestampType())
    assert one(spark, times.age_text(F.lit(None).cast("timestamp"), as_of)) is None


def check_zone_free(spark):
    moment = at("2025-03-30 00:00:01.250000")
    assert one(spark, times.rfc3339(moment)) == "2025-03-30T00:00:01Z"
    assert one(spark, times.iso_seconds(moment)) == "2025-03-30T00:00:01+00:00"
    assert one(spark, times.utc_text(moment)) == "2025-03-30 00:00:01.250000+00:00"
    assert one(spark, times.utc_text(at("2025-03-30 00:00:01"))) == "2025-03-30 00:00:01+00:00"
    local = times.local_text_to_utc(F.lit("2025-04-02 15:19:50"))
    assert one(spark, F.unix_seconds(local)) == 1743574790
    wire = times.wire_time(F.lit("2025-03-30T00:00:00.000Z"))
    assert one(spark, F.unix_seconds(wire)) == 1743292800


def test_texts_under_utc(spark):
    check_zone_free(spark)


def test_texts_under_seoul(seoul):
    check_zone_free(seoul)


@pytest.mark.parametrize("text", ["2025-03-30T00:00:00Z", "2025-03-30 00:00:00.000Z", "x", ""])
def test_other_wire_times_are_null(spark, text):
    assert one(spark, times.wire_time(F.lit(text))) is None


def test_bad_local_time_is_null(spark):
    assert one(spark, times.local_text_to_utc(F.lit("02/04/2025"))) is None


def test_kst_window():
    start, stop = times.kst_window("2025-04-02 15:19:50", 1)
    assert start == datetime(2025, 4, 2, 6, 19, 50, tzinfo=UTC)
    assert stop - start == timedelta(minutes=1)
    with pytest.raises(ValueError):
        times.kst_window("2025-04-02", 1)


@pytest.mark.parametrize("dtype", [T.TimestampType(), T.TimestampNTZType()])
def test_instants_take_the_column_type(spark, dtype):
    kst = datetime(2024, 1, 1, 9, tzinfo=timezone(timedelta(hours=9)))
    value = times.instant(kst, dtype)
    assert spark.range(1).select(value.alias("v")).schema["v"].dataType == dtype
    assert one(spark, F.unix_seconds(value.cast("timestamp"))) == 1704067200
    assert one(spark, times.instant(None, dtype)) is not None
