import math
from datetime import datetime

import pandas as pd
import pytest

from sensorlake.operators import aggregates
from sensorlake.plans import broker_metrics, traffic

NAN = float("nan")
WIDE = "_time timestamp_ntz, host string, rx_mibps double, tx_mibps double"


def at(second):
    return datetime(2024, 1, 1, 0, second // 60, second % 60)


def test_summary_skips_missing_values(spark):
    rows = [(at(0), "a", 1.0, NAN), (at(1), "a", None, 2.0), (at(2), "a", 4.0, 5.0)]
    row = aggregates.summary(spark.createDataFrame(rows, WIDE)).first()
    tx = pd.Series([NAN, 2.0, 5.0])
    assert row["total_records"] == 3
    assert (row["time_range_start"], row["time_range_end"]) == (at(0), at(2))
    assert row["avg_rx_mibps"] == 2.5 and row["max_rx_mibps"] == 4.0
    assert row["avg_tx_mibps"] == tx.mean() and row["max_tx_mibps"] == 5.0
    assert row["std_tx_mibps"] == pytest.approx(tx.std())


def test_summary_of_one_row_and_of_none(spark):
    one = aggregates.summary(spark.createDataFrame([(at(0), "a", 1.0, 2.0)], WIDE)).first()
    assert one["std_tx_mibps"] is None and one["avg_tx_mibps"] == 2.0
    none = aggregates.summary(spark.createDataFrame([], WIDE)).first()
    assert none["total_records"] == 0 and set(none[1:]) == {None}


def test_summary_without_the_columns(spark):
    df = spark.createDataFrame([(at(0), 1.0)], "_time timestamp_ntz, rx_mibps double")
    assert aggregates.summary(df).columns == [
        "total_records", "time_range_start", "time_range_end", "avg_rx_mibps", "max_rx_mibps",
    ]
    bare = aggregates.summary(df.select("_time"))
    assert bare.columns == ["total_records", "time_range_start", "time_range_end"]


def test_describe_wide_columns(spark):
    rows = [(at(i), "a", float(i), NAN if i else 1.0) for i in range(5)]
    found = {r["column"]: r for r in aggregates.describe_columns(spark.createDataFrame(rows, WIDE)).collect()}
    assert found["rx_mibps"]["p50"] == 2.0 and found["rx_mibps"]["count"] == 5
    assert found["tx_mibps"]["count"] == 1 and found["tx_mibps"]["std"] is None


METRIC = "_time timestamp_ntz, _measurement string, metric string, _field string, _value double"


def metric_rows(spark, *rows):
    return spark.createDataFrame([(at(s), "kafka_metrics", m, "value", v) for s, m, v in rows], METRIC)


def test_metric_statistics(spark):
    df = metric_rows(spark, (0, "a", 1.0), (10, "a", 4.0), (5, "a", NAN), (0, "b", 7.0), (0, 'a{x="1"}', 9.0))
    stats = broker_metrics.statistics(df, names=["a", "missing"], as_of=at(60))
    (row,) = stats.collect()
    assert (row["mean"], row["min"], row["max"], row["count"]) == (2.5, 1.0, 4.0, 3)
    assert row["std"] == pytest.approx(pd.Series([1.0, 4.0]).std()) and row["last_value"] == 4.0
    assert row["timestamp_range"] == "2024-01-01 00:00:00+00:00 to 2024-01-01 00:00:10+00:00"
    everything = broker_metrics.statistics(df, names=None, as_of=at(60))
    assert everything.count() == 3


def test_last_value_may_be_nan(spark):
    df = metric_rows(spark, (0, "a", 1.0), (1, "a", NAN))
    assert math.isnan(broker_metrics.statistics(df, names=["a"], as_of=at(60)).first()["last_value"])


def test_rates(spark):
    df = metric_rows(
        spark, (0, "up", 1.0), (10, "up", 6.0), (0, "one", 5.0), (0, "reset", 9.0), (30, "reset", 3.0)
    )
    rates = broker_metrics.rates(df, names=None, minutes=5, as_of=at(60))
    assert {r["metric"]: (r["rate"], r["rate_text"]) for r in rates.collect()} == {
        "up": (0.5, "0.50"), "one": (0.0, "0.00"), "reset": (-0.2, "-0.20"),
    }
    assert broker_metrics.rates(df, minutes=5, as_of=at(60)).count() == 0


def test_equal_times_have_no_rate_and_ties_can_be_ordered(spark):
    rows = [(at(0), "a", 1.0, 1), (at(0), "a", 2.0, 2), (at(0), "a", 3.0, 3)]
    df = spark.createDataFrame(rows, "_time timestamp_ntz, metric string, _value double, n int")
    row = aggregates.rate_of_change(df, tie="n").first()
    assert (row["first_value"], row["last_value"], row["rate"]) == (1.0, 3.0, 0.0)


def test_unique_points_use_hash_aggregation(spark):
    df = metric_rows(spark, (0, "a", 1.0))
    plan = aggregates.first_last(df, unique=True)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_recent_metrics_pivot(spark):
    df = metric_rows(spark, (0, "a", 1.0), (0, "b", 2.0), (1, "a", 3.0))
    rows = broker_metrics.recent_metrics(df, as_of=at(60))
    assert sorted(map(tuple, rows.collect())) == [(at(0), 1.0, 2.0), (at(1), 3.0, None)]


def test_experiment_row(spark):
    rows = [
        (datetime(2025, 4, 2, 6, 19, 50), "network_traffic", "h", "eth0", f, v)
        for f, v in (("rx_mibps", 1.0), ("tx_mibps", 2.0))
    ] + [(datetime(2025, 4, 2, 6, 20, 50), "network_traffic", "h", "eth0", "rx_mibps", 9.0)]
    points = spark.createDataFrame(
        rows, "_time timestamp_ntz, _measurement string, host string, interfaces string, _field string, _value double"
    )
    options = dict(label="run 1", resolution="4K", reference_time_kst="2025-04-02 15:19:50")
    (row,) = traffic.experiment(points, host="h", **options).collect()
    assert tuple(row) == (
        "run 1", "4K", "2025-04-02 15:19:50", 1, "2025-04-02T06:19:50+00:00",
        "2025-04-02T06:20:50+00:00", "2025-04-02T06:19:50+00:00", "2025-04-02T06:19:50+00:00",
        1, 1.0, 2.0, 1.0, 2.0, None,
    )
    assert traffic.experiment(points, host="other", **options).collect() == []
