from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from sensorlake.operators import report, series
from sensorlake.plans import table_check, traffic

POINT = "_time timestamp_ntz, _measurement string, host string, interfaces string, _field string, _value double, seq int"
T0 = datetime(2024, 1, 1)


def at(minute, second=0):
    return datetime(2024, 1, 1, 0, minute, second)


@pytest.fixture(scope="module")
def points(spark):
    rows = [
        (at(0), "network_traffic", "a", "eth0", "rx_mibps", 1.0, 1),
        (at(0), "network_traffic", "a", "eth0", "tx_mibps", 2.0, 2),
        (at(0), "network_traffic", "a", "eth0", "tx_mibps", 3.0, 3),
        (at(0), "network_traffic", "b", "eth0", "rx_mibps", 4.0, 4),
        (at(1), "network_traffic", "a", "eth0", "rx_mibps", 5.0, 5),
        (at(1), "network_traffic", "a", "eth0", "drops", 9.0, 6),
        (at(2), "network_traffic", "a", "eth0", "rx_mibps", 6.0, 7),
        (at(1), "disk", "a", "eth0", "rx_mibps", 7.0, 8),
    ]
    return spark.createDataFrame(rows, POINT)


def seqs(df):
    return sorted(row["seq"] for row in df.collect())


def test_range_takes_the_start_and_leaves_the_stop(points):
    assert seqs(series.range_scan(points, at(0), at(2))) == [1, 2, 3, 4, 5, 6, 8]
    assert seqs(series.range_scan(points, at(1), at(1))) == []
    aware = datetime(2024, 1, 1, 0, 1, tzinfo=timezone.utc)
    assert seqs(series.range_scan(points, aware, at(5))) == [5, 6, 7, 8]


def test_range_on_zoned_times(points):
    zoned = points.withColumn("_time", F.col("_time").cast("timestamp"))
    assert seqs(series.range_scan(zoned, at(0), at(2))) == [1, 2, 3, 4, 5, 6, 8]


def test_recent_and_older(points):
    assert seqs(series.recent(points, as_of=at(2), mins=1)) == [5, 6, 8]
    assert seqs(series.older_than(points, as_of=at(2), mins=1)) == [1, 2, 3, 4, 5, 6, 8]
    assert series.older_than_count(points, as_of=at(2), mins=1).collect() == [(8, 7)]
    assert seqs(series.recent(points, hours=1)) == []
    assert len(seqs(series.older_than(points, mins=1))) == 8


def test_retention(points):
    assert seqs(series.retention_cut(points, hours=1, as_of=datetime(2024, 1, 1, 1, 1))) == [5, 6, 7, 8]


def test_filters_are_optional(points):
    assert len(seqs(series.series_filter(points))) == 8
    found = series.series_filter(
        points, measurement="network_traffic", fields=["rx_mibps"], tags={"host": "a", "interfaces": None}
    )
    assert seqs(found) == [1, 5, 7]


def test_pivot_keeps_series_apart_and_the_last_value(points):
    rows = series.pivot(points, ["_time", "host"], "_field", traffic.FIELDS, order="seq")
    found = {(r["_time"], r["host"]): (r["rx_mibps"], r["tx_mibps"]) for r in rows.collect()}
    assert found == {
        (at(0), "a"): (1.0, 3.0), (at(0), "b"): (4.0, None), (at(1), "a"): (7.0, None),
        (at(2), "a"): (6.0, None),
    }


def test_pivot_shuffles_once(points):
    rows = series.pivot(points, ["_time", "host"], "_field", traffic.FIELDS, order="seq")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortAggregate" not in plan


def test_pivot_on_the_names_found(points):
    rows = series.pivot_found(points, ["_time"], "_field", order="seq")
    assert rows.columns == ["_time", "drops", "rx_mibps", "tx_mibps"]


def test_pivots_have_no_bound_on_names(spark):
    rows = spark.range(3_000).selectExpr("0 AS k", "concat('n', id) AS name", "double(id) AS _value")
    found = series.pivot_found(rows, ["k"], "name")
    assert len(found.columns) == 3_001 and found.first()["n2999"] == 2999.0
    mapped = series.pivot_map(rows, ["k"], "name").first()["values"]
    assert len(mapped) == 3_000 and mapped["n7"] == 7.0


def test_the_last_write_of_a_point_counts(spark):
    rows = spark.createDataFrame(
        [(1, "a", 9.0, 1), (1, "a", 2.0, 2), (2, "a", 5.0, 1)], "_time int, _field string, _value double, _written long"
    )
    assert sorted(r["_value"] for r in series.latest(rows).collect()) == [2.0, 5.0]
    assert {r["_time"]: r["a"] for r in series.pivot(rows, ["_time"], "_field", ["a"]).collect()} == {1: 2.0, 2: 5.0}


def test_keep_and_union(points, spark):
    assert series.keep_columns(points, ["host", "none", "_value"]).columns == ["host", "_value"]
    other = spark.createDataFrame([("x", 1)], "extra string, seq int")
    union = series.union_series([points, other])
    assert union.count() == 9 and union.filter("extra IS NOT NULL AND host IS NULL").count() == 1


def test_bad_times_are_dropped(spark):
    texts = ["2024-01-01 00:00:00", "2024-01-01T00:00:00Z", "2024-01-01", "soon", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "_time string")
    rows = series.coerce_time(df)
    assert rows.count() == 3 and rows.dtypes == [("_time", "timestamp")]


def test_head_and_tail(points):
    assert seqs(report.head_n(points, 2, ["_time", "seq"])) == [1, 2]
    assert seqs(report.tail_n(points, 2, ["_time", "seq"])) == [7, 8]
    plan = report.tail_n(points, 2, ["seq"])._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_named_result(points, spark):
    report.named(points.filter("host = 'b'"), "results")
    assert spark.sql("SELECT seq FROM results").collect() == [(4,)]


def test_schema_report(points):
    rows = report.schema_report(points).collect()
    assert [r["column_name"] for r in rows] == points.columns
    assert {r["row_count"] for r in rows} == {8} and rows[0]["data_type"] == "timestamp_ntz"


def test_table_check(spark):
    df = spark.createDataFrame([(T0, 1)], "t timestamp_ntz, n int").select(
        F.col("t").cast("timestamp").alias("@timestamp"), "n"
    )
    check = table_check.table_check(df, as_of=datetime(2024, 1, 2))
    assert check.counts.collect() == [(1, 1)] and check.older.count() == 1
    hours = check.shifted.select(
        ((F.col("as_local_if_utc").cast("long") - F.col("raw_ts").cast("long")) / 3600).alias("a"),
        ((F.col("as_utc_if_local").cast("long") - F.col("raw_ts").cast("long")) / 3600).alias("b"),
    )
    assert hours.collect() == [(9.0, -9.0)]


def test_filters_reach_the_scan(spark, tmp_path, points):
    path = str(tmp_path / "p")
    points.write.parquet(path)
    rows = series.series_filter(
        series.range_scan(spark.read.parquet(path), at(0), at(2)), fields=["rx_mibps"]
    ).select("_value")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "GreaterThanOrEqual(_time" in pushed and "LessThan(_time" in pushed
    assert "EqualTo(_field,rx_mibps)" in pushed and "seq" not in pushed
