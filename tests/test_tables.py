from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sensorlake import schemas, session
from sensorlake.operators import results
from sensorlake.sinks import tables as sinks
from sensorlake.sources import landed, messages
from sensorlake.sources import tables as sources

RESULTS = [
    ("a", "4k", 1.5, None),
    ("b", "4K", None, 1.0),
    ("c", "FHD", 2.5, 0.5),
    ("d", None, 3.5, 0.5),
]


@pytest.fixture
def result_rows(spark):
    df = spark.createDataFrame(
        RESULTS, "experiment_label string, resolution string, avg_tx_mibps double, std_tx_mibps double"
    )
    columns = [
        F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name)
        for f in schemas.EXPERIMENT_RESULT.fields
    ]
    return df.select(*columns)


def test_chart_rows(result_rows):
    found = results.chart_rows(result_rows, resolution="4K").collect()
    assert found == [("a", 1.5, 0.0)]
    assert results.chart_rows(result_rows).count() == 3


def test_results_append_and_read(spark, tmp_path, result_rows):
    path = str(tmp_path / "results")
    sinks.append_results(result_rows, path)
    sinks.append_results(result_rows, path)
    read = sources.read_results(spark, path, required=["avg_tx_mibps"])
    assert read.schema == schemas.EXPERIMENT_RESULT
    assert sorted(map(str, read.collect())) == sorted(map(str, result_rows.collect() * 2))
    guessed = sources.read_results(spark, path, schema=None)
    assert dict(guessed.dtypes)["avg_tx_mibps"] == "double"


def test_missing_column_names_the_columns_there_are(spark, tmp_path):
    path = str(tmp_path / "r")
    spark.createDataFrame([(1, 2)], "a int, b int").write.option("header", "true").csv(path)
    with pytest.raises(ValueError, match=r"\['c'\].*\['a', 'b'\]"):
        sources.read_results(spark, path, schema=None, required=["a", "c"])


def test_ensure_table_leaves_a_table_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    assert not sources.table_exists(spark, path)
    sinks.ensure_table(spark, path, schemas.DETECTIONS)
    assert sources.table_exists(spark, path)
    assert sources.lake_scan(spark, path).schema == schemas.DETECTIONS
    sinks.append(spark.createDataFrame([(1, "car", 0.9)], schemas.DETECTIONS), path)
    sinks.ensure_table(spark, path, schemas.DETECTIONS, name="known_table")
    sinks.ensure_table(spark, path, schemas.DETECTIONS, name="known_table")
    assert spark.table("known_table").count() == 1
    spark.sql("DROP TABLE known_table")
    assert sources.lake_scan(spark, path, columns=["type"]).collect() == [("car",)]


def test_new_columns_merge(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.append(spark.createDataFrame([(1,)], "a int"), path)
    sinks.append(spark.createDataFrame([(2, "x")], "a int, b string"), path)
    merged = sources.lake_scan(spark, path, merge_schema=True)
    assert sorted(map(tuple, merged.collect())) == [(1, None), (2, "x")]
    given = sources.lake_scan(spark, path, schema=merged.schema)
    assert given.count() == 2


def test_points_are_partitioned_and_pruned(spark, tmp_path):
    path = str(tmp_path / "points")
    day = F.col("id") % 4
    points = spark.range(1000).select(
        F.timestamp_seconds(F.lit(1704067200) + day * 86400 + F.col("id")).alias("_time"),
        F.when(F.col("id") < 900, "m1").otherwise("m2").alias("_measurement"),
        F.concat(F.lit("h"), F.col("id") % 7).alias("metric"),
        F.lit("value").alias("_field"),
        F.col("id").cast("double").alias("_value"),
    )
    sinks.append_points(points, path)
    found = sources.points_scan(
        spark, path, start=datetime(2024, 1, 2), stop=datetime(2024, 1, 3), measurement="m1",
        tags={"metric": "h3"},
    )
    wanted = [i for i in range(900) if i % 4 == 1 and i % 7 == 3]
    assert sorted(r["_value"] for r in found.collect()) == wanted
    plan = found._jdf.queryExecution().executedPlan().toString()
    partitions = plan[plan.index("PartitionFilters") : plan.index("PushedFilters")]
    assert "_measurement" in partitions and "date" in partitions
    assert "EqualTo(metric,h3)" in plan[plan.index("PushedFilters") :]
    files = spark.read.parquet(path).select(F.input_file_name().alias("f")).distinct().count()
    assert files == 8


def test_a_hot_day_is_written_by_several_tasks(spark, tmp_path):
    path = str(tmp_path / "hot")
    i = F.col("id")
    day = F.when(i % 100 == 0, i % 700 / 100).otherwise(0).cast("bigint")
    points = spark.range(0, 200_000, 1, 8).select(
        F.timestamp_seconds(F.lit(1704067200) + day * 86400 + i % 86400).alias("_time"),
        F.lit("m").alias("_measurement"),
        F.md5(i.cast("string")).alias("metric"),
        F.lit("value").alias("_field"),
        F.rand(1).alias("_value"),
    )
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        sinks.append_points(points, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    written = spark.read.parquet(path)
    files = written.select("date", F.input_file_name().alias("f")).distinct().groupBy("date").count()
    counts = sorted(row["count"] for row in files.collect())
    assert written.count() == 200_000 and len(counts) == 7
    # A day that shares the hot day's hash partition is cut with it.
    assert counts[-1] >= 4 and counts[0] == 1


def test_metric_files_share_one_time(spark, tmp_path):
    folder = tmp_path / "scrapes"
    folder.mkdir()
    (folder / "1.txt").write_text("# HELP up\nup 1\ndown 2\n")
    rows = landed.metric_files(spark, str(folder)).collect()
    assert sorted(r["metric"] for r in rows) == ["down", "up"]
    assert len({r["timestamp"] for r in rows}) == 1 and rows[0]["timestamp"] is not None


def test_a_connector_that_is_not_there_is_named(spark):
    with pytest.raises(RuntimeError, match="kafka connector"):
        messages.topic_stream(spark, servers="h:1", topic="t", group_id="g", max_offsets=5)
    with pytest.raises(RuntimeError, match="delta connector"):
        sources.lake_scan(spark, "/tmp/none", fmt="delta")
    rows = spark.createDataFrame([(1, "car", 0.9)], schemas.DETECTIONS)
    with pytest.raises(RuntimeError, match="kafka connector"):
        sinks.write_messages(rows, servers="h:1", topic="t", key="id")
    with pytest.raises(RuntimeError, match="delta connector"):
        sinks.append(rows, "/tmp/none", fmt="delta")


def test_store_settings_come_from_the_environment():
    assert session.store_conf({}) == {}
    conf = session.store_conf({"SENSORLAKE_S3_ENDPOINT": "https://s:1", "SENSORLAKE_S3_ACCESS_KEY": "k"})
    assert conf["spark.hadoop.fs.s3a.connection.ssl.enabled"] == "true"
    assert conf["spark.hadoop.fs.s3a.path.style.access"] == "true"


def test_prepare_pins_the_zone(seoul):
    session.prepare(seoul)
    assert seoul.conf.get("spark.sql.session.timeZone") == "UTC"


def test_work_dirs_lie_in_the_shared_folder(spark):
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    one, two = session.work_dir(spark, "x"), session.work_dir(spark, "x")
    assert one != two and one.startswith(shared + "/x-")
