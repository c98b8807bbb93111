import json

import pytest
from pyspark.sql import functions as F

from sensorlake import __main__ as cli
from sensorlake import schemas
from sensorlake.operators import decode
from sensorlake.sinks import tables as sinks
from sensorlake.sources import landed, messages
from sensorlake.sources import tables as sources
from sensorlake.streaming import jobs


class Topic:
    """A folder of message files that stands for a topic."""

    def __init__(self, spark, path):
        self.spark, self.path, self.offset = spark, str(path / "topic"), 0

    def send(self, *texts):
        rows = []
        for text in texts:
            value = None if text is None else bytearray(text.encode())
            rows.append((None, value, "t", 0, self.offset, None, 0))
            self.offset += 1
        df = self.spark.createDataFrame(rows, schemas.MESSAGE)
        df.coalesce(1).write.mode("append").parquet(self.path)
        return self

    def stream(self, **options):
        return messages.file_stream(self.spark, self.path, **options)


def detection(i, confidence):
    return json.dumps({"id": i, "type": "car", "confidence": confidence})


def sensor(i, day=30):
    return json.dumps({"@timestamp": f"2025-03-{day}T00:00:00.000Z", "objId": i, "TEMPERATURE": 1.5})


@pytest.fixture
def topic(spark, tmp_path):
    return Topic(spark, tmp_path)


@pytest.fixture
def place(tmp_path):
    return lambda name: str(tmp_path / name)


def run(query):
    assert query.awaitTermination(120)
    assert query.exception() is None


def test_detections_equal_the_batch_path_and_restart_reads_nothing_twice(spark, topic, place):
    topic.send(detection(1, 0.9), detection(2, 0.5), "broken", None)
    sinks.ensure_table(spark, place("table"), schemas.DETECTIONS)

    def go():
        rows = jobs.detections(topic.stream())
        run(jobs.start_append(rows, place("table"), place("marks"), available_now=True))
        return sorted(r["id"] for r in spark.read.parquet(place("table")).collect())

    assert go() == [1]
    assert go() == [1]
    topic.send(detection(3, 0.95))
    assert go() == [1, 3]
    batch = jobs.detections(spark.read.parquet(topic.path))
    assert sorted(r["id"] for r in batch.collect()) == [1, 3]


def test_positions_append(spark, topic, place):
    topic.send('{"id":1,"tag_id":"t","anchor_info":{"a":1}}')
    rows = decode.decode_positions(topic.stream())
    run(jobs.start_append(rows, place("table"), place("marks"), available_now=True))
    assert spark.read.parquet(place("table")).first()["anchor_info"] == '{"a":1}'


def test_sensor_append_stores_everything_without_a_reject_table(spark, topic, place):
    topic.send(sensor(1), "broken", "", sensor(2, 31))
    sinks.ensure_table(spark, place("table"), schemas.SENSOR)
    reports = []
    run(jobs.start_sensor_append(topic.stream(), place("table"), place("marks"),
                                 on_report=reports.append, available_now=True))
    table = jobs.read_batches(spark, place("table"), schemas.SENSOR)
    assert table.count() == 4 and table.filter("objId IS NULL").count() == 2
    assert [(r.batch_id, r.stored, r.rejected) for r in reports] == [(0, 4, 0)]
    assert table.filter("date = '2025-03-31'").select("objId").collect() == [(2,)]


def test_sensor_append_quarantines(spark, topic, place):
    topic.send(sensor(1), "broken", "", None, '{"objId":"x","TEMPERATURE":2.5}')
    reports = []
    options = dict(rejects=place("rejects"), on_report=reports.append, available_now=True)
    run(jobs.start_sensor_append(topic.stream(), place("table"), place("marks"), **options))
    topic.send(sensor(5))
    run(jobs.start_sensor_append(topic.stream(), place("table"), place("marks"), **options))
    table = jobs.read_batches(spark, place("table"), schemas.SENSOR)
    assert sorted((r["objId"] or 0, r["TEMPERATURE"]) for r in table.collect()) == [
        (0, 2.5), (1, 1.5), (5, 1.5),
    ]
    rejects = jobs.read_batches(spark, place("rejects"))
    assert sorted(r["reject_reason"] for r in rejects.collect()) == ["empty", "malformed", "null_value"]
    assert [(r.stored, r.rejected) for r in reports] == [(2, 3), (1, 0)]


def test_a_repeated_batch_replaces_itself(spark, place):
    rows = spark.range(10).select("id", F.lit("2024-01-01").cast("date").alias("date"))
    for _ in range(2):
        assert jobs._write_batch(rows, place("table"), "parquet", "q1", 7, ["date"]) == 10
    jobs._write_batch(rows, place("table"), "parquet", "q1", 8, ["date"])
    jobs._write_batch(rows, place("table"), "parquet", "q2", 7, ["date"])
    assert jobs.read_batches(spark, place("table")).count() == 30


def test_a_fresh_checkpoint_does_not_overwrite(spark, topic, place):
    topic.send(sensor(1))
    for marks in ("marks1", "marks2"):
        run(jobs.start_sensor_append(topic.stream(), place("table"), place(marks), available_now=True))
    assert jobs.read_batches(spark, place("table"), schemas.SENSOR).count() == 2


def test_a_failed_batch_is_written_once_after_restart(spark, topic, place):
    topic.send(detection(1, 0.95), detection(2, 0.99))
    calls = []

    def second(batch, batch_id):
        calls.append((batch_id, batch.count()))
        if len(calls) == 1:
            raise RuntimeError("second output is down")

    def start():
        return jobs.start_fan_out(jobs.detections(topic.stream()), place("table"), place("marks"),
                                  second=second, available_now=True)

    with pytest.raises(Exception, match="second output is down"):
        start().awaitTermination(120)
    run(start())
    assert calls == [(0, 2), (0, 2)]
    assert jobs.read_batches(spark, place("table")).count() == 2


def test_fan_out_shows_rows_by_default(topic, place, capfd):
    topic.send(detection(77, 0.95))
    run(jobs.start_fan_out(jobs.detections(topic.stream()), place("t"), place("m"), available_now=True))
    assert "|77" in capfd.readouterr().out


def test_debug_sinks(spark, topic):
    topic.send(detection(1, 0.95), detection(2, 0.1))
    rows = jobs.detections(topic.stream())
    run(jobs.start_debug(rows, fmt="memory", name="shown", available_now=True))
    assert spark.table("shown").collect() == [(1, "car", 0.95)]
    run(jobs.start_debug(rows, available_now=True))


def test_export_bounds_the_batch_size(spark, topic, place):
    for low in (0, 10, 20):
        topic.send(*[detection(i, 0.95) for i in range(low, min(low + 10, 25))])
    rows = topic.stream(max_files=1)
    run(jobs.start_export(rows, place("out"), place("marks"), max_records=10, available_now=True))
    sizes = spark.read.parquet(place("out")).groupBy("batch_id").count()
    assert sorted(r["count"] for r in sizes.collect()) == [5, 10, 10]
    with pytest.raises(Exception, match="bound it at the source"):
        jobs.start_export(topic.stream(), place("out2"), place("marks2"), max_records=10,
                          split=False, available_now=True).awaitTermination(120)


def test_streams_and_appends_share_a_table(spark, topic, place):
    topic.send(detection(1, 0.95), detection(2, 0.95))
    row = spark.createDataFrame([(9, "car", 0.9)], schemas.DETECTIONS)
    sinks.ensure_table(spark, place("table"), schemas.DETECTIONS)
    sinks.append(row, place("table"))
    for marks in ("m1", "m2"):
        run(jobs.start_append(jobs.detections(topic.stream()), place("table"), place(marks), available_now=True))
    sinks.append(row, place("table"))
    assert sorted(r["id"] for r in sources.lake_scan(spark, place("table")).collect()) == [1, 1, 2, 2, 9, 9]


def test_tables_that_hide_rows_are_refused(spark, topic, place):
    topic.send(detection(1, 0.95))
    rows = jobs.detections(topic.stream())
    old = rows.writeStream.format("parquet").option("checkpointLocation", place("m0"))
    run(old.trigger(availableNow=True).start(place("old")))
    spark.createDataFrame([(9, "car", 0.9)], schemas.DETECTIONS).write.parquet(place("loose"))
    for table in ("old", "loose"):
        with pytest.raises(ValueError, match="new table"):
            jobs.start_append(rows, place(table), place("m"), available_now=True)
        with pytest.raises(ValueError, match="new table"):
            sinks.append(spark.createDataFrame([(9, "car", 0.9)], schemas.DETECTIONS), place(table))


def test_one_file_per_trigger(spark, topic, place):
    topic.send(detection(1, 0.95)).send(detection(2, 0.95))
    query = jobs.start_append(topic.stream(max_files=1), place("t"), place("m"), available_now=True)
    run(query)
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 2


def test_processing_time_trigger(spark, topic, place):
    topic.send(detection(1, 0.95))
    query = jobs.start_append(jobs.detections(topic.stream()), place("t"), place("m"))
    query.processAllAvailable()
    topic.send(detection(2, 0.95))
    query.processAllAvailable()
    query.stop()
    assert spark.read.parquet(place("t")).count() == 2


def test_log_stream(spark, tmp_path, place):
    folder = tmp_path / "pods" / "p" / "c"
    folder.mkdir(parents=True)
    (folder / "0.log").write_text("2025-01-01T00:00:00.123456789Z stdout F hi\n")
    rows = landed.log_stream(spark, str(tmp_path / "pods/*/*/*.log"), max_files=1)
    run(jobs.start_append(rows, place("t"), place("m"), available_now=True))
    assert spark.read.parquet(place("t")).first()["message"] == "hi"


def test_checkpoint_inside_the_table_is_refused(topic, place):
    topic.send(detection(1, 0.95))
    with pytest.raises(ValueError, match="outside the table"):
        jobs.start_append(topic.stream(), place("t"), place("t") + "/marks")


def test_await_any_raises_a_failure(spark, topic, place):
    topic.send(detection(1, 0.95))

    def fail(batch, batch_id):
        raise RuntimeError("no")

    spark.streams.resetTerminated()
    jobs.start_fan_out(topic.stream(), place("t"), place("m"), second=fail)
    with pytest.raises(Exception, match="no"):
        jobs.await_any(spark)
    spark.streams.resetTerminated()


def test_jobs_run_from_the_command_line(spark, topic, place, tmp_path, capsys):
    topic.send(sensor(1), "broken")
    spark.streams.resetTerminated()
    cli.main(["sensors", "--files", topic.path, "--table", place("s"), "--checkpoint", place("m"),
              "--rejects", place("r"), "--available-now"])
    assert jobs.read_batches(spark, place("s"), schemas.SENSOR).count() == 1

    scrapes = tmp_path / "scrapes"
    scrapes.mkdir()
    (scrapes / "a.txt").write_text("kafka_server_replicamanager_partitioncount 5\nother 1\n")
    cli.main(["collect", "--scrapes", str(scrapes), "--points", place("points")])
    cli.main(["collect", "--scrapes", str(scrapes), "--points", place("points")])
    assert spark.read.parquet(place("points")).count() == 1
    cli.main(["metrics", "--points", place("points"), "--hours", "24"])
    assert "kafka_server_replicamanager_partitioncount" in capsys.readouterr().out
    cli.main(["check", "--table", place("points"), "--time", "_time"])
    assert "row_count" in capsys.readouterr().out


def test_traffic_from_the_command_line(spark, place, capsys):
    rows = spark.createDataFrame(
        [("2025-04-02 06:19:50", "tx_mibps", 2.0)], "t string, _field string, _value double"
    ).select(
        F.col("t").cast("timestamp").alias("_time"), F.lit("network_traffic").alias("_measurement"),
        F.lit("h").alias("host"), F.lit("eth0").alias("interfaces"), "_field", "_value",
    )
    sinks.append_points(rows, place("points"), tags=["host"])
    cli.main(["traffic", "--points", place("points"), "--results", place("out"),
              "--start", "2025-04-02 15:19:50", "--label", "run", "--resolution", "4k"])
    cli.main(["chart", "--results", place("out"), "--resolution", "4K"])
    assert "|run" in capsys.readouterr().out
