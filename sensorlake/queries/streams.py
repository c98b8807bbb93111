"""Stream queries: the given tables are the stream, the written table the result."""

from __future__ import annotations

import uuid

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sensorlake import schemas
from sensorlake.operators import rollups
from sensorlake.queries import inputs
from sensorlake.queries.batch import Query
from sensorlake.queries.inputs import naive, rounded
from sensorlake.session import work_dir
from sensorlake.sinks import tables as sinks
from sensorlake.sources import landed, messages
from sensorlake.sources import tables as sources
from sensorlake.streaming import jobs
from sensorlake.streaming.progress import ProgressLog
from sensorlake.streaming.progress import read as read_progress

QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one events table as a stream; the brackets make its path a pattern."""
    schema = inputs.events(spark, sf_dir).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")


def _finish(*queries) -> None:
    for running in queries:
        running.awaitTermination()


@query
def stream_message_source(spark, sf_dir):
    base = work_dir(inputs.prepare(spark), "envelopes")
    inputs.detection_messages(inputs.events(spark, sf_dir)).write.parquet(f"{base}/landed")
    source = messages.file_stream(spark, f"{base}/landed", max_files=2)
    _finish(jobs.start_append(source, f"{base}/table", f"{base}/marks", available_now=True))
    rows = naive(sources.lake_scan(spark, f"{base}/table"))
    return rows.select(
        "topic",
        "offset",
        F.col("key").cast("string"),
        F.col("value").isNotNull().alias("has_value"),
        "timestamp",
    )


@query
def stream_detections_append(spark, sf_dir):
    base = work_dir(inputs.prepare(spark), "detections")
    sinks.ensure_table(spark, f"{base}/table", schemas.DETECTIONS)
    rows = jobs.detections(inputs.detection_messages(event_stream(spark, sf_dir)))
    _finish(jobs.start_append(rows, f"{base}/table", f"{base}/marks", available_now=True))
    return rounded(sources.lake_scan(spark, f"{base}/table"), "confidence")


@query
def stream_all_writers(spark, sf_dir):
    """A batch append, a stream, a second stream with a checkpoint of its own, a batch append."""
    base = work_dir(inputs.prepare(spark), "writers")
    table = f"{base}/table"
    landed_messages = inputs.detection_messages(inputs.events(spark, sf_dir))
    rows = jobs.detections(landed_messages).withColumn("writer", F.lit("batch 1"))
    sinks.append(rows, table)
    for turn in (1, 2):
        stream = jobs.detections(inputs.detection_messages(event_stream(spark, sf_dir)))
        stream = stream.withColumn("writer", F.lit(f"stream {turn}"))
        _finish(jobs.start_append(stream, table, f"{base}/marks{turn}", available_now=True))
    sinks.append(rows.withColumn("writer", F.lit("batch 2")), table)
    return rounded(sources.lake_scan(spark, table), "confidence")


@query
def stream_sensor_append(spark, sf_dir):
    base = work_dir(inputs.prepare(spark), "sensors")
    source = inputs.sensor_messages(event_stream(spark, sf_dir))
    _finish(
        jobs.start_sensor_append(
            source,
            f"{base}/table",
            f"{base}/marks",
            rejects=f"{base}/rejects",
            available_now=True,
        )
    )
    stored = naive(jobs.read_batches(spark, f"{base}/table", schemas.SENSOR)).drop("date")
    rejected = jobs.read_batches(spark, f"{base}/rejects")
    return stored.unionByName(rejected.select("reject_reason"), allowMissingColumns=True)


@query
def stream_restart(spark, sf_dir):
    base = work_dir(inputs.prepare(spark), "restart")
    envelopes = inputs.detection_messages(inputs.events(spark, sf_dir))
    for part in range(2):
        half = envelopes.filter(F.pmod("offset", F.lit(2)) == part)
        half.write.mode("append").parquet(f"{base}/landed")
        rows = jobs.detections(messages.file_stream(spark, f"{base}/landed"), minimum=0.0)
        _finish(jobs.start_append(rows, f"{base}/table", f"{base}/marks", available_now=True))
    return rounded(sources.lake_scan(spark, f"{base}/table"), "confidence")


@query
def stream_fan_out(spark, sf_dir):
    base = work_dir(inputs.prepare(spark), "fan")

    def second(batch, batch_id):
        counts = batch.groupBy("type").agg(F.count("*").alias("n"))
        counts.write.mode("overwrite").parquet(f"{base}/counts/batch_id={batch_id}")

    rows = jobs.detections(inputs.detection_messages(event_stream(spark, sf_dir)))
    _finish(
        jobs.start_fan_out(rows, f"{base}/table", f"{base}/marks", second=second, available_now=True)
    )
    table = jobs.read_batches(spark, f"{base}/table").groupBy("type")
    counts = spark.read.parquet(f"{base}/counts").groupBy("type")
    return table.agg(F.count("*").alias("in_table")).join(
        counts.agg(F.sum("n").alias("in_second")), "type", "full"
    )


@query
def stream_batched_export(spark, sf_dir):
    base = work_dir(inputs.prepare(spark), "export")
    envelopes = inputs.detection_messages(inputs.events(spark, sf_dir))
    envelopes.write.parquet(f"{base}/landed")
    rows = messages.file_stream(spark, f"{base}/landed", max_files=1).select("offset", "topic")
    _finish(jobs.start_export(rows, f"{base}/table", f"{base}/marks", available_now=True))
    flush = Window.partitionBy("query_id", "batch_id", "flush")
    stored = spark.read.parquet(f"{base}/table")
    within = (F.count("*").over(flush) <= jobs.EXPORT_RECORDS).alias("within_limit")
    return stored.select("offset", "topic", within)


@query
def stream_log_source(spark, sf_dir):
    base = work_dir(inputs.prepare(spark), "logs")
    lines = inputs.log_lines(inputs.table(spark, sf_dir, "documents"))
    # A carriage return would end a line of the text files, so it is written as a blank.
    lines.select(F.translate("value", "\r", " ").alias("value")).write.text(f"{base}/landed")
    rows = landed.log_stream(spark, f"{base}/landed")
    _finish(jobs.start_append(rows, f"{base}/table", f"{base}/marks", available_now=True))
    stored = sources.lake_scan(spark, f"{base}/table")
    return stored.groupBy("stream", "tag").agg(
        F.count("*").alias("lines"),
        F.sum(F.length("message")).alias("message_chars"),
        F.sum(F.length("body")).alias("body_chars"),
        F.count_if(F.col("ts").isNotNull()).alias("timed"),
    )


@query
def stream_log_growth(spark, sf_dir):
    """Logs of pods in three parts; after the second, half of the files are rotated before they are read."""
    base = work_dir(inputs.prepare(spark), "growth")
    lines = inputs.log_lines(inputs.table(spark, sf_dir, "documents"))
    lines = lines.withColumn("pod", F.col("doc_id") % 16).withColumn("part", F.pmod(F.xxhash64("doc_id", "line_no"), F.lit(3)))
    for part in range(3):
        inputs.grow_logs(lines, f"{base}/pods", part, rotate=part == 2)
        rows = landed.log_tail(spark, f"{base}/pods/*/app/*.log*")
        _finish(jobs.start_append(rows, f"{base}/table", f"{base}/marks", available_now=True))
    stored = sources.lake_scan(spark, f"{base}/table").groupBy("body").agg(F.count("*").alias("times"))
    return stored.groupBy(F.length("body").alias("chars")).agg(F.sum("times").alias("lines"), F.count("*").alias("texts"))


@query
def stream_fan_out_once(spark, sf_dir):
    """A failure between both outputs, then a restart: each holds every row once."""
    base = work_dir(inputs.prepare(spark), "once")
    failures = []

    def planted(batch):
        if not failures:
            failures.append("the second output is down")
            raise RuntimeError(failures[0])
        return batch.select("id", "type")

    def start():
        rows = jobs.detections(inputs.detection_messages(event_stream(spark, sf_dir)))
        return jobs.start_fan_out(
            rows, f"{base}/table", f"{base}/marks", second=f"{base}/second", transform=planted, available_now=True
        )

    try:
        _finish(start())
    except StreamingQueryException as error:
        if not failures or failures[0] not in str(error):
            raise
    _finish(start())
    both = [sources.lake_scan(spark, f"{base}/{name}").groupBy("type").agg(F.count("*").alias(f"in_{name}")) for name in ("table", "second")]
    return both[0].join(both[1], "type", "full")


@query
def stream_rollup(spark, sf_dir):
    """States by date and type from several batches, merged; quartiles against the ranks of all values."""
    base = work_dir(inputs.prepare(spark), "rollup")
    events = inputs.events(spark, sf_dir)
    for part in range(3):  # files in an order that is not that of time
        events.filter(F.pmod(F.xxhash64("event_id"), F.lit(3)) == part).write.mode("append").parquet(f"{base}/landed")
    rows = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/landed")
    _finish(jobs.start_rollup(rows, f"{base}/states", f"{base}/marks", keys=["event_type"], value="value", time="ts", available_now=True))
    found = rollups.merged(sources.lake_scan(spark, f"{base}/states"), ["event_type"])
    ranked = events.join(found, "event_type").groupBy(*found.columns)
    shares = [F.avg((F.col("value") <= F.col(name)).cast("double")) - share for name, share in rollups.QUANTILES.items()]
    near = [(F.abs(off) < rollups.RANK_ERROR + 0.002).alias(f"{name}_near") for name, off in zip(rollups.QUANTILES, shares, strict=True)]
    return rounded(ranked.agg(*near).drop(*rollups.QUANTILES), "mean", "std")


@query
def stream_progress(spark, sf_dir):
    """The log of a run of several batches, and of one that fails."""
    base = work_dir(inputs.prepare(spark), "progress")
    inputs.events(spark, sf_dir).repartition(3).write.parquet(f"{base}/landed")
    rows = spark.readStream.schema(inputs.events(spark, sf_dir).schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/landed")

    def fails(batch, batch_id):
        raise RuntimeError("the output is down")

    with ProgressLog(spark, f"{base}/log") as log:
        good = jobs.start_append(rows, f"{base}/table", f"{base}/marks", available_now=True)
        _finish(good)
        bad = jobs.start_fan_out(rows, f"{base}/other", f"{base}/marks2", second=fails, available_now=True)
        try:
            _finish(bad)
        except StreamingQueryException:
            pass
        for running in (good, bad):
            if not log.wait(str(running.runId)):
                raise TimeoutError("the end of a query was not reported")
    kept = read_progress(spark, f"{base}/log")
    batches = F.col("kind").isin("progress") & (F.col("query") == str(good.id)) & (F.col("input_rows") > 0)
    return kept.agg(
        F.sum(F.when(batches, F.col("input_rows"))).alias("input_rows"),
        F.count_distinct(F.when(batches, F.col("batch"))).alias("batches"),
        F.count_if((F.col("kind") == "failed") & F.contains("error", F.lit("the output is down"))).alias("failures"),
        F.count_if(F.col("kind") == "ended").alias("ended"),
    )


@query
def debug_sink(spark, sf_dir):
    """The surest detections in the memory sink of a test."""
    rows = jobs.detections(inputs.detection_messages(event_stream(inputs.prepare(spark), sf_dir)), minimum=0.99)
    name = f"shown_{uuid.uuid4().hex}"
    _finish(jobs.start_debug(rows, fmt="memory", name=name, available_now=True))
    return rounded(spark.table(name), "confidence")
