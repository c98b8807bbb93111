"""Batch queries: each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorlake import schemas
from sensorlake.functions import text, times
from sensorlake.operators import (
    aggregates,
    decode,
    inventory,
    logs,
    metrics,
    report,
    results,
    series,
)
from sensorlake.plans import broker_metrics, table_check, traffic
from sensorlake.queries import inputs
from sensorlake.queries.inputs import events, naive, rounded
from sensorlake.session import work_dir
from sensorlake.sinks import tables as sinks
from sensorlake.sources import landed
from sensorlake.sources import tables as sources

Query = Callable[[SparkSession, str], DataFrame]

START, STOP = datetime(2024, 1, 5), datetime(2024, 1, 25)
AS_OF = datetime(2024, 1, 31)
MIDDLE = datetime(2024, 1, 16)
NODES_AS_OF = datetime(1999, 1, 1, 6, 30)
# Local time of the first instant in the data, and the minutes of 30 days.
KST_START, ALL_MINUTES = "2024-01-01 09:00:00", 43_200

QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# Scans and sources


@query
def lake_scan(spark, sf_dir):
    return sources.lake_scan(inputs.prepare(spark), f"{sf_dir}/events.parquet")


@query
def series_range_scan(spark, sf_dir):
    return series.range_scan(inputs.points(events(spark, sf_dir)), START, STOP)


@query
def points_store(spark, sf_dir):
    path = work_dir(inputs.prepare(spark), "points")
    rows = inputs.points(events(spark, sf_dir))
    sinks.append_points(rows, path, tags=["host", "interfaces"])
    return naive(
        sources.points_scan(
            spark,
            path,
            start=START,
            stop=STOP,
            measurement=traffic.MEASUREMENT,
            fields=["rx_mibps"],
        )
    ).withColumn("_measurement", F.col("_measurement").cast("string"))


@query
def points_last_write(spark, sf_dir):
    """Points written twice under names that look like numbers; the second write counts."""
    path = work_dir(inputs.prepare(spark), "rewritten")
    name = F.when(F.col("_field") == "rx_mibps", "007").otherwise("7")
    rows = inputs.points(events(spark, sf_dir)).withColumn("_measurement", name)
    for more in (0, 1):
        sinks.append_points(rows.withColumn("_value", F.col("_value") + more), path, tags=["host", "interfaces"])
    return naive(sources.points_scan(spark, path, start=START, stop=STOP, measurement="007"))


@query
def schema_report(spark, sf_dir):
    return report.schema_report(events(spark, sf_dir))


@query
def schema_merge_read(spark, sf_dir):
    path = work_dir(inputs.prepare(spark), "merge")
    rows = events(spark, sf_dir)
    early = F.col("event_type").isin("click", "view")
    sinks.append(rows.filter(early).select("event_id", "value"), path)
    sinks.append(rows.filter(~early).select("event_id", "value", "props"), path)
    return sources.lake_scan(spark, path, merge_schema=True).select("event_id", "value", "props")


# Decoding, cleaning, validation


@query
def json_decode(spark, sf_dir):
    messages = inputs.detection_messages(events(spark, sf_dir))
    rows = decode.decode_json(messages, schemas.DETECTIONS, keep=["offset"])
    return rounded(rows, "confidence")


@query
def threshold_filter(spark, sf_dir):
    messages = inputs.detection_messages(events(spark, sf_dir))
    rows = decode.decode_json(messages, schemas.DETECTIONS, keep=["offset"])
    return rounded(decode.threshold_filter(rows, "confidence", 0.9), "confidence")


@query
def positions_decode(spark, sf_dir):
    return naive(decode.decode_positions(inputs.position_messages(events(spark, sf_dir))))


@query
def sensor_decode(spark, sf_dir):
    return naive(decode.decode_sensor(inputs.sensor_messages(events(spark, sf_dir))))


@query
def malformed_split(spark, sf_dir):
    messages = inputs.detection_messages(events(spark, sf_dir))
    rows = decode.classify_messages(messages, schemas.DETECTIONS, keep=["offset"])
    return rows.select("offset", "id", "type", "reject_reason", decode.is_usable().alias("usable"))


@query
def to_json_messages(spark, sf_dir):
    messages = decode.to_json_messages(
        events(spark, sf_dir), columns=["event_id", "event_type", "value", "props"], key="event_id"
    )
    return messages.select(F.col("key").cast("string"), F.col("value").cast("string"))


@query
def command_validate(spark, sf_dir):
    messages = inputs.command_messages(inputs.table(spark, sf_dir, "conversations"))
    return decode.validate_commands(messages, keep=["conv_id", "turn"])


@query
def command_send(spark, sf_dir):
    messages = inputs.command_messages(inputs.table(spark, sf_dir, "conversations"))
    checked = decode.validate_commands(messages, keep=["conv_id"])
    sent = decode.accepted_commands(checked, key="conv_id")
    received = decode.decode_json(sent, schemas.COMMAND, keep=["key"])
    return received.withColumn("key", F.col("key").cast("string"))


@query
def coerce_time_drop(spark, sf_dir):
    rows = events(spark, sf_dir).select(
        "event_id",
        F.when(F.col("event_type") == "error", "not a time")
        .otherwise(F.col("ts").cast("string"))
        .alias("_time"),
    )
    return naive(series.coerce_time(rows))


# Metric, log and label text


@query
def prom_parse(spark, sf_dir):
    lines = inputs.metric_lines(events(spark, sf_dir))
    stamp = F.col("ts").cast("timestamp")
    return naive(metrics.parse_lines(lines, stamp, keep=["event_id"]))


@query
def prom_parse_unstripped(spark, sf_dir):
    lines = inputs.metric_lines(events(spark, sf_dir))
    stamp = F.col("ts").cast("timestamp")
    return naive(metrics.parse_lines(lines, stamp, strip_lines=False, keep=["event_id"]))


@query
def prom_file_scan(spark, sf_dir):
    path = work_dir(inputs.prepare(spark), "scrape")
    inputs.metric_lines(events(spark, sf_dir)).select("value").write.text(path)
    samples = landed.metric_files(spark, path)
    return samples.groupBy("metric").agg(
        F.count("*").alias("samples"),
        F.count_if(F.col("timestamp").isNotNull()).alias("stamped"),
        F.min("value").alias("least"),
        F.max("value").alias("most"),
    )


@query
def metric_name_filter(spark, sf_dir):
    lines = inputs.metric_lines(events(spark, sf_dir))
    samples = metrics.parse_lines(lines, F.col("ts"), keep=["event_id"])
    kept = metrics.name_filter(samples)
    return kept.select(
        "event_id", "metric", "value", metrics.row_text().alias("row_text")
    )


@query
def metric_rename(spark, sf_dir):
    names = inputs.raw_metric_names(events(spark, sf_dir))
    return metrics.rename(names, (*text.BROKER_RULES, *text.ZOOKEEPER_RULES))


@query
def metric_labels(spark, sf_dir):
    samples = metrics.parse_lines(inputs.metric_lines(events(spark, sf_dir)), F.col("ts"))
    labels = text.metric_labels(F.col("metric"))
    return (
        samples.select(
            text.metric_base_name(F.col("metric")).alias("name"),
            F.try_element_at(labels, F.lit("topic")).alias("topic"),
        )
        .groupBy("name", "topic")
        .agg(F.count("*").alias("samples"))
    )


@query
def label_map(spark, sf_dir):
    sets = metrics.relabel(inputs.label_sets(events(spark, sf_dir)))
    return sets.select("event_id", F.explode("labels").alias("label", "label_value"))


@query
def log_parse(spark, sf_dir):
    lines = inputs.log_lines(inputs.table(spark, sf_dir, "documents"))
    return naive(logs.parse_logs(lines, keep=["doc_id", "line_no"]))


@query
def to_points(spark, sf_dir):
    lines = inputs.metric_lines(events(spark, sf_dir))
    return naive(broker_metrics.collect(lines, F.col("ts").cast("timestamp")))


# Series filters and reshaping


@query
def series_filter(spark, sf_dir):
    return series.series_filter(
        inputs.points(events(spark, sf_dir)),
        measurement=traffic.MEASUREMENT,
        fields=["tx_mibps"],
        tags={"host": "click", "interfaces": None},
    )


@query
def series_recent(spark, sf_dir):
    return series.recent(events(spark, sf_dir), as_of=AS_OF, time="ts", days=10)


@query
def older_than(spark, sf_dir):
    return series.older_than(events(spark, sf_dir), as_of=MIDDLE, time="ts", mins=1)


@query
def older_than_count(spark, sf_dir):
    return series.older_than_count(events(spark, sf_dir), as_of=MIDDLE, time="ts", mins=1)


@query
def retention_cut(spark, sf_dir):
    return series.retention_cut(events(spark, sf_dir), hours=168, as_of=AS_OF, time="ts")


@query
def series_pivot(spark, sf_dir):
    points = inputs.hourly_points(events(spark, sf_dir))
    keys = ["_time", "host", "interfaces"]
    return naive(series.pivot(points, keys, "_field", traffic.FIELDS, order="seq"))


@query
def metric_pivot(spark, sf_dir):
    points = inputs.metric_points(events(spark, sf_dir))
    return broker_metrics.recent_metrics(
        points, names=metrics.IMPORTANT_METRICS, hours=720, as_of=AS_OF, order="seq"
    )


@query
def metric_pivot_found(spark, sf_dir):
    points = inputs.metric_points(events(spark, sf_dir))
    return broker_metrics.recent_metrics(points, hours=720, as_of=AS_OF, order="seq")


@query
def union_series(spark, sf_dir):
    rows = events(spark, sf_dir)
    kind = F.col("event_type")
    return series.union_series(
        [
            rows.filter(kind == "click").select("event_id", "ts", "value"),
            rows.filter(kind == "error").select("event_id", "props", "ts"),
            rows.filter(~kind.isin("click", "error")).select("ts", "event_id", "user_id"),
        ]
    )


@query
def head_n(spark, sf_dir):
    return report.head_n(events(spark, sf_dir), 5, ["ts", "event_id"])


@query
def tail_n(spark, sf_dir):
    return report.tail_n(events(spark, sf_dir), 5, ["ts", "event_id"])


# Summaries


def _hour_table(spark, sf_dir):
    points = inputs.hourly_points(events(spark, sf_dir))
    start, stop = times.kst_window(KST_START, ALL_MINUTES)
    return traffic.traffic_table(points, start, stop, order="seq")


_SUMMARY = ("avg_rx_mibps", "avg_tx_mibps", "max_rx_mibps", "max_tx_mibps", "std_tx_mibps")


@query
def series_summary(spark, sf_dir):
    return naive(rounded(aggregates.summary(_hour_table(spark, sf_dir)), *_SUMMARY))


@query
def series_describe(spark, sf_dir):
    described = aggregates.describe(inputs.points(events(spark, sf_dir)), keys=["host", "_field"])
    return rounded(described, "mean", "std", "min", "p25", "p50", "p75", "max")


@query
def traffic_describe(spark, sf_dir):
    described = aggregates.describe_columns(_hour_table(spark, sf_dir))
    return rounded(described, "mean", "std", "min", "p25", "p50", "p75", "max")


@query
def traffic_experiment(spark, sf_dir):
    row = traffic.experiment(
        inputs.hourly_points(events(spark, sf_dir)),
        label="all days",
        resolution="4K",
        reference_time_kst=KST_START,
        duration_minutes=ALL_MINUTES,
        host="click",
        order="seq",
    )
    return rounded(row, *_SUMMARY)


@query
def metric_stats(spark, sf_dir):
    points = inputs.metric_points(events(spark, sf_dir))
    stats = broker_metrics.statistics(points, hours=720, as_of=AS_OF, unique=True)
    return rounded(stats, "mean", "std")


@query
def rate_of_change(spark, sf_dir):
    rows = events(spark, sf_dir).withColumnsRenamed({"ts": "_time", "value": "_value"})
    rates = aggregates.rate_of_change(rows, keys=["user_id", "event_type"], unique=True)
    return rates.select(
        "user_id",
        "event_type",
        F.round("seconds", 6).alias("seconds"),
        F.round("rate", 9).alias("rate"),
    )


@query
def metric_rates(spark, sf_dir):
    points = inputs.metric_points(events(spark, sf_dir))
    rates = broker_metrics.rates(points, names=None, minutes=ALL_MINUTES, as_of=AS_OF, unique=True)
    return rates.select("metric", F.round("rate", 9).alias("rate"), "rate_text")


@query
def first_last(spark, sf_dir):
    return aggregates.first_last(
        events(spark, sf_dir), keys=["user_id", "event_type"], value="value", time="ts", unique=True
    )


@query
def equal_times(spark, sf_dir):
    """First and last of series with many rows at one time: the value settles which."""
    days = events(spark, sf_dir).withColumn("day", F.to_date("ts"))
    return aggregates.first_last(days, keys=["event_type"], value="value", time="day")


# Inventories


@query
def inventory_nodes(spark, sf_dir):
    documents = inputs.node_documents(inputs.table(spark, sf_dir, "orders"))
    return inventory.nodes(
        inventory.explode_items(documents, schemas.NODE_ITEM), as_of=NODES_AS_OF
    )


@query
def inventory_boxes(spark, sf_dir):
    documents = inputs.box_documents(inputs.table(spark, sf_dir, "customer"))
    return inventory.boxes(
        inventory.explode_items(documents, schemas.BOX_ITEM), alias_annotation=inputs.ALIAS
    )


@query
def inventory_scan(spark, sf_dir):
    path = work_dir(inputs.prepare(spark), "inventory")
    inputs.box_documents(inputs.table(spark, sf_dir, "customer")).write.text(path)
    items = landed.inventory_files(spark, path, schemas.BOX_ITEM, one_per_file=False)
    return (
        inventory.boxes(items, alias_annotation=inputs.ALIAS)
        .groupBy("cluster", "power", "state")
        .agg(F.count("*").alias("boxes"))
    )


@query
def age_format(spark, sf_dir):
    as_of = times.instant(AS_OF, T.TimestampType())
    return events(spark, sf_dir).select("event_id", times.age_text(F.col("ts"), as_of).alias("age"))


# Result rows


def _results(spark, sf_dir):
    """One result row per host."""
    summary = aggregates.summary(_hour_table(spark, sf_dir), keys=["host"])
    start, stop = times.kst_window(KST_START, ALL_MINUTES)
    rows = results.experiment_row(
        summary.withColumnRenamed("host", "experiment_label"),
        label=F.col("experiment_label"),
        resolution=F.when(F.col("experiment_label") == "view", "4k").otherwise("FHD"),
        reference_time_kst=KST_START,
        duration_minutes=ALL_MINUTES,
        start=start,
        stop=stop,
    )
    error = F.col("experiment_label") == "error"
    purchase = F.col("experiment_label") == "purchase"
    return rows.withColumns(
        {
            "avg_tx_mibps": F.when(~error, F.col("avg_tx_mibps")),
            "std_tx_mibps": F.when(~purchase, F.col("std_tx_mibps")),
        }
    )


@query
def results_filter(spark, sf_dir):
    rows = _results(spark, sf_dir)
    chart = results.chart_rows(rows, resolution="fhd", keep=["resolution"])
    return rounded(
        chart.withColumn("bar_text", results.bar_text()), "avg_tx_mibps", "std_tx_mibps"
    )


@query
def results_csv_roundtrip(spark, sf_dir):
    path = work_dir(inputs.prepare(spark), "results")
    sinks.append_results(_results(spark, sf_dir), path)
    read = sources.read_results(spark, path, required=["resolution", "avg_tx_mibps"])
    return rounded(read, *_SUMMARY)


# Time functions


@query
def tz_shift(spark, sf_dir):
    return naive(report.shifted_times(events(spark, sf_dir), "ts"))


@query
def kst_to_utc(spark, sf_dir):
    local = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    written = F.when(F.col("event_type") == "error", "15:19 today").otherwise(local)
    rows = events(spark, sf_dir).select("event_id", times.local_text_to_utc(written).alias("utc"))
    return naive(rows)


@query
def rfc3339_format(spark, sf_dir):
    return events(spark, sf_dir).select(
        "event_id",
        times.rfc3339(F.col("ts")).alias("written"),
        times.utc_text(F.col("ts")).alias("full"),
    )


@query
def table_check_counts(spark, sf_dir):
    rows = decode.decode_sensor(inputs.sensor_messages(events(spark, sf_dir)))
    return table_check.table_check(rows, as_of=MIDDLE).counts
