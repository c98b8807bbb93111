"""Run a job: ``spark-submit ... -m sensorlake`` or ``python -m sensorlake JOB``."""

from __future__ import annotations

import argparse
import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorlake import schemas, session
from sensorlake.operators import decode, results
from sensorlake.plans import broker_metrics, table_check, traffic
from sensorlake.sinks import tables as sinks
from sensorlake.sources import messages
from sensorlake.sources import tables as sources
from sensorlake.streaming import jobs


def _messages(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    if args.files:
        return messages.file_stream(spark, args.files)
    if not (args.servers and args.topic):
        raise SystemExit("give --servers and --topic, or --files")
    return messages.topic_stream(
        spark,
        servers=args.servers,
        topic=args.topic,
        group_id=args.group,
        starting_offsets=args.starting_offsets,
        max_offsets=args.max_offsets,
    )


def _stream(spark: SparkSession, args: argparse.Namespace) -> None:
    source = _messages(spark, args)
    options = dict(fmt=args.format, every=args.every, available_now=args.available_now)
    if args.job == "sensors":
        sinks.ensure_table(spark, args.table, schemas.SENSOR, fmt=args.format)
        jobs.start_sensor_append(
            source, args.table, args.checkpoint, rejects=args.rejects, **options
        )
    elif args.job == "positions":
        sinks.ensure_table(spark, args.table, schemas.POSITIONS, fmt=args.format)
        rows = decode.decode_positions(source)
        jobs.start_append(rows, args.table, args.checkpoint, **options)
    else:
        sinks.ensure_table(spark, args.table, schemas.DETECTIONS, fmt=args.format)
        rows = jobs.detections(source, minimum=args.minimum)
        jobs.start_append(rows, args.table, args.checkpoint, **options)
    jobs.await_any(spark)


def _collect(spark: SparkSession, args: argparse.Namespace) -> None:
    """Store the points of scrapes that no earlier run has taken."""
    lines = spark.readStream.text(args.scrapes).select("value", "_metadata.file_modification_time")

    def store(batch: DataFrame, _: int) -> None:
        points = broker_metrics.collect(batch, F.col("file_modification_time"))
        sinks.append_points(points, args.points)

    taken = args.checkpoint or args.points.rstrip("/") + "-collected"
    writer = lines.writeStream.foreachBatch(store).option("checkpointLocation", taken)
    writer.trigger(availableNow=True).start().awaitTermination()


def _traffic(spark: SparkSession, args: argparse.Namespace) -> None:
    row = traffic.experiment(
        sources.read_points(spark, args.points),
        label=args.label,
        resolution=args.resolution,
        reference_time_kst=args.start,
        duration_minutes=args.minutes,
        host=args.host,
        date="date",
    )
    sinks.append_results(row, args.results)


def _metrics(spark: SparkSession, args: argparse.Namespace) -> None:
    points = sources.read_points(spark, args.points)
    broker_metrics.statistics(points, hours=args.hours).show(truncate=False)
    broker_metrics.rates(points, minutes=args.minutes).show(truncate=False)


def _chart(spark: SparkSession, args: argparse.Namespace) -> None:
    required = ["resolution", "experiment_label", "avg_tx_mibps", "std_tx_mibps"]
    rows = sources.read_results(spark, args.results, required=required)
    results.chart_rows(rows, resolution=args.resolution).show(truncate=False)


def _check(spark: SparkSession, args: argparse.Namespace) -> None:
    table = sources.lake_scan(spark, args.table, fmt=args.format)
    check = table_check.table_check(table, time=args.time)
    print("session time zone:", spark.conf.get("spark.sql.session.timeZone"))
    for part in (check.columns, check.sample, check.counts, check.shifted, check.older):
        part.show(30, truncate=False)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sensorlake")
    commands = top.add_subparsers(dest="job", required=True)

    for name in ("detections", "positions", "sensors"):
        stream = commands.add_parser(name, help=f"store a stream of {name}")
        stream.set_defaults(run=_stream)
        stream.add_argument("--servers")
        stream.add_argument("--topic")
        stream.add_argument("--group")
        stream.add_argument("--starting-offsets", default="earliest")
        stream.add_argument("--max-offsets", type=int)
        stream.add_argument("--files", help="a folder of message files instead of a topic")
        stream.add_argument("--table", required=True)
        stream.add_argument("--checkpoint", required=True)
        stream.add_argument("--format", default="parquet")
        stream.add_argument("--every", default=jobs.EVERY)
        stream.add_argument("--available-now", action="store_true")
        if name == "detections":
            stream.add_argument("--minimum", type=float, default=0.9)
        if name == "sensors":
            stream.add_argument("--rejects")

    collect = commands.add_parser("collect", help="store landed metric scrapes as points")
    collect.set_defaults(run=_collect, format="parquet")
    collect.add_argument("--scrapes", required=True)
    collect.add_argument("--points", required=True)
    collect.add_argument("--checkpoint", help="where it is kept which scrapes are taken")

    experiment = commands.add_parser("traffic", help="summarise one traffic experiment")
    experiment.set_defaults(run=_traffic, format="parquet")
    experiment.add_argument("--points", required=True)
    experiment.add_argument("--results", required=True)
    experiment.add_argument("--start", required=True, help="local (UTC+9) start time")
    experiment.add_argument("--minutes", type=int, default=1)
    experiment.add_argument("--host")
    experiment.add_argument("--label", default="")
    experiment.add_argument("--resolution", default="")

    metrics = commands.add_parser("metrics", help="show metric statistics and rates")
    metrics.set_defaults(run=_metrics, format="parquet")
    metrics.add_argument("--points", required=True)
    metrics.add_argument("--hours", type=int, default=1)
    metrics.add_argument("--minutes", type=int, default=5)

    chart = commands.add_parser("chart", help="show the rows a traffic chart is drawn from")
    chart.set_defaults(run=_chart, format="parquet")
    chart.add_argument("--results", required=True)
    chart.add_argument("--resolution")

    check = commands.add_parser("check", help="look at a stored table")
    check.set_defaults(run=_check)
    check.add_argument("--table", required=True)
    check.add_argument("--format", default="parquet")
    check.add_argument("--time", default="@timestamp")
    return top


def main(arguments: Sequence[str] | None = None) -> None:
    args = parser().parse_args(arguments)
    logging.basicConfig(level=logging.INFO)
    spark = session.builder(f"sensorlake-{args.job}", lake_format=args.format).getOrCreate()
    args.run(session.prepare(spark), args)


if __name__ == "__main__":
    main()
