"""Queries of tables that are looked after: compaction, retention, changes of columns."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from sensorlake.operators import report, series
from sensorlake.queries import inputs
from sensorlake.queries.batch import START, STOP, query
from sensorlake.queries.inputs import events, naive
from sensorlake.session import work_dir
from sensorlake.sinks import evolve, upkeep
from sensorlake.sinks import tables as sinks
from sensorlake.sources import tables as sources

NOW = timedelta(0)


def _parts(rows, n):
    return [rows.filter(F.pmod(F.xxhash64("event_id"), F.lit(n)) == part) for part in range(n)]


@query
def table_compaction(spark, sf_dir):
    """Batches of closed dates become one, a batch is run again, old files go: the rows stay."""
    path = work_dir(inputs.prepare(spark), "compaction")
    rows = events(spark, sf_dir).withColumn("date", F.to_date("ts"))
    for number, part in enumerate(_parts(rows, 3)):
        sinks.write_batch(part, path, "stream", number, partition_by=["date"])
    before = upkeep.table_files(spark, path).count()
    upkeep.compact(spark, path, closed=date(2024, 1, 20))
    sinks.write_files(_parts(rows, 3)[1], path, "stream", 1, partition_by=["date"])  # a replay that knows of no mark
    during = sources.lake_scan(spark, path).count()
    after = upkeep.table_files(spark, path).count()
    removed = upkeep.vacuum(spark, path, keep=NOW)
    kept = sources.lake_scan(spark, path).drop("date")
    return kept.withColumns({"rows_during": F.lit(during), "fewer_files": F.lit(after < before), "old_removed": F.lit(removed > 0)})


@query
def points_compaction(spark, sf_dir):
    """Points written twice and compacted, then a third time for some hosts; the last write counts."""
    path = work_dir(inputs.prepare(spark), "merged")
    rows = inputs.points(events(spark, sf_dir))
    for more in (0, 1):
        sinks.append_points(rows.withColumn("_value", F.col("_value") + more), path, tags=["host", "interfaces"])
    upkeep.compact(spark, path)
    upkeep.vacuum(spark, path, keep=NOW)
    once = upkeep.table_files(spark, path).agg(F.sum("rows")).first()[0]
    late = rows.filter("host = 'click'").withColumn("_value", F.col("_value") + 2)
    sinks.append_points(late, path, tags=["host", "interfaces"])
    found = sources.points_scan(spark, path, start=START, stop=STOP, measurement="network_traffic", fields=["rx_mibps"])
    distinct = rows.select(series.TIME, "_measurement", "_field", "host", "interfaces").distinct().count()
    return naive(found).withColumn("stored_once", F.lit(once == distinct))


@query
def retention_drop(spark, sf_dir):
    """Rows before a limit go by the names of their dates; the date of the limit is written anew."""
    path = work_dir(inputs.prepare(spark), "retention")
    rows = events(spark, sf_dir).withColumn("date", F.to_date("ts"))
    for part in _parts(rows, 2):
        sinks.append(part, path, partition_by=["date"])
    limit = datetime(2024, 1, 24, 12)
    later = upkeep.table_files(spark, path).filter(F.regexp_extract("path", r"date=([\d-]+)", 1) > "2024-01-24")
    untouched = [r["path"] for r in later.collect()]  # a file for each date and batch
    upkeep.drop_before(spark, path, limit, time_column="ts")
    upkeep.vacuum(spark, path, keep=NOW)
    again = upkeep.drop_before(spark, path, limit, time_column="ts")
    left = {r["path"] for r in upkeep.table_files(spark, path).collect()}
    flags = {"again": F.lit(again), "later_untouched": F.lit(set(untouched) <= left)}
    return sources.lake_scan(spark, path).drop("date").withColumns(flags)


@query
def schema_changes(spark, sf_dir):
    """An int column that becomes a double one, a new column, and a text that is refused."""
    path = work_dir(inputs.prepare(spark), "columns")
    rows = events(spark, sf_dir)
    early = F.col("event_type").isin("click", "view")
    sinks.append(rows.filter(early).select("event_id", F.col("value").cast("int").alias("amount")), path)
    sinks.append(rows.filter(~early).select("event_id", F.col("value").alias("amount"), "props"), path)
    refused = rows.select("event_id", F.lit("much").alias("amount"))
    try:
        sinks.append(refused, path)
        why = "nothing was refused"
    except evolve.SchemaRefused as error:
        why = str(error)
    offered = evolve.changes(spark, path, refused.schema).filter("action = 'refuse'").count()
    return sources.lake_scan(spark, path).withColumns({"why": F.lit(why), "refused_columns": F.lit(offered)})


@query
def metric_pivot_map(spark, sf_dir):
    """A map of names to values for each time, as its entries."""
    points = inputs.metric_points(events(spark, sf_dir))
    wide = series.pivot_map(points, [series.TIME], "metric", order="seq")
    return naive(wide.select(series.TIME, F.explode("values").alias("metric", "value")))


@query
def named_result(spark, sf_dir):
    """SQL over a result by its name."""
    report.named(events(spark, sf_dir), "named_events")
    return spark.sql("SELECT event_type, count(*) AS n, max(ts) AS latest FROM named_events GROUP BY event_type")
