"""Streams from message source to lake table.

Every query takes its own checkpoint folder, which must lie outside the table.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from sensorlake import schemas
from sensorlake.operators import decode, rollups
from sensorlake.operators.series import TIME
from sensorlake.sinks import evolve, ledger
from sensorlake.sinks import tables as sinks
from sensorlake.sinks.ledger import BATCH_COLUMNS

log = logging.getLogger(__name__)

EVERY = "1 second"
# Fixed value: records an export batch may hold.
EXPORT_RECORDS = 1024


@dataclass(frozen=True)
class BatchReport:
    query_id: str
    batch_id: int
    stored: int
    rejected: int


def detections(messages: DataFrame, *, minimum: float = 0.9) -> DataFrame:
    """Decoded detections that are sure enough."""
    return decode.threshold_filter(
        decode.decode_json(messages, schemas.DETECTIONS), "confidence", minimum
    )


def start_append(
    rows: DataFrame,
    path: str,
    checkpoint: str,
    *,
    fmt: str = "parquet",
    partition_by: Sequence[str] = (),
    every: str = EVERY,
    available_now: bool = False,
) -> StreamingQuery:
    """Append a stream to a table, which other streams and batch appends may write too.

    A batch that is run again changes nothing. A query with a fresh checkpoint
    is another writer, whose rows are added. Columns are compared with those of
    the table at the start, as for a batch append.
    """
    _check_apart(path, checkpoint)
    sinks.check_layout(rows.sparkSession, path, fmt)
    table = None
    if fmt == "parquet":
        plain = T.StructType([f for f in rows.schema.fields if f.name not in partition_by])
        table = evolve.settle(rows.sparkSession, path, plain)

    def store(batch: DataFrame, batch_id: int) -> None:
        batch = evolve.fitted(batch, table) if table is not None else batch
        _write_batch(batch, path, fmt, _query_id(batch), batch_id, partition_by)

    return _foreach(rows, store, checkpoint, every, available_now)


def start_debug(
    rows: DataFrame,
    *,
    fmt: str = "console",
    name: str | None = None,
    every: str = EVERY,
    available_now: bool = False,
) -> StreamingQuery:
    """Show a stream on the console, or keep it in the ``memory`` sink of a test."""
    writer = rows.writeStream.outputMode("append").format(fmt)
    if name:
        writer = writer.queryName(name)
    return _trigger(writer, every, available_now).start()


def start_sensor_append(
    messages: DataFrame,
    path: str,
    checkpoint: str,
    *,
    rejects: str | None = None,
    strict: bool = False,
    fmt: str = "parquet",
    on_report: Callable[[BatchReport], None] | None = None,
    every: str = EVERY,
    available_now: bool = False,
) -> StreamingQuery:
    """Decode sensor messages and append them, partitioned by date.

    Without ``rejects`` every message is stored, one that cannot be read as a
    row of nulls. With it, unreadable messages go to that table with a reason.
    A batch that is run again replaces what it wrote before.
    """
    _check_apart(path, checkpoint)
    for table in filter(None, (path, rejects)):
        sinks.check_layout(messages.sparkSession, table, fmt)

    def store(batch: DataFrame, batch_id: int) -> None:
        query_id = _query_id(batch)
        if rejects is None:
            rows = decode.decode_sensor(batch)
            stored = _write_batch(_dated(rows), path, fmt, query_id, batch_id, ["date"])
            _report(BatchReport(query_id, batch_id, stored, 0), on_report)
            return
        parsed = decode.classify_messages(batch, schemas.SENSOR_WIRE)
        parsed = parsed.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            usable = decode.is_usable(strict)
            rows = decode.sensor_columns(parsed.filter(usable))
            bad = parsed.filter(~usable).select("message", "reject_reason")
            rejected = _write_batch(bad, rejects, fmt, query_id, batch_id)
            stored = _write_batch(_dated(rows), path, fmt, query_id, batch_id, ["date"])
        finally:
            parsed.unpersist()
        _report(BatchReport(query_id, batch_id, stored, rejected), on_report)

    return _foreach(messages, store, checkpoint, every, available_now)


def start_rollup(
    rows: DataFrame,
    path: str,
    checkpoint: str,
    *,
    keys: Sequence[str],
    value: str = "_value",
    time: str = TIME,
    every: str = EVERY,
    available_now: bool = False,
) -> StreamingQuery:
    """Keep summaries of series by date: each batch adds the states of its own rows, and no row is read again."""
    _check_apart(path, checkpoint)
    sinks.check_layout(rows.sparkSession, path)

    def store(batch: DataFrame, batch_id: int) -> None:
        found = rollups.states(batch, keys, value=value, time=time)
        _write_batch(found, path, "parquet", _query_id(batch), batch_id, [rollups.DATE])

    return _foreach(rows, store, checkpoint, every, available_now)


def start_fan_out(
    rows: DataFrame,
    path: str,
    checkpoint: str,
    *,
    second: str | Callable[[DataFrame, int], None] | None = None,
    transform: Callable[[DataFrame], DataFrame] | None = None,
    fmt: str = "parquet",
    every: str = EVERY,
    available_now: bool = False,
) -> StreamingQuery:
    """Feed a table and a second output from one read of the source.

    The second output shows some rows on the console unless one is given: the
    path of a table, which gets the batch or what ``transform`` makes of it and
    holds each batch once, whatever fails; or a function of the batch and its
    id. Each output notes the batches it has done, so after a failure only those
    that are missing run again. A function may see a batch again only if the
    failure came before it returned.
    """
    _check_apart(path, checkpoint)
    if isinstance(second, str):
        _check_apart(second, checkpoint)
        sinks.check_layout(rows.sparkSession, second, fmt)

    def store(batch: DataFrame, batch_id: int) -> None:
        spark, query_id = batch.sparkSession, _query_id(batch)
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            _write_batch(batch, path, fmt, query_id, batch_id)
            if second is None:
                batch.show(truncate=False)
            elif isinstance(second, str):
                _write_batch(transform(batch) if transform else batch, second, fmt, query_id, batch_id)
            elif ledger.done(spark, path, f"{query_id}.second", batch_id) is None:
                second(batch, batch_id)
                ledger.mark(spark, path, f"{query_id}.second", batch_id, 0)
        finally:
            batch.unpersist()

    return _foreach(rows, store, checkpoint, every, available_now)


def start_export(
    rows: DataFrame,
    path: str,
    checkpoint: str,
    *,
    max_records: int = EXPORT_RECORDS,
    split: bool = True,
    fmt: str = "parquet",
    every: str = EVERY,
    available_now: bool = False,
) -> StreamingQuery:
    """Flush what has arrived every second, as flushes of ``max_records`` rows and a last one of the rest.

    A batch may have any size; the number of a row's flush is the column
    ``flush``. A file holds whole flushes where a task has several, and files
    are as few as the tasks that read the batch. Without ``split`` a flush is a
    batch: the source bounds it (``max_offsets`` of a topic, ``max_files`` of
    files that hold no more), and a batch above the bound is an error that says so.
    """
    _check_apart(path, checkpoint)
    sinks.check_layout(rows.sparkSession, path, fmt)

    def store(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            if not split and (found := batch.count()) > max_records:
                raise ValueError(f"a batch has {found} rows, above {max_records}: bound it at the source")
            flushed = _flushes(batch, max_records) if split else batch
            _write_batch(flushed, path, fmt, _query_id(batch), batch_id)
        finally:
            batch.unpersist()

    return _foreach(rows, store, checkpoint, every, available_now)


def await_any(spark: SparkSession) -> None:
    """Wait until any query ends, and raise its failure at once."""
    spark.streams.awaitAnyTermination()


def read_batches(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A table written batch by batch, without its bookkeeping columns."""
    reader = spark.read
    if schema is not None:
        marks = T.StructType.fromDDL("query_id STRING, batch_id BIGINT, date DATE")
        names = set(schema.fieldNames())
        extra = [field for field in marks.fields if field.name not in names]
        reader = reader.schema(T.StructType([*schema.fields, *extra]))
    return ledger.visible(reader.parquet(path), ledger.read(spark, path)).drop(*BATCH_COLUMNS)


def _flushes(rows: DataFrame, max_records: int) -> DataFrame:
    """Rows with the number of their flush; only the row counts of the partitions are gathered."""
    found = rows.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()
    before = [0] * (1 + max((r["part"] for r in found), default=0))
    total = 0
    for r in sorted(found, key=lambda r: r["part"]):
        before[r["part"]] = total
        total += r["n"]
    # the low bits of the id are the place within the partition
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    place = place + F.get(F.lit(before).cast("array<bigint>"), F.spark_partition_id())
    return rows.withColumn("flush", F.floor(place / F.lit(max_records)).cast("long"))


def _dated(rows: DataFrame) -> DataFrame:
    return rows.withColumn("date", F.to_date("`@timestamp`"))


def _write_batch(
    rows: DataFrame,
    path: str,
    fmt: str,
    query_id: str,
    batch_id: int,
    partition_by: Sequence[str] = (),
) -> int:
    """Write one micro-batch so that writing it twice changes nothing; count its rows.

    Delta drops a repeated batch by its transaction mark. Plain files go to
    folders of their own, below those of the partitions; a batch that is marked
    as written whole is not written again, and else a repeat overwrites it. The
    query id, kept in the checkpoint, separates the batches of a query started
    afresh.
    """
    if fmt != "delta":
        return sinks.write_batch(rows, path, query_id, batch_id, fmt=fmt, partition_by=partition_by)
    counted = Observation()
    rows = rows.observe(counted, F.count(F.lit(1)).alias("rows"))
    writer = (
        rows.write.format(fmt)
        .mode("append")
        .option("mergeSchema", "true")
        .option("txnAppId", f"{query_id}:{path}")
        .option("txnVersion", batch_id)
    )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return int(counted.get["rows"])


def _query_id(batch: DataFrame) -> str:
    query_id = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    if not query_id:
        raise RuntimeError("the running query has no id")
    return query_id


def _foreach(
    rows: DataFrame,
    store: Callable[[DataFrame, int], None],
    checkpoint: str,
    every: str,
    available_now: bool,
) -> StreamingQuery:
    writer = rows.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return _trigger(writer, every, available_now).start()


def _trigger(writer: DataStreamWriter, every: str, available_now: bool) -> DataStreamWriter:
    if available_now:
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=every)


def _report(report: BatchReport, on_report: Callable[[BatchReport], None] | None) -> None:
    if report.stored or report.rejected:
        log.info(
            "batch %d: %d rows stored, %d rejected",
            report.batch_id,
            report.stored,
            report.rejected,
        )
    else:
        log.info("batch %d: no data", report.batch_id)
    if on_report:
        on_report(report)


def _check_apart(path: str, checkpoint: str) -> None:
    table, marks = path.rstrip("/") + "/", checkpoint.rstrip("/") + "/"
    if marks.startswith(table):
        raise ValueError("the checkpoint folder must lie outside the table")
