"""Batch writers.

A table of plain files is a set of batches: each lies in folders named by the
writer and the number of the batch, below the table's own partitions. Streams
and batch appends write alike, so every reader sees what all of them wrote. The
ledger of the table notes each batch that was written whole, and the columns.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorlake.operators import decode
from sensorlake.operators.series import TIME
from sensorlake.sinks import evolve, ledger
from sensorlake.sinks.ledger import BATCH_COLUMNS
from sensorlake.sources.tables import connector

POINT_PARTITIONS = ("_measurement", "date")
#: The writer of points, whose batches are numbered by the ledger.
POINTS = "points"
#: Writers of one batch are named so.
APPENDS = "append-"


def ensure_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    *,
    fmt: str = "parquet",
    name: str | None = None,
) -> None:
    """Create an empty table unless something is stored at the path already.

    With ``name`` the table is also entered in the catalog; call again to let
    the catalog see batches that were written since.
    """
    if fmt == "delta" or not ledger.Folder(spark, path).exists():
        with connector(fmt):
            spark.createDataFrame([], schema).write.format(fmt).mode("ignore").save(path)
    if name and not spark.catalog.tableExists(name):
        spark.catalog.createTable(name, path=path, source=fmt)
    if name and fmt != "delta" and any(c.isPartition for c in spark.catalog.listColumns(name)):
        spark.catalog.recoverPartitions(name)


def check_layout(spark: SparkSession, path: str, fmt: str = "parquet") -> None:
    """Raise an error where rows at the path would hide from readers of batches, or hide batches.

    That is a table of the file sink, whose log names the only files that count,
    and files with rows outside of any batch folder.
    """
    if fmt == "delta":
        return
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(place):
        return
    found = [(entry.getPath().getName(), entry.isFile()) for entry in system.listStatus(place)]
    if any(name == "_spark_metadata" for name, _ in found):
        raise ValueError(f"{path} is a table of the file sink; copy its rows to a new table")
    loose = [f"{path}/{name}" for name, is_file in found if is_file and name[0] not in "._"]
    if loose and not spark.read.format(fmt).load(loose).isEmpty():
        raise ValueError(f"{path} holds files with rows outside of batch folders; append them to a new table")


def write_files(
    rows: DataFrame,
    path: str,
    query_id: str,
    batch_id: int,
    *,
    fmt: str = "parquet",
    partition_by: Sequence[str] = (),
    order: Sequence[str] = (),
    options: Mapping[str, str] | None = None,
) -> None:
    """Write the files of one batch; writing them again replaces them and no others.

    Rows are gathered by partition first, so a batch makes a file for each
    partition it touches and not one for each task and partition.
    """
    if partition_by:
        rows = rows.hint("rebalance", *partition_by)
    if order:
        rows = rows.sortWithinPartitions(*partition_by, *order)
    marked = rows.withColumns({"query_id": F.lit(query_id), "batch_id": F.lit(batch_id).cast("long")})
    writer = marked.write.format(fmt).mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.options(**options or {}).partitionBy(*partition_by, *BATCH_COLUMNS).save(path)


def write_batch(
    rows: DataFrame,
    path: str,
    query_id: str,
    batch_id: int,
    *,
    fmt: str = "parquet",
    partition_by: Sequence[str] = (),
    order: Sequence[str] = (),
    options: Mapping[str, str] | None = None,
) -> int:
    """Write one batch of a table of files, and return its rows.

    A batch that is marked as written whole is not written again; one that
    failed on the way is replaced, and nothing else. A batch without rows leaves
    a file with the columns if the table has none.
    """
    spark = rows.sparkSession
    known = ledger.done(spark, path, query_id, batch_id)
    if known is not None:
        return known
    counted = Observation()
    rows = rows.observe(counted, F.count(F.lit(1)).alias("rows"))
    plain = T.StructType([field for field in rows.schema.fields if field.name not in partition_by])
    ensure_table(spark, path, plain, fmt=fmt)
    write_files(rows, path, query_id, batch_id, fmt=fmt, partition_by=partition_by, order=order, options=options)
    found = int(counted.get["rows"])
    ledger.mark(spark, path, query_id, batch_id, found)
    return found


def append(
    df: DataFrame, path: str, *, fmt: str = "parquet", partition_by: Sequence[str] = ()
) -> None:
    """Append rows; columns new to the table are allowed, and types that hold the old ones.

    A Delta table merges the columns on write. For Parquet files the columns of
    the table are noted beside it; a column whose type neither goes into the
    stored one nor can be read in its place is refused (``evolve.SchemaRefused``)
    before anything is written. ``evolve.changes`` shows what a write would do.
    """
    if fmt != "delta":
        check_layout(df.sparkSession, path, fmt)
        if fmt == "parquet":
            plain = T.StructType([f for f in df.schema.fields if f.name not in partition_by])
            df = evolve.fitted(df, evolve.settle(df.sparkSession, path, plain))
        write_batch(df, path, f"{APPENDS}{uuid.uuid4()}", 0, fmt=fmt, partition_by=partition_by)
        return
    writer = df.write.format(fmt).mode("append").option("mergeSchema", "true")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with connector(fmt):
        writer.save(path)


def append_points(
    df: DataFrame,
    path: str,
    *,
    tags: Sequence[str] = ("metric",),
    order: str | None = None,
    distinct: Mapping[str, int] | None = None,
) -> None:
    """Append points, partitioned by measurement and date, sorted by tag and time.

    Points of one series and time are one point: of those in ``df`` the last in
    ``order`` (the largest value, without it) is written. Writes are numbered by
    the ledger of the table, whatever the clocks say, and readers take the point
    of the highest number. The rebalance gathers each partition's rows into few
    files; AQE cuts a partition that is too large into several, so a hot day
    spreads over tasks.

    distinct: tags with the number of values that a file may hold of them. They
    get Parquet bloom filters, so that a filter on such a tag skips row groups
    without it; sorted tags skip by their ranges, too.
    """
    spark = df.sparkSession
    keys = [name for name in df.columns if name not in ("_value", order)]
    latest = F.max_by("_value", F.struct(order, "_value")) if order else F.max("_value")
    points = df.groupBy(*keys).agg(latest.alias("_value")).withColumn("date", F.to_date(TIME))
    names = evolve.partition_columns(spark, path)
    if names and not set(BATCH_COLUMNS) <= set(names):
        raise ValueError(f"{path} holds points without write numbers; append them to a new table")
    options = {f"parquet.bloom.filter.enabled#{tag}": "true" for tag in distinct or {}}
    options |= {f"parquet.bloom.filter.expected.ndv#{tag}": str(n) for tag, n in (distinct or {}).items()}
    number = ledger.write_number(spark, path)
    write_batch(points, path, POINTS, number, partition_by=POINT_PARTITIONS, order=[*tags, TIME], options=options)


def append_results(df: DataFrame, path: str) -> None:
    """Append result rows as CSV files, each with its header."""
    df.write.mode("append").option("header", "true").csv(path)


def write_messages(
    df: DataFrame,
    *,
    servers: str,
    topic: str,
    columns: Sequence[str] | None = None,
    key: str | None = None,
) -> None:
    """Send every row as a JSON message to a topic."""
    messages = decode.to_json_messages(df, columns=columns, key=key)
    writer = messages.write.format("kafka").option("kafka.bootstrap.servers", servers)
    with connector("kafka"):
        writer.option("topic", topic).save()
