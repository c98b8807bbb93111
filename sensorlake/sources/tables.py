"""Lake tables, point tables and result files."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorlake import schemas
from sensorlake.operators import series
from sensorlake.sinks import ledger
from sensorlake.sinks.ledger import BATCH_COLUMNS


def lake_scan(
    spark: SparkSession,
    path: str,
    *,
    fmt: str = "parquet",
    columns: Sequence[str] | None = None,
    schema: T.StructType | None = None,
    merge_schema: bool = False,
) -> DataFrame:
    """A table at a path, without the bookkeeping columns of its batches.

    Batches that were rewritten or dropped are left out, and the columns are
    those that writers have noted. Where none are noted, ``merge_schema`` reads
    every file footer to find them all; give ``schema`` where they are known.
    """
    state = ledger.read(spark, path) if fmt != "delta" else ledger.State()
    schema = schema or state.columns
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    elif merge_schema:
        reader = reader.option("mergeSchema", "true")
    df = load(reader, fmt, path)
    if set(BATCH_COLUMNS) <= set(df.columns):
        df = ledger.visible(df, state).drop(*BATCH_COLUMNS)
    return df.select(*[f"`{name}`" for name in columns]) if columns else df


def read_files(spark: SparkSession, path: str, state: ledger.State) -> DataFrame:
    """All files of a table with their partition columns, in the noted columns where there are such."""
    types = {"_measurement": T.StringType(), "date": T.DateType(), "query_id": T.StringType(), "batch_id": T.LongType()}
    known = state.columns
    if known is None:
        known = spark.read.parquet(path).schema
    fields = [T.StructField(f.name, types.get(f.name, f.dataType)) for f in known.fields]
    if state.columns is not None:
        parts = spark.read.schema(known).parquet(path).columns
        fields += [T.StructField(n, types[n]) for n in parts if n in types and n not in known.fieldNames()]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def stamped(points: DataFrame) -> DataFrame:
    """Points with the number of their write, by which the last one counts, in place of batch columns."""
    if set(BATCH_COLUMNS) <= set(points.columns):
        return points.withColumn(series.WRITTEN, F.col("batch_id")).drop(*BATCH_COLUMNS)
    return points


def load(reader, fmt: str, path: str | None = None) -> DataFrame:
    with connector(fmt):
        return reader.load(path) if path else reader.load()


@contextmanager
def connector(fmt: str) -> Iterator[None]:
    """Say plainly when the connector for ``fmt`` is not installed."""
    try:
        yield
    except Exception as error:
        if "DATA_SOURCE_NOT_FOUND" in str(error) or "Failed to find data source" in str(error):
            raise RuntimeError(
                f"the {fmt} connector is not on the classpath; add its package to the session"
            ) from error
        raise


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """All stored points, repeated ones too; names and dates of partitions keep their types."""
    state = ledger.read(spark, path)
    return stamped(ledger.visible(read_files(spark, path, state), state))


def points_scan(
    spark: SparkSession,
    path: str,
    *,
    start: datetime,
    stop: datetime,
    measurement: str | None = None,
    fields: Sequence[str] | None = None,
    tags: Mapping[str, str | None] | None = None,
) -> DataFrame:
    """Points of a time range; only the measurement's and the range's partitions are read.

    Of points with the same series and time the last one written counts.
    """
    points = read_points(spark, path)
    points = series.range_scan(points, start, stop, date="date")
    points = series.series_filter(points, measurement=measurement, fields=fields, tags=tags)
    return series.latest(points).drop("date")


def read_results(
    spark: SparkSession,
    path: str,
    *,
    schema: T.StructType | None = schemas.EXPERIMENT_RESULT,
    required: Sequence[str] = (),
) -> DataFrame:
    """Result rows from CSV files with a header.

    With ``schema=None`` names and types are taken from the files. A required
    column that is missing is an error naming the columns there are.
    """
    reader = spark.read.option("header", "true")
    header = reader.csv(path).columns
    missing = [name for name in required if name not in header]
    if missing:
        raise ValueError(f"required columns {missing} not found; available columns: {header}")
    if schema is None:
        return reader.option("inferSchema", "true").csv(path)
    return reader.schema(schema).option("enforceSchema", "false").csv(path)


def table_exists(spark: SparkSession, path: str, fmt: str = "parquet") -> bool:
    """Whether a readable table lies at a path."""
    try:
        load(spark.read.format(fmt), fmt, path)
    except AnalysisException:
        return False
    return True
