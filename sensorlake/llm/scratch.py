"""Tables that an operator writes on its way.

They lie in the folder that ``spark.checkpoint.dir`` names, which driver and
executors share. A later job reads them again, so a lost executor costs the
tasks it ran and never the steps before.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession) -> str:
    """A new folder for one call of an operator.

    Where the setting is absent, a local master gets a temporary folder (tests);
    any other master is an error, as its executors could not see such a folder.
    """
    base = spark.conf.get(_SETTING, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_SETTING} to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="sensorlake-")
        spark.conf.set(_SETTING, base)
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


@contextlib.contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """What is run inside has its shuffle files removed when it ends."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def save(df: DataFrame, path: str) -> DataFrame:
    """Writes df there and returns it as read from there."""
    spark = df.sparkSession
    with freed(spark):
        df.write.option("compression", "zstd").mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Removes a table that no result reads any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
