"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Mapping

from pyspark.sql import SparkSession

# Settings that change results; they can be set on a running session.
RESULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}

# Settings that only change how work is spread.
PHYSICAL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}

# Environment names for an S3-compatible store; values never live in code.
_STORE_ENV = {
    "SENSORLAKE_S3_ENDPOINT": "spark.hadoop.fs.s3a.endpoint",
    "SENSORLAKE_S3_ACCESS_KEY": "spark.hadoop.fs.s3a.access.key",
    "SENSORLAKE_S3_SECRET_KEY": "spark.hadoop.fs.s3a.secret.key",
}

_DELTA_CONF = {
    "spark.sql.extensions": "io.delta.sql.DeltaSparkSessionExtension",
    "spark.sql.catalog.spark_catalog": "org.apache.spark.sql.delta.catalog.DeltaCatalog",
    "spark.databricks.delta.schema.autoMerge.enabled": "true",
}


def store_conf(env: Mapping[str, str] = os.environ) -> dict[str, str]:
    """Object-store settings taken from the environment; empty when none is set."""
    conf = {key: env[name] for name, key in _STORE_ENV.items() if env.get(name)}
    endpoint = conf.get("spark.hadoop.fs.s3a.endpoint")
    if endpoint:
        conf["spark.hadoop.fs.s3a.path.style.access"] = "true"
        conf["spark.hadoop.fs.s3a.connection.ssl.enabled"] = str(
            endpoint.startswith("https://")
        ).lower()
    return conf


def builder(
    app_name: str = "sensorlake",
    *,
    lake_format: str = "parquet",
    env: Mapping[str, str] = os.environ,
) -> SparkSession.Builder:
    """A session builder with the settings the jobs rely on."""
    conf = {**RESULT_CONF, **PHYSICAL_CONF, **store_conf(env)}
    if lake_format == "delta":
        conf.update(_DELTA_CONF)
    result = SparkSession.builder.appName(app_name)
    for key, value in conf.items():
        result = result.config(key, value)
    return result


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the result-changing settings on a session somebody else built."""
    for key, value in RESULT_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder path below the folder named in ``spark.checkpoint.dir``.

    A machine-local folder is used only when that setting is missing and the
    master is local, because no other machine could read it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = os.path.join(tempfile.gettempdir(), "sensorlake")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Leave a checkpoint folder that is set alone; set one on a local master."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(work_dir(spark, "checkpoint"))
