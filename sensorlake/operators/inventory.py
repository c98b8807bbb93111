"""Nested inventory documents to flat rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorlake import schemas
from sensorlake.functions import plan, times

MISSING = "N/A"
# Fixed value: the label prefix that marks a node's role.
ROLE_PREFIX = "node-role.kubernetes.io/"


def explode_items(
    df: DataFrame, item: T.StructType, *, value: str | None = "value", keep: Sequence[str] = ()
) -> DataFrame:
    """One row per entry of ``items``; ``value`` is JSON text, or None if parsed already."""
    if value is not None:
        document = F.from_json(F.col(value).cast("string"), schemas.item_list(item))
        df = df.select(*keep, plan.fields_once(document))
    return df.select(*keep, F.explode("items").alias("item")).select(*keep, "item.*")


def nodes(df: DataFrame, *, as_of: times.Instant = None, keep: Sequence[str] = ()) -> DataFrame:
    """Name, last condition, roles, age and version of each node."""
    created = F.try_to_timestamp(
        F.col("metadata.creationTimestamp"), F.lit("yyyy-MM-dd'T'HH:mm:ssX")
    )
    return df.withColumn("_created", created).select(
        *keep,
        F.col("metadata.name").alias("name"),
        _or_missing(F.try_element_at("status.conditions", F.lit(-1)).getField("type")).alias(
            "status"
        ),
        _roles(F.col("metadata.labels")).alias("roles"),
        times.age_text(F.col("_created"), times.instant(as_of, T.TimestampType())).alias("age"),
        _or_missing(F.col("status.nodeInfo.kubeletVersion")).alias("version"),
    )


def boxes(df: DataFrame, *, alias_annotation: str, keep: Sequence[str] = ()) -> DataFrame:
    """Placement and state of each box; a branch that is missing reads ``N/A``.

    ``alias_annotation`` is the annotation key that holds the alias. The
    documents carry no update time, so ``updated_at`` repeats the creation time.
    """
    alias = F.try_element_at("metadata.annotations", F.lit(alias_annotation))
    created = _or_missing(F.col("metadata.creationTimestamp"))
    return df.select(
        *keep,
        F.col("metadata.name").alias("name"),
        _or_missing(alias).alias("alias"),
        _or_missing(F.col("spec.metadata.rack")).alias("rack"),
        _or_missing(F.col("status.access.primary.address")).alias("address"),
        _or_missing(F.col("status.power")).alias("power"),
        _or_missing(F.col("spec.metadata.cluster")).alias("cluster"),
        _or_missing(F.col("spec.group.role")).alias("role"),
        _or_missing(F.col("status.state")).alias("state"),
        created.alias("created_at"),
        created.alias("updated_at"),
        _or_missing(F.col("status.network.speed")).alias("network_speed"),
        _or_missing(F.col("status.version")).alias("version"),
    )


def _or_missing(value: Column) -> Column:
    return F.coalesce(value, F.lit(MISSING))


def _roles(labels: Column) -> Column:
    keys = F.filter(F.map_keys(labels), lambda k: k.startswith(ROLE_PREFIX))
    names = F.transform(keys, lambda k: F.replace(k, F.lit(ROLE_PREFIX), F.lit("")))
    return F.coalesce(F.array_join(names, ","), F.lit(""))
