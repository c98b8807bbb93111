"""Connected components of an edge table, by alternating large and small stars.

Every step is a grouping with a map-side minimum and a join, so a node with
very many edges costs no single task more than its share. The edges of each
step are written to the shared folder; nothing is gathered in the driver but
one row that tells whether a step changed anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorlake.llm import scratch


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, path: str) -> DataFrame:
    """For edges (a, b): one row (node, root) per node, root being the smallest node of its component.

    Nulls and loops are ignored, repeated edges count once, no edges give no rows.
    """
    held = edges.where("a is not null and b is not null and a <> b")
    held = held.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    spark, step = edges.sparkSession, 0
    held = scratch.save(held, f"{path}/0")
    mark = _mark(held)
    while True:
        both = held.union(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.save(large, f"{path}/{step}-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        step += 1
        after = scratch.save(small.union(least.select("u", F.col("m").alias("v"))).distinct(), f"{path}/{step}")
        now = _mark(after)
        scratch.drop(spark, f"{path}/{step - 1}-large")
        scratch.drop(spark, f"{path}/{step - 1}")
        held = after
        if now == mark:
            break
        mark = now
    roots = held.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return held.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
