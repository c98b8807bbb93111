"""A join of rows with one row per key, whatever share of the rows one key holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys of more than one row in so many are fewer than this, and are broadcast.
HOT = 1000


def beside(rows: DataFrame, table: DataFrame, key: str, count: str, total: int, other: Column) -> DataFrame:
    """A left join of rows with table by key; its columns but key and count, as the struct ``found``.

    table: one row of bounded size for each key, with the number of its rows, of
    ``total`` together. Rows of hot keys meet theirs by broadcast; in the shuffle of
    the others they go by ``other``, a value of the key's type, different from row
    to row, that is no key.
    """
    values = F.struct(*[F.col(f"`{c}`") for c in table.columns if c not in (key, count)])
    hot = F.col(count) > total // HOT
    large = table.where(hot).select(F.col(key), values.alias("_hot"))
    small = table.where(~hot).select(F.col(key).alias("_key"), values.alias("_cold"))
    held = rows.join(F.broadcast(large), key, "left")
    held = held.withColumn("_key", F.when(F.col("_hot").isNull(), F.col(key)).otherwise(other)).join(small, "_key", "left")
    return held.withColumn("found", F.coalesce("_hot", "_cold")).drop("_key", "_hot", "_cold")
