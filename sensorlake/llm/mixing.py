"""Mixing sources to target weights.

Tokens are summed per source, weights become targets, a target over a source's
tokens is its repetition rate, and each document is taken floor(rate) times plus
once more with the probability that is left, by a hash of the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sensorlake.llm import scratch

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix-1"
#: The table of sources is broadcast up to this size.
BROADCAST_BYTES = 32 << 20
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """The number of words of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(seed: str, *columns: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the columns alone."""
    named = F.concat_ws("|", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """For rows (source, source_size): target beside them.

    Sources by code point, null last, get the weights in turn and share the sum
    of all sizes. A target stops at cap times its source's size; what is over is
    shared anew by weight among the others. Sorted by size over weight, the
    sources that stop come first, so running sums find the level of the rest.
    The windows run over one row per source, not over documents.
    """
    by_name = W.orderBy(F.col("source").isNull(), "source")
    by_room = W.orderBy(F.col("source_size") / F.col("weight"), "rank")
    before = by_room.rowsBetween(W.unboundedPreceding, -1)
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    turn = F.array(*[F.lit(w) for w in weights])
    ranked = ranked.withColumn("weight", F.element_at(turn, (F.col("rank") % len(weights) + 1).cast("int")))
    every = W.partitionBy()
    left = F.sum("source_size").over(every) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    share = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = ranked.withColumn("level", left.cast("double") / share.cast("double"))
    level = level.withColumn("stops", F.col("source_size") * cap <= F.col("level") * F.col("weight"))
    rest = F.min(F.when(~F.col("stops"), F.struct(F.col("source_size") / F.col("weight"), "rank", "level"))).over(every)
    first = level.withColumn("rest", rest)
    open_ = F.col("rest").isNotNull() & (
        (F.col("source_size") / F.col("weight") > F.col("rest.col1"))
        | ((F.col("source_size") / F.col("weight") == F.col("rest.col1")) & (F.col("rank") >= F.col("rest.rank")))
    )
    target = F.when(open_, F.col("rest.level") * F.col("weight")).otherwise((F.col("source_size") * cap).cast("double"))
    return first.select("source", "source_size", target.alias("target"))


def rates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED,
) -> DataFrame:
    """Every row with its columns and size, source_size, target, copies.

    size: words of the text; copies: how often the mix takes the row. A row's draw
    depends on seed, key and text, so reruns agree and repeated rows are drawn
    alike. Rows without words have size 0; a source without words has target 0.
    Null is a source of its own. Columns called like a result are replaced by it.
    """
    own = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies")]
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"))
    held = held.select("row", F.col(f"row.`{source}`").alias("source"), size_of(F.col(f"row.`{text}`")).alias("size"))
    sums = held.groupBy("source").agg(F.sum("size").alias("source_size"))
    table = scratch.save(targets(sums, weights, cap).withColumnRenamed("source", "name"), f"{scratch.folder(docs.sparkSession)}/targets")
    # a row of a source goes nowhere as long as the table of sources fits everywhere
    size = table.agg(F.sum(F.coalesce(F.octet_length("name"), F.lit(0)) + 64)).first()[0] or 0
    both = held.join(F.broadcast(table) if size <= BROADCAST_BYTES else table, F.col("source").eqNullSafe(F.col("name")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    both = both.withColumn("rate", rate)
    extra = draw(seed, F.col(f"row.`{key}`"), F.col(f"row.`{text}`")) < F.col("rate") - F.floor("rate")
    copies = F.floor("rate") + F.when(extra, 1).otherwise(0)
    return both.select("row.*", "size", "source_size", "target", copies.cast("long").alias("copies"))


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The mix: every row as often as it is taken, with the columns of docs."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_whole")
    taken = rates(docs.select(whole, *_needed(docs, settings)), **settings)
    copies = F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))
    return taken.select("_whole", copies.alias("_copy")).select("_whole.*")


def _needed(docs: DataFrame, settings: dict) -> list[Column]:
    names = {settings.get(k, v) for k, v in (("key", "doc_id"), ("text", "text"), ("source", "source"))}
    return [F.col(f"`{c}`") for c in docs.columns if c in names]
