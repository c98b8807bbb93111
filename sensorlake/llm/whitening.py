"""Embedding whitening by weighted multiplicity covariance.

Vectors become vectors of whole numbers, x = floor(scale * c) + shift. Equal
ones are grouped, with a map-side combine, and stored once with their count; all
further passes read the distinct vectors only. Counts (or ones) are the weights
of the fit: sums are exact integers, the covariance is a weighted GEMM of
centred vectors, one matrix a partition, summed in two steps. Its eigenvectors
are found in the driver, which holds one matrix of dimension squared. Every
distinct vector is whitened once and stored; rows then get their result by a
join on a 128-bit hash of x. Groups of more than one row in ``HOT`` are fewer
than ``HOT``, so they are broadcast; no other group is large in its task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorlake.llm import scratch

SCALE = 1024
SHIFT = 100_000
COMPONENTS = 8
#: A group with more than one row in so many is joined by broadcast.
HOT = 1000
#: Matrices that are added in one task, before the sums of such tasks.
FAN_IN = 64
#: Eigenvalues below this share of the largest are zero to rounding; no component goes with them.
LEAST = 1e-12
#: Vectors that a task works on at a time.
ROWS = 4096
#: Scaled entries from here on would not be whole numbers of 64 bits.
_TOO_LARGE = float(1 << 62)
RESULTS = ("n", "deviation", "whitened", "explained", "identity_error")


def whole(vector: Column, scale: int = SCALE, shift: int = SHIFT) -> Column:
    """floor(scale * entry) + shift of every entry as double, as long; null if the vector is not usable.

    That is a null vector, one without entries, or one with an entry that is
    null, not finite, or too large for a whole number of 64 bits.
    """
    scaled = F.transform(vector, lambda c: c.cast("double") * F.lit(float(scale)))
    usable = (F.size(vector) > 0) & F.forall(scaled, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < _TOO_LARGE))
    return F.when(usable, F.transform(scaled, lambda c: F.floor(c).cast("long") + F.lit(shift).cast("long")))


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of the batches with their vectors as a matrix and their weights."""
    for batch in batches:
        for low in range(0, batch.num_rows, ROWS):
            part = batch.slice(low, ROWS)
            flat = part.column("x").flatten().to_numpy(zero_copy_only=False)
            yield part, flat.reshape(part.num_rows, -1), part.column("weight").to_numpy(zero_copy_only=False)


def _fits(x: np.ndarray, factor: int) -> bool:
    """Whether factor times the sum of the absolute values is surely below 2^63."""
    return float(np.abs(x.astype(np.float64)).sum()) * factor < float(1 << 62)


def sums(distinct: DataFrame) -> tuple[int, list[int]]:
    """The sum of the weights, and exact weighted sums by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for _, x, weight in _matrices(batches):
            kind = np.int64 if _fits(x, int(weight.max())) else object
            part = (x.astype(kind) * weight.astype(kind)[:, None]).sum(axis=0).astype(object)
            total = part if total is None else total + part
            n += int(weight.sum())
        if total is not None:
            dims = np.arange(-1, len(total), dtype=np.int32)
            yield pa.RecordBatch.from_pydict({"dim": dims, "total": [str(n), *map(str, total)]})

    each = distinct.select("x", "weight").mapInArrow(run, "dim int, total string")
    found = dict(each.groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)"))).collect())
    return int(found.get(-1, 0)), [int(found[d]) for d in range(len(found) - 1)]


def _centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """x less the mean; whole parts are taken off before rounding."""
    floor = np.array([s // n for s in total], dtype=np.int64)
    rest = np.array([(s % n) / n for s in total])
    return (x - floor).astype(np.float64) - rest


def covariance(vectors: DataFrame, n: int, centre) -> np.ndarray:
    """The weighted covariance, divisor n, of vectors that ``centre`` has taken the mean from.

    vectors: x and weight. The matrices of the partitions are summed by Spark,
    ``FAN_IN`` at a time, then over these; only one matrix reaches the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square = first = None
        for _, x, weight in _matrices(batches):
            z = centre(x)
            part, moment = (z * weight[:, None]).T @ z, weight @ z
            square, first = (part, moment) if square is None else (square + part, first + moment)
        if square is not None:
            rows = np.vstack((square, first))
            number = np.full(len(rows), TaskContext.get().partitionId(), dtype=np.int32)
            yield pa.RecordBatch.from_pydict({"part": number, "row": np.arange(len(rows), dtype=np.int32), "cells": list(rows)})

    def add(table: pa.Table) -> pa.Table:
        cells = np.array(table.column("cells").to_pylist()).sum(axis=0)
        return table.slice(0, 1).set_column(2, "cells", pa.array([cells]))

    schema = "part int, row int, cells array<double>"
    found = vectors.mapInArrow(run, schema).withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int"))
    found = found.groupBy("part", "row").applyInArrow(add, schema).withColumn("part", F.lit(0))
    rows = {r["row"]: r["cells"] for r in found.groupBy("part", "row").applyInArrow(add, schema).collect()}
    matrix = np.array([rows[k] for k in range(len(rows))])
    off = matrix[-1] / n  # zero but for rounding
    return matrix[:-1] / n - np.outer(off, off)


def eigen(matrix: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and unit eigenvectors as columns; the largest entry of each is positive."""
    values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > max(LEAST * values.max(initial=0.0), 0.0)]
    values, vectors = values[order], vectors[:, order]
    signs = np.sign(vectors[np.argmax(np.abs(vectors), axis=0), np.arange(len(order))])
    return values, vectors * signs


def _deviations(x: np.ndarray, n: int, total: list[int]) -> list[int | None]:
    """The sum of (n * x - total)^2 of each vector, exact; None beyond 64 bits."""
    low = max(int(np.abs(x).max(initial=0)), max(abs(s) // n + 1 for s in total)) * n
    if 4 * low * low * x.shape[1] < 1 << 62:
        off = x * n - np.array(total, dtype=np.int64)
        return (off * off).sum(axis=1).tolist()
    spread = float(np.abs(x - np.array([s // n for s in total], dtype=np.int64)).max(initial=0) + 1) * n
    if low < 1 << 62 and spread * spread * x.shape[1] < float(1 << 62):
        off = x * n - np.array(total, dtype=np.int64)
        return (off * off).sum(axis=1).tolist()
    exact = ((x.astype(object) * n - np.array(total, dtype=object)) ** 2).sum(axis=1)
    return [int(v) if v < 1 << 63 else None for v in exact]


def whiten(
    rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS,
    weighted: bool = True, scale: int = SCALE, shift: int = SHIFT,
) -> DataFrame:
    """Every usable row with its columns, whitened over all of them.

    Adds n (sum of the weights), deviation (the sum over dimensions of (n * x -
    S)^2, S the weighted sum of x; null beyond 64 bits), both long; whitened and
    explained (arrays of double, one entry a component: the centred x on the unit
    eigenvector over the root of its eigenvalue, and the eigenvalue over the
    trace); identity_error (the largest absolute entry of the covariance of
    whitened less the identity). Components fall by eigenvalue, ``components``
    at most; there are none for eigenvalues that are zero to rounding, so arrays
    are empty where all vectors are equal, and identity_error is then 0.

    weighted: equal vectors count as often as they are found; else once. Rows
    whose vector is null, empty, or has an entry that is null, not finite or of
    2^62 and more when scaled, go; so do vectors of another length than the
    commonest (of equally common ones the longest). Repeated rows each stay.
    Columns of the input that are called like a result are replaced by it.
    """
    spark, path = rows.sparkSession, scratch.folder(rows.sparkSession)
    own = [F.col(f"`{c}`") for c in rows.columns if c not in RESULTS]
    keyed = rows.select(F.struct(*own).alias("row"), whole(F.col(f"`{vector}`"), scale, shift).alias("x")).where(F.col("x").isNotNull())
    groups = scratch.save(keyed.groupBy("x").agg(F.count("*").alias("rows")), f"{path}/groups")
    lengths = groups.groupBy(F.size("x").alias("length")).agg(F.sum("rows").alias("rows"))
    common = lengths.orderBy(F.desc("rows"), F.desc("length")).first()
    if common is None:
        empty = "n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
        none = spark.createDataFrame([], empty)
        return rows.select(*own).where("false").join(none)
    distinct = groups.where(F.size("x") == common["length"])
    distinct = distinct.select("x", "rows", (F.col("rows") if weighted else F.lit(1).cast("long")).alias("weight"))
    n, total = sums(distinct)

    matrix = covariance(distinct.select("x", "weight"), n, lambda x: _centred(x, n, total))
    values, vectors = eigen(matrix, components)
    onto = vectors / np.sqrt(values)
    explained = (values / np.trace(matrix)).tolist() if len(values) else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x, _ in _matrices(batches):
            arrays = [pa.array(_deviations(x, n, total), pa.int64()), pa.array(list(_centred(x, n, total) @ onto), pa.list_(pa.float64()))]
            names = ["one", "two", "rows", "weight"]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *arrays], names=[*names, "deviation", "whitened"])

    one, two = F.xxhash64("x"), F.xxhash64(F.lit(1), "x")
    schema = "one long, two long, rows long, weight long, deviation long, whitened array<double>"
    each = distinct.select("x", one.alias("one"), two.alias("two"), "rows", "weight").mapInArrow(run, schema)
    each = scratch.save(each, f"{path}/whitened")
    error = 0.0
    if len(values):
        unit = covariance(each.select(F.col("whitened").alias("x"), "weight"), n, lambda z: z)
        error = float(np.abs(unit - np.eye(len(values))).max())

    keyed = keyed.where(F.size("x") == common["length"]).select("row", one.alias("one"), two.alias("two"))
    # more than this many rows: fewer than HOT groups, as they share all rows
    hot = F.col("rows") > common["rows"] // HOT
    large = F.broadcast(each.where(hot).select("one", "two", "deviation", "whitened"))
    small = each.where(~hot).select("one", "two", "deviation", "whitened")
    done = keyed.join(large, ["one", "two"]).unionByName(
        keyed.join(large.select("one", "two"), ["one", "two"], "left_anti").join(small, ["one", "two"])
    )
    return done.select(
        "row.*",
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.lit(explained).cast("array<double>").alias("explained"),
        F.lit(error).alias("identity_error"),
    )
