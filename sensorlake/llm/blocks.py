"""Questions from blocks of documents to shards of keys.

Documents are packed once into blocks of a few megabytes, written to the
shared folder. A block asks about its distinct 64-bit keys: one row for each
shard that holds some, with the keys as a sorted array. A shard sees the
question of every block, so it knows for each key who has it, and answers with
one array per block. The answers then meet the block again.

A key that a third of all rows hold is one key of a block, not one row of
each document; so neither the exchange nor a shard grows with copies inside
a block. Shards are ranges of hashes with about ``KEYS_PER_SHARD`` keys.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorlake.llm import scratch, words

BLOCK_BYTES = 4 << 20
BLOCK_ROWS = 8192
KEYS_PER_SHARD = 1_500_000

_U = np.uint64


def packed(batch: pa.RecordBatch) -> bytes:
    """Rows as one value."""
    out = io.BytesIO()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return out.getvalue()


def unpacked(blob: bytes) -> pa.Table:
    """The rows of a block."""
    return pa.ipc.open_stream(pa.py_buffer(blob)).read_all()


def pack(df: DataFrame, text: str, path: str) -> DataFrame:
    """The rows of df with all columns, in blocks, written to path and read again.

    Returns block (its number), docs, size (bytes of the column text) and blob.
    Block numbers and contents are fixed once written. An empty table has no block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            _, places = words.utf8(batch.column(text))
            for low, high in words.chunks(places, BLOCK_BYTES):
                for at in range(low, high, BLOCK_ROWS):
                    part = batch.slice(at, min(BLOCK_ROWS, high - at))
                    size = int(places[at + part.num_rows] - places[at])
                    yield pa.RecordBatch.from_pydict(
                        {"block": [number], "docs": [part.num_rows], "size": [size], "blob": [packed(part)]}
                    )
                    number += 1

    blocks = df.mapInArrow(run, "block long, docs long, size long, blob binary")
    return scratch.save(blocks, path)


def shards_for(keys: int) -> int:
    return max(1, -(-int(keys) // KEYS_PER_SHARD))


def by_shard(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's keys begin in the sorted keys, and the end."""
    cuts = [_U((k * (1 << 64)) // shards) for k in range(1, shards)]
    inner = np.searchsorted(keys, np.array(cuts, dtype=_U)) if cuts else np.zeros(0, dtype=np.int64)
    return np.concatenate(([0], inner, [len(keys)])).astype(np.int64)


def questions(
    blocks: DataFrame,
    shards: int,
    keys: Callable[[pa.Table], tuple[np.ndarray, dict[str, np.ndarray]]],
    columns: list[str],
) -> DataFrame:
    """One row per block and shard: block, shard, keys, and the named arrays beside them.

    keys: from the rows of a block, its keys sorted ascending and arrays as long.
    """
    schema = "block long, shard int, keys binary" + "".join(f", {c} binary" for c in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob in zip(batch.column("block").to_pylist(), batch.column("blob"), strict=True):
                sorted_keys, beside = keys(unpacked(blob.as_py()))
                cuts = by_shard(sorted_keys, shards)
                used = np.flatnonzero(np.diff(cuts))
                rows: dict[str, list] = {"block": [block] * len(used), "shard": used.astype(np.int32)}
                for name, array in {"keys": sorted_keys, **{c: beside[c] for c in columns}}.items():
                    rows[name] = [array[cuts[s] : cuts[s + 1]].tobytes() for s in used]
                fields = [("block", pa.int64()), ("shard", pa.int32())] + [(c, pa.binary()) for c in ["keys", *columns]]
                yield pa.RecordBatch.from_pydict(rows, schema=pa.schema(fields))

    return blocks.select("block", "blob").mapInArrow(run, schema)


def answers(asked: DataFrame, answer: Callable[[np.ndarray, np.ndarray, dict[str, list]], list[np.ndarray]]) -> DataFrame:
    """One row per question: block, shard, bits.

    answer: from all keys of a shard, the number of the question each belongs
    to, and the questions' other columns as lists, one array per question.
    """

    def run(table: pa.Table) -> pa.Table:
        each = [np.frombuffer(b.as_py(), dtype=_U) for b in table.column("keys")]
        of = np.repeat(np.arange(len(each)), [len(k) for k in each])
        rest = {c: [v.as_py() for v in table.column(c)] for c in table.column_names if c not in ("block", "shard", "keys")}
        found = answer(np.concatenate(each), of, rest)
        return pa.table(
            {"block": table.column("block"), "shard": table.column("shard"), "bits": pa.array([a.tobytes() for a in found], pa.binary())}
        )

    return asked.groupBy("shard").applyInArrow(run, "block long, shard int, bits binary")


def gathered(answered: DataFrame, name: str) -> DataFrame:
    """One row per block: its answers by shard, in the column name."""
    return answered.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("shard", "bits"))).alias(name))


def joined(parts: list[dict] | None, kind: type) -> np.ndarray:
    """The answers of a block in the order of its keys."""
    return np.concatenate([np.frombuffer(p["bits"], dtype=kind) for p in parts]) if parts else np.zeros(0, dtype=kind)


def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts the keys, and for each sorted place the number of its key."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return order, np.cumsum(new) - 1
