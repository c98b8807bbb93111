"""Substring dedup by a lookup of window hashes.

This stands in for relative Lempel-Ziv parsing: no reference is indexed and no
factor is extended to a longest match, because the result is defined by windows.
A word is a duplicate if a window of WINDOW words that covers it also stands in
a document with a smaller id. Windows found so that overlap or meet are merged.

Windows are looked up in two steps, so that most never travel:

1. Anchors. Of the nine five-word grams in a window the one with the smallest
   hash is its anchor; equal windows have equal anchors, neighbouring windows
   mostly share theirs. Blocks ask whether another document has the anchor.
2. Windows whose anchor is shared. Blocks ask whether a document with a smaller
   id than their own lowest one has the window.

Windows and anchors are known by 64-bit hashes of their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorlake.llm import blocks, scratch, words

_U = np.uint64
WINDOW = 13
ANCHOR = 5
_NULL_ID = np.iinfo(np.int64).min


class _Block:
    """The windows of a block: where each starts, its document and hashes."""

    def __init__(self, rows: pa.Table, text: str, key: str, window: int, anchor: int):
        self.parts = list(words.split(rows.column(text)))
        hashes = np.concatenate([np.zeros(0, dtype=_U), *(p.hashes() for p in self.parts)])
        counts = np.concatenate([np.zeros(0, dtype=np.int64), *(p.counts for p in self.parts)])
        ids = rows.column(key).cast(pa.int64()).fill_null(_NULL_ID).to_numpy()
        self.counts = counts
        self.offsets = np.concatenate(([0], np.cumsum(counts)))
        ends = np.repeat(self.offsets[1:], counts)
        self.at = np.flatnonzero(np.arange(len(hashes)) + window <= ends)
        self.doc = np.repeat(ids, counts)[self.at]
        every = words.grams(hashes, window, 5)
        self.windows = every[self.at]
        small = words.mix(words.grams(hashes, anchor, 9))
        lowest = small[: len(every)].copy()
        for k in range(1, window - anchor + 1):
            np.minimum(lowest, small[k : k + len(every)], out=lowest)
        self.anchors = lowest[self.at]


def _lowest(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, the key number of each place, and the lowest and highest document of each key."""
    order, number = blocks.groups(keys)
    first = np.flatnonzero(np.diff(number, prepend=-1))
    at = np.empty(len(keys), dtype=np.int64)
    at[order] = number
    if not len(keys):
        return keys, at, docs, docs
    return keys[order][first], at, np.minimum.reduceat(docs[order], first), np.maximum.reduceat(docs[order], first)


def _narrow(ids: np.ndarray) -> np.ndarray:
    """Ids as four bytes each where all fit."""
    return ids.astype(np.uint32) if len(ids) and ids.min() >= 0 and ids.max() < 1 << 32 else ids


def _wide(each: list[bytes], counts: np.ndarray) -> np.ndarray:
    kinds = [np.uint32 if len(b) == 4 * n else np.int64 for b, n in zip(each, counts, strict=True)]
    return np.concatenate([np.frombuffer(b, dtype=k).astype(np.int64) for b, k in zip(each, kinds, strict=True)])


def _shared(keys: np.ndarray, of: np.ndarray, beside: dict[str, list]) -> list[np.ndarray]:
    """For each key of each question, whether two documents or more have it."""
    counts = np.bincount(of, minlength=len(beside["many"]))
    many = np.concatenate([np.frombuffer(b, dtype=bool) for b in beside["many"]])
    order, number = blocks.groups(keys)
    total = np.bincount(number, weights=1 + many[order])
    hit = np.empty(len(keys), dtype=bool)
    hit[order] = total[number] > 1
    return np.split(hit, np.cumsum(counts)[:-1])


def _smaller(keys: np.ndarray, of: np.ndarray, beside: dict[str, list]) -> list[np.ndarray]:
    """For each key of each question, whether a smaller document than its own lowest one has it."""
    counts = np.bincount(of, minlength=len(beside["lowest"]))
    docs = _wide(beside["lowest"], counts)
    order, number = blocks.groups(keys)
    lowest = np.minimum.reduceat(docs[order], np.flatnonzero(np.diff(number, prepend=-1)))
    hit = np.empty(len(keys), dtype=bool)
    hit[order] = lowest[number] < docs[order]
    return np.split(hit, np.cumsum(counts)[:-1])


def factors(repeated: np.ndarray, at: np.ndarray, words_in_all: int, ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Duplicate spans as word ranges: the longest factors of repeated windows.

    repeated: for each window, whether the reference has it; at: the word it
    starts at; ends: where each window's document ends. Factors do not overlap:
    windows that overlap or meet in a document belong to one factor.
    """
    starts = at[repeated]
    if not len(starts):
        return starts, starts
    fresh = np.ones(len(starts), dtype=bool)
    fresh[1:] = (starts[1:] > starts[:-1] + window) | (ends[repeated][1:] != ends[repeated][:-1])
    last = np.append(np.flatnonzero(fresh)[1:] - 1, len(starts) - 1)
    return starts[fresh], starts[last] + window


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Removes words covered by a window that also starts in a document with a smaller id.

    Returns every row with its columns, the column text replaced by the kept
    words joined by one space, and n_words, n_removed (long), kept_sha256 and
    spans (array of start and end, in words). Windows are judged on the input.
    A null text has no words and stays null. A null id counts as smaller than
    all others; rows that repeat an id are parts of one document, of which none
    removes from another. Columns called like a result are replaced by it.
    """
    spark = docs.sparkSession
    path = scratch.folder(spark)
    names = [f for f in docs.schema.fields if f.name not in ("n_words", "n_removed", "kept_sha256", "spans")]
    packed = blocks.pack(docs.select(*[F.col(f"`{f.name}`") for f in names]), text, f"{path}/blocks")
    size = packed.agg(F.sum("size")).first()[0] or 0

    def anchors(rows: pa.Table) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        own = _Block(rows, text, key, window, anchor)
        keys, _, low, high = _lowest(own.anchors, own.doc)
        return keys, {"many": low < high}

    # words of six bytes, and an anchor for every fourth of them
    asked = blocks.questions(packed, blocks.shards_for(size // 24), anchors, ["many"])
    shared = scratch.save(blocks.gathered(blocks.answers(asked, _shared), "shared"), f"{path}/shared")
    known = packed.select("block", "blob").join(shared, "block", "left")

    def looked_up(own: _Block, parts: list[dict] | None) -> np.ndarray:
        _, at, _, _ = _lowest(own.anchors, own.doc)
        return blocks.joined(parts, bool)[at]

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob, parts in zip(batch.column("block").to_pylist(), batch.column("blob"), batch.column("shared").to_pylist(), strict=True):
                own = _Block(blocks.unpacked(blob.as_py()), text, key, window, anchor)
                chosen = looked_up(own, parts)
                keys, _, low, _ = _lowest(own.windows[chosen], own.doc[chosen])
                cuts = blocks.by_shard(keys, shards)
                used = np.flatnonzero(np.diff(cuts))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block] * len(used), pa.int64()),
                        pa.array(used, pa.int32()),
                        pa.array([keys[cuts[s] : cuts[s + 1]].tobytes() for s in used], pa.binary()),
                        pa.array([_narrow(low[cuts[s] : cuts[s + 1]]).tobytes() for s in used], pa.binary()),
                    ],
                    names=["block", "shard", "keys", "lowest"],
                )

    shards = blocks.shards_for(size // 12)
    asked = known.mapInArrow(windows, "block long, shard int, keys binary, lowest binary")
    smaller = scratch.save(blocks.gathered(blocks.answers(asked, _smaller), "smaller"), f"{path}/smaller")

    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType(
        [*names, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("spans", T.ArrayType(span))]
    )

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, first, second in zip(batch.column("blob"), batch.column("shared").to_pylist(), batch.column("smaller").to_pylist(), strict=True):
                rows = blocks.unpacked(blob.as_py())
                own = _Block(rows, text, key, window, anchor)
                chosen = looked_up(own, first)
                _, at, low, _ = _lowest(own.windows[chosen], own.doc[chosen])
                repeated = np.zeros(len(own.windows), dtype=bool)
                repeated[chosen] = blocks.joined(second, bool)[at] | (low[at] < own.doc[chosen])
                total = int(own.offsets[-1])
                starts, ends = factors(repeated, own.at, total, np.repeat(own.offsets[1:], own.counts)[own.at], window)
                edge = np.zeros(total + 1, dtype=np.int32)
                np.add.at(edge, starts, 1)
                np.add.at(edge, ends, -1)
                keep = np.cumsum(edge[:-1]) == 0
                yield from _result(rows, own, keep, starts, ends, text).to_batches()

    whole = known.join(smaller, "block", "left").select("blob", "shared", "smaller")
    return whole.mapInArrow(parse, schema)


def _result(rows: pa.Table, own: _Block, keep: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: str) -> pa.Table:
    kept, digests, low = [], [], 0
    for part in own.parts:
        high = low + len(part.starts)
        chosen = keep[low:high]
        begun, stopped = part.starts[chosen], part.ends[chosen]
        left = np.concatenate(([0], np.cumsum(chosen)))[part.offsets]
        data = part.data.tobytes()
        for a, b in zip(left[:-1].tolist(), left[1:].tolist(), strict=True):
            joined = b" ".join([data[x:y] for x, y in zip(begun[a:b].tolist(), stopped[a:b].tolist(), strict=True)])
            kept.append(joined)
            digests.append(hashlib.sha256(joined).hexdigest())
        low = high
    removed = own.counts - np.diff(np.concatenate(([0], np.cumsum(keep)))[own.offsets])
    doc = np.searchsorted(own.offsets, starts, side="right") - 1
    list_ends = np.searchsorted(doc, np.arange(len(own.counts) + 1))
    values = pa.StructArray.from_arrays([pa.array(starts - own.offsets[doc], pa.int64()), pa.array(ends - own.offsets[doc], pa.int64())], names=["start", "end"])
    texts = pa.array(kept, pa.large_binary()).cast(pa.large_string())
    given = rows.column(text)
    texts = pa.compute.if_else(given.is_valid(), texts, pa.scalar(None, pa.large_string()))
    place = rows.column_names.index(text)
    out = rows.set_column(place, text, texts.cast(rows.schema.field(text).type))
    for name, column in (
        ("n_words", pa.array(own.counts, pa.int64())),
        ("n_removed", pa.array(removed, pa.int64())),
        ("kept_sha256", pa.array(digests, pa.string())),
        ("spans", pa.ListArray.from_arrays(pa.array(list_ends, pa.int32()), values)),
    ):
        out = out.append_column(name, column)
    return out
