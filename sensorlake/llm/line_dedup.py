"""Line dedup over a sharded minimal perfect hash.

Every distinct line key of the corpus gets a slot of a minimal perfect hash.
Two arrays stand beside it: a 32-bit fingerprint and the number of documents
that hold the key. The hash is built shard by shard, a shard being a range of
key hashes, so no step holds the keys of the whole corpus. Documents never
join lines: a block of documents sends the distinct hashes of its lines to the
shards, which probe the arrays and send one bit back per key.

Lines are known by a 64-bit hash and a 32-bit fingerprint from the same
128-bit hash; two different lines that agree in both would count as one.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorlake.llm import blocks, scratch
from sensorlake.llm.words import mix

_U = np.uint64
_STRIPPED = b" \t\n\x0b\x0c\r"
#: Slots of a level for each key that it gets.
GAMMA = 2


def line_key(line: bytes) -> bytes:
    """The line without white space at its ends, A-Z as a-z, in UTF-8."""
    return line.strip(_STRIPPED).lower()


def _lines(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split(b"\n")


def _counts(key: bytes, min_chars: int) -> bool:
    """Whether the key has min_chars code points or more."""
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode("utf-8", "surrogatepass")) >= min_chars)


def _names(lines: list[bytes], min_chars: int) -> list[bytes | None]:
    """Hash and fingerprint of each line's key, twelve bytes; None for a key that is too short."""
    digest = xxhash.xxh3_128_digest
    return [digest(key)[:12] if _counts(key, min_chars) else None for key in map(line_key, lines)]


def build(keys: np.ndarray) -> list[np.ndarray]:
    """Levels of a minimal perfect hash of distinct keys: in each, the bits of slots that exactly one key took."""
    levels, left, level = [], keys, 0
    while len(left):
        size = max(64, GAMMA * len(left))
        slot = (mix(left + _U(level + 1)) % _U(size)).astype(np.int64)
        alone = np.bincount(slot, minlength=size) == 1
        levels.append(alone)
        left = left[~alone[slot]]
        level += 1
    return levels


def slots(levels: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The slot of each key, 0 to n - 1; -1 or another key's slot for a key outside."""
    out = np.full(len(keys), -1, dtype=np.int64)
    left, base = np.arange(len(keys)), 0
    for level, alone in enumerate(levels):
        slot = (mix(keys[left] + _U(level + 1)) % _U(len(alone))).astype(np.int64)
        hit = alone[slot]
        out[left[hit]] = base + np.cumsum(alone)[slot[hit]] - 1
        base += int(alone.sum())
        left = left[~hit]
    return out


def _keys(names: list[list[bytes | None]]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Of a block's lines by document: distinct hashes in order, with fingerprints and documents."""
    docs: Counter[bytes] = Counter()
    for own in names:
        docs.update(set(own))
    del docs[None]
    parts = np.frombuffer(b"".join(docs), dtype=[("hash", "<u8"), ("print", "<u4")])
    order = np.argsort(parts["hash"], kind="stable")
    counts = np.fromiter(docs.values(), dtype=np.uint32, count=len(docs))
    return parts["hash"][order], {"prints": parts["print"][order], "counts": counts[order]}


def _folded(keys: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Hash and fingerprint in one 64-bit value, by which slots are found."""
    return mix(keys ^ mix(prints.astype(_U)))


def index(asked: DataFrame) -> DataFrame:
    """One row per shard: levels (bits of the perfect hash), sizes, prints and counts by slot."""

    def run(table: pa.Table) -> pa.Table:
        def whole(name: str, kind: type) -> np.ndarray:
            return np.concatenate([np.frombuffer(b.as_py(), dtype=kind) for b in table.column(name)])

        prints, counts = whole("prints", np.uint32), whole("counts", np.uint32)
        folded, first, at = np.unique(_folded(whole("keys", _U), prints), return_index=True, return_inverse=True)
        totals = np.bincount(at, weights=counts).astype(np.uint64)
        levels = build(folded)
        slot = slots(levels, folded)
        by_slot = np.empty(len(folded), dtype=np.uint32)
        by_slot[slot] = prints[first]
        docs = np.empty(len(folded), dtype=np.uint32)
        docs[slot] = np.minimum(totals, 0xFFFFFFFF)
        return pa.table(
            {
                "shard": table.column("shard").slice(0, 1),
                "sizes": pa.array([[len(x) for x in levels]], pa.list_(pa.int64())),
                "levels": pa.array([b"".join(np.packbits(x).tobytes() for x in levels)], pa.binary()),
                "prints": pa.array([by_slot.tobytes()], pa.binary()),
                "counts": pa.array([docs.tobytes()], pa.binary()),
            }
        )

    return asked.groupBy("shard").applyInArrow(
        run, "shard int, sizes array<long>, levels binary, prints binary, counts binary"
    )


def opened(sizes: list[int], packed: bytes) -> list[np.ndarray]:
    """The levels of a stored index."""
    out, at = [], 0
    for size in sizes:
        length = -(-size // 8)
        bits = np.frombuffer(packed, dtype=np.uint8, count=length, offset=at)
        out.append(np.unpackbits(bits, count=size).astype(bool))
        at += length
    return out


def probe(asked: DataFrame, stored: DataFrame, min_docs: int) -> DataFrame:
    """One bit per key of a question: whether the index has it, in min_docs documents or more."""
    both = asked.select("shard", "block", "keys", "prints").withColumn("kind", F.lit(1)).unionByName(
        stored.select("shard", "sizes", "levels", F.col("prints").alias("slot_prints"), "counts").withColumn("kind", F.lit(0)),
        allowMissingColumns=True,
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels: list[np.ndarray] = []
        prints = counts = np.zeros(0, dtype=np.uint32)
        for batch in batches:
            out = {"block": [], "shard": [], "bits": []}
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    levels = opened(row["sizes"], row["levels"])
                    prints = np.frombuffer(row["slot_prints"], dtype=np.uint32)
                    counts = np.frombuffer(row["counts"], dtype=np.uint32)
                    continue
                own = np.frombuffer(row["prints"], dtype=np.uint32)
                at = slots(levels, _folded(np.frombuffer(row["keys"], dtype=_U), own))
                hit = (at >= 0) & (prints[at] == own) & (counts[at] >= min_docs)
                out["block"].append(row["block"])
                out["shard"].append(row["shard"])
                out["bits"].append(hit.tobytes())
            fields = [("block", pa.int64()), ("shard", pa.int32()), ("bits", pa.binary())]
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema(fields))

    by_shard = both.repartition("shard").sortWithinPartitions("shard", "kind")
    return by_shard.mapInArrow(run, "block long, shard int, bits binary")


def dedup(docs: DataFrame, text: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Drops the lines whose key is found in min_docs rows or more.

    Returns every row with its columns, the column text cleaned, and n_lines,
    n_dropped (long) and kept_sha256. A null or empty text is one empty line;
    a null text stays null if nothing is kept of it. A row counts once for a
    key, however often it holds it; a repeated row counts for itself. Columns
    of the input that are called like a result are replaced by it.
    """
    spark, path = docs.sparkSession, scratch.folder(docs.sparkSession)
    names = [f for f in docs.schema.fields if f.name not in ("n_lines", "n_dropped", "kept_sha256")]
    docs = docs.select(*[F.col(f"`{f.name}`") for f in names])
    packed = blocks.pack(docs, text, f"{path}/blocks")

    def keys(rows: pa.Table) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        return _keys([_names(_lines(value), min_chars) for value in rows.column(text).to_pylist()])

    asked = scratch.save(blocks.questions(packed, _shards(packed), keys, ["prints", "counts"]), f"{path}/asked")
    stored = scratch.save(index(asked), f"{path}/index")
    told = scratch.save(blocks.gathered(probe(asked, stored, min_docs), "told"), f"{path}/told")
    scratch.drop(spark, f"{path}/asked")

    schema = T.StructType([*names, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, parts in zip(batch.column("blob"), batch.column("told").to_pylist(), strict=True):
                rows = blocks.unpacked(blob.as_py())
                every = [_lines(value) for value in rows.column(text).to_pylist()]
                names = [_names(lines, min_chars) for lines in every]
                sorted_keys, beside = _keys(names)
                hit = blocks.joined(parts, bool)
                found = np.empty(int(hit.sum()), dtype=[("hash", "<u8"), ("print", "<u4")])
                found["hash"], found["print"] = sorted_keys[hit], beside["prints"][hit]
                packed_names = found.tobytes()
                dropped = {packed_names[k : k + 12] for k in range(0, len(packed_names), 12)}
                kept = [[x for x, name in zip(lines, own, strict=True) if name not in dropped] for lines, own in zip(every, names, strict=True)]
                lost = [len(lines) - len(left) for lines, left in zip(every, kept, strict=True)]
                texts = [b"\n".join(left) for left in kept]
                digests = [hashlib.sha256(x).hexdigest() for x in texts]
                cleaned = pa.array(texts, pa.large_binary()).cast(pa.large_string())
                cleaned = pc.if_else(rows.column(text).is_valid(), cleaned, pa.scalar(None, pa.large_string()))
                place = rows.column_names.index(text)
                out = rows.set_column(place, text, cleaned.cast(rows.schema.field(text).type))
                for name, values, kind in (("n_lines", list(map(len, every)), pa.int64()), ("n_dropped", lost, pa.int64()), ("kept_sha256", digests, pa.string())):
                    out = out.append_column(name, pa.array(values, kind))
                yield from out.to_batches()

    return packed.select("block", "blob").join(told, "block", "left").select("blob", "told").mapInArrow(run, schema)


def _shards(packed: DataFrame) -> int:
    """Shards by the bytes of text, at forty bytes a line."""
    size = packed.agg(F.sum("size")).first()[0] or 0
    return blocks.shards_for(size // 40)
