"""Exact dedup over an extendible-hash index on shared files.

Texts are equal if they are identical without the characters of ``SPACE``. The
key of a text is a 64-bit hash of what is left; buckets are ranges of keys, as a
directory of 2^depth pointers by the first bits of a key tells. The directory
begins with one bucket; an overfull bucket splits on its next bit, and the
directory doubles where that bit is deeper than its depth. Splits are decided on
counts by key prefix that Spark sums, so the driver holds the directory, of at
most 2^MAX_DEPTH pointers, and never a key.

Documents are packed into blocks. Equal texts of a block are one entry, known by
comparing their bytes, so copies inside a block never leave it.

1. A block sends the keys of its entries to the owners of the buckets, which say
   what keys more than one entry has. Other entries are single for certain, and
   their texts are never sent.
2. With the bytes of the contested texts, buckets split further. Blocks send
   contested entries, texts included, to the owners; an owner chains the entries
   of a key and compares bytes, so texts that collide in the hash part. A bucket
   that no split can relieve, as one text has so many entries, is dealt to
   several owners by block; each leaves one entry for each text of its own, and
   one owner compares these.
3. The answers, the row that stays and the size of the group, meet the block again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorlake.llm import blocks, scratch

SPACE = b" \t\n\x0b\x0c\r"
MAX_DEPTH = 20
#: What a bucket holds at most: keys, and bytes of contested entries; more where 2^MAX_DEPTH buckets would not do.
BUCKET_KEYS = 1 << 16
BUCKET_BYTES = 8 << 20
#: Bytes that an entry takes beside its text.
ENTRY_BYTES = 64

_U = np.uint64
RESULTS = T.StructType(
    [
        T.StructField("keep_id", T.LongType()),
        T.StructField("group_size", T.LongType()),
        T.StructField("kept", T.BooleanType()),
        T.StructField("text_sha256", T.StringType()),
    ]
)


def text_key(normalised: bytes) -> int:
    """The 64-bit key of a text."""
    return xxhash.xxh3_64_intdigest(normalised)


@dataclass(frozen=True)
class Directory:
    """Pointers by the first ``depth`` bits of a key to buckets, numbered by key range."""

    depth: int
    buckets: np.ndarray

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The bucket of each key."""
        return self.buckets[_prefixes(keys, self.depth)]


def _prefixes(keys: np.ndarray, depth: int) -> np.ndarray:
    return (keys >> _U(64 - depth)).astype(np.int64) if depth else np.zeros(len(keys), dtype=np.int64)


def prefix_depth(total: int, capacity: int) -> int:
    """Bits at which evenly spread keys leave buckets an eighth full."""
    return min(MAX_DEPTH, max(0, (max(1, -(-total // capacity)) - 1).bit_length() + 3))


def grown(weights: np.ndarray, capacity: int, least: Directory | None = None) -> tuple[Directory, np.ndarray]:
    """The directory whose buckets hold ``capacity`` at most, where a split can do it, and their weights.

    weights: what each of the 2^h key prefixes holds. least: a directory whose
    buckets are split already, of a depth of h at most.
    """
    finest = len(weights).bit_length() - 1
    running = np.concatenate(([0], np.cumsum(weights)))
    local = np.zeros(1, dtype=np.int64)  # depth of the bucket that each pointer leads to
    depth, parted = 0, least.depth if least else 0
    while depth < finest:
        step = 1 << (finest - depth)
        pointers = np.arange(1 << depth)
        held = running[(pointers + 1) * step] - running[pointers * step]
        split = held > capacity
        if depth < parted:  # a pointer of the older directory that leads on to several buckets
            own = least.buckets.reshape(1 << depth, -1)
            split |= own[:, 0] != own[:, -1]
        split &= local == depth
        if not split.any():
            break
        local = np.repeat(local + split, 2)  # the directory doubles; halves of a split bucket are one deeper
        depth += 1
    pointers = np.arange(1 << depth)
    begins = (pointers & ((1 << (depth - local)) - 1)) == 0
    buckets = np.cumsum(begins) - 1
    cuts = np.append(pointers[begins], 1 << depth) << (finest - depth)
    return Directory(depth, buckets.astype(np.int32)), running[cuts[1:]] - running[cuts[:-1]]


@dataclass
class Entries:
    """The distinct texts of a block by key, then text.

    of_row: the entry of each row; rows: how many an entry has; best, chars, ids,
    known: the row of it that would stay, its code points, its id, and whether it has one.
    """

    keys: np.ndarray
    texts: list[bytes]
    of_row: np.ndarray
    rows: np.ndarray
    best: np.ndarray
    chars: np.ndarray
    ids: np.ndarray
    known: np.ndarray


def _ranked(groups: np.ndarray, chars: np.ndarray, known: np.ndarray, ids: np.ndarray, *places: np.ndarray) -> np.ndarray:
    """Order by group, then by who stays: most code points, smallest id (null last), first place."""
    return np.lexsort((*reversed(places), np.where(known, ids, 0), ~known, -chars, groups))


def entries(table: pa.Table, text: str, key: str, hashed: Callable[[bytes], int]) -> Entries:
    column = table.column(text)
    bodies = [(b or b"").translate(None, SPACE) for b in column.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()]
    found = {body: hashed(body) for body in dict.fromkeys(bodies)}
    texts = sorted(found, key=lambda body: (found[body], body))
    number = {body: k for k, body in enumerate(texts)}
    of_row = np.fromiter((number[body] for body in bodies), dtype=np.int64, count=len(bodies))
    chars = pc.fill_null(pc.utf8_length(column), 0).to_numpy().astype(np.int64)
    ids = table.column(key).cast(pa.int64())
    known = ids.is_valid().to_numpy()
    ids = pc.fill_null(ids, 0).to_numpy()
    order = _ranked(of_row, chars, known, ids, np.arange(len(bodies)))
    best = order[np.searchsorted(of_row[order], np.arange(len(texts)))]
    keys = np.fromiter((found[body] for body in texts), dtype=_U, count=len(texts))
    return Entries(keys, texts, of_row, np.bincount(of_row, minlength=len(texts)), best, chars[best], ids[best], known[best])


def _by_bucket(buckets: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal buckets."""
    cuts = np.concatenate((np.flatnonzero(np.diff(buckets, prepend=-1)), [len(buckets)]))
    for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield int(buckets[low]), slice(low, high)


def _bins(df: DataFrame, depth: int) -> np.ndarray:
    """Weights by key prefix, from rows (prefix, weight); at most 2^MAX_DEPTH of them reach the driver."""
    out = np.zeros(1 << depth, dtype=np.int64)
    found = df.groupBy("prefix").agg(F.sum("weight").alias("weight")).toArrow()
    out[found.column("prefix").to_numpy()] = found.column("weight").to_numpy()
    return out


def contested(asked: DataFrame, directory: Directory, depth: int) -> DataFrame:
    """What keys have several entries: rows (block, bucket, bits), and rows with prefixes and weights of these.

    asked: block, keys and sizes of its entries, by key.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, sizes = np.frombuffer(row["keys"], dtype=_U), np.frombuffer(row["sizes"], dtype=np.int64)
                parts = list(_by_bucket(directory.of(keys)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["block"]] * len(parts), pa.int64()),
                        pa.array([bucket for bucket, _ in parts], pa.int32()),
                        pa.array([keys[at].tobytes() for _, at in parts], pa.binary()),
                        pa.array([sizes[at].tobytes() for _, at in parts], pa.binary()),
                    ],
                    names=["block", "bucket", "keys", "sizes"],
                )

    def owner(table: pa.Table) -> pa.Table:
        each = [np.frombuffer(b.as_py(), dtype=_U) for b in table.column("keys")]
        keys = np.concatenate(each)
        sizes = np.concatenate([np.frombuffer(b.as_py(), dtype=np.int64) for b in table.column("sizes")])
        _, of_key, count = np.unique(keys, return_inverse=True, return_counts=True)
        several = (count > 1)[of_key]
        cuts = np.cumsum([len(k) for k in each])[:-1]
        bits = [np.packbits(part).tobytes() for part in np.split(several, cuts)]
        prefix, at = np.unique(_prefixes(keys[several], depth), return_inverse=True)
        weights = np.bincount(at, weights=sizes[several] + ENTRY_BYTES, minlength=len(prefix)).astype(np.int64)
        n = table.num_rows
        return pa.table(
            {
                "block": pa.concat_arrays([*table.column("block").chunks, pa.nulls(1, pa.int64())]),
                "bucket": pa.array([*table.column("bucket").to_pylist(), None], pa.int32()),
                "bits": pa.array([*bits, None], pa.binary()),
                "prefixes": pa.array([*[None] * n, prefix.tolist()], pa.list_(pa.int64())),
                "weights": pa.array([*[None] * n, weights.tolist()], pa.list_(pa.int64())),
            }
        )

    dealt = asked.mapInArrow(deal, "block long, bucket int, keys binary, sizes binary")
    return dealt.groupBy("bucket").applyInArrow(owner, "block long, bucket int, bits binary, prefixes array<long>, weights array<long>")


_ENTRY = "keys binary, rows binary, chars binary, ids binary, known binary, places binary, lengths binary, texts binary"
_KINDS = {"keys": _U, "rows": np.int64, "chars": np.int64, "ids": np.int64, "known": bool, "places": np.int64, "lengths": np.int64}


def _written(arrays: dict[str, np.ndarray], texts: list[bytes]) -> dict[str, bytes]:
    out = {name: np.ascontiguousarray(arrays[name], dtype=kind).tobytes() for name, kind in _KINDS.items() if name != "lengths"}
    return out | {"lengths": np.array([len(t) for t in texts], dtype=np.int64).tobytes(), "texts": b"".join(texts)}


def _read(table: pa.Table) -> tuple[dict[str, np.ndarray], list[bytes], list[int]]:
    """The entries of all rows, their texts, and how many each row has."""
    arrays = {
        name: np.concatenate([np.frombuffer(b.as_py(), dtype=kind) for b in table.column(name)]) for name, kind in _KINDS.items()
    }
    texts: list[bytes] = []
    counts = []
    for lengths, blob in zip(table.column("lengths"), table.column("texts"), strict=True):
        ends = np.cumsum(np.frombuffer(lengths.as_py(), dtype=np.int64)).tolist()
        whole = blob.as_py()
        texts += [whole[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        counts.append(len(ends))
    return arrays, texts, counts


def _chained(keys: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """The number of each entry's text: entries of a key are chained and their bytes compared."""
    out = np.empty(len(keys), dtype=np.int64)
    chains: dict[int, list[tuple[bytes, int]]] = {}
    texts_seen = 0
    for k, (key, text) in enumerate(zip(keys.tolist(), texts, strict=True)):
        chain = chains.setdefault(key, [])
        for other, number in chain:
            if other == text:
                out[k] = number
                break
        else:
            chain.append((text, texts_seen))
            out[k] = texts_seen
            texts_seen += 1
    return out


def _united(arrays: dict[str, np.ndarray], texts: list[bytes], blocks_of: np.ndarray) -> tuple[np.ndarray, dict, list[bytes], np.ndarray]:
    """Of entries: the text of each; and of the texts: what stays, their bytes, the blocks of these rows."""
    own = _chained(arrays["keys"], texts)
    order = _ranked(own, arrays["chars"], arrays["known"], arrays["ids"], blocks_of, arrays["places"])
    first = order[np.searchsorted(own[order], np.arange(own.max(initial=-1) + 1))]
    best = {name: arrays[name][first] for name in ("keys", "chars", "ids", "known", "places")}
    best["rows"] = np.bincount(own, weights=arrays["rows"], minlength=len(first)).astype(np.int64)
    return own, best, [texts[k] for k in first.tolist()], blocks_of[first]


_PLACE = [("block", pa.int64()), ("bucket", pa.int32()), ("owner", pa.int32()), ("owners", pa.int32())]
_STAYS = {"ids": np.int64, "known": bool, "rows": np.int64, "best_blocks": np.int64, "places": np.int64}
_OWNED = f"block long, bucket int, owner int, owners int, own binary, best_blocks binary, {_ENTRY}"
_ANSWER = "block long, bucket int, ids binary, known binary, rows binary, best_blocks binary, places binary"


def _split(arrays: dict[str, np.ndarray], own: np.ndarray, counts: list[int]) -> list[dict[str, bytes]]:
    """For each run of entries, what stays of their texts."""
    cuts = np.cumsum(counts)[:-1]
    parts = {name: np.split(np.ascontiguousarray(arrays[name][own], dtype=kind), cuts) for name, kind in _STAYS.items()}
    return [{name: parts[name][k].tobytes() for name in _STAYS} for k in range(len(counts))]


def chained(sent: DataFrame) -> DataFrame:
    """For rows (block, bucket, owner, owners) of entries: by block and bucket, what stays of each entry's text.

    Returns block, bucket and, as arrays over the entries: ids and known, the id
    of the row that stays and whether it has one; rows, the size of its group;
    best_blocks and places, where the row is found.
    """
    path = scratch.folder(sent.sparkSession)
    schema = pa.schema([*_PLACE, *[(n, pa.binary()) for n in ("own", "best_blocks", *_KINDS, "texts")]])

    def compare(table: pa.Table) -> pa.Table:
        arrays, texts, counts = _read(table)
        block = table.column("block").to_pylist()
        own, best, kept, from_block = _united(arrays, texts, np.repeat(np.array(block, dtype=np.int64), counts))
        place = {c: table.column(c)[0].as_py() for c in ("bucket", "owner", "owners")}
        if place["owners"] == 1:
            rows = [place | {"block": b} | part for b, part in zip(block, _split(best | {"best_blocks": from_block}, own, counts), strict=True)]
        else:  # other owners may hold the same texts
            cuts = np.split(own, np.cumsum(counts)[:-1])
            rows = [place | {"block": b, "own": part.tobytes()} for b, part in zip(block, cuts, strict=True)]
            rows.append(place | _written(best, kept) | {"best_blocks": from_block.tobytes()})
        return pa.Table.from_pylist(rows, schema=schema)

    owned = scratch.save(sent.groupBy("bucket", "owner").applyInArrow(compare, _OWNED), f"{path}/chains")
    shared = owned.where("owners > 1")
    answer = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), *[(n, pa.binary()) for n in _STAYS]])

    def unite(table: pa.Table) -> pa.Table:
        arrays, texts, counts = _read(table)
        from_block = np.concatenate([np.frombuffer(b.as_py(), dtype=np.int64) for b in table.column("best_blocks")])
        own, best, _, from_block = _united(arrays, texts, from_block)
        parts = _split(best | {"best_blocks": from_block}, own, counts)
        owners = table.column("owner").to_pylist()
        rows = [{"bucket": table.column("bucket")[0].as_py(), "owner": o} | part for o, part in zip(owners, parts, strict=True)]
        return pa.Table.from_pylist(rows, schema=pa.schema([*_PLACE[1:3], *[(n, pa.binary()) for n in _STAYS]]))

    united = shared.where("block is null").groupBy("bucket").applyInArrow(unite, "bucket int, owner int, " + _ANSWER.split(", ", 2)[2])

    def spread(blocks_of: pa.Table, stays: pa.Table) -> pa.Table:
        best = {name: np.frombuffer(stays.column(name)[0].as_py(), dtype=kind) for name, kind in _STAYS.items()}
        own = [np.frombuffer(b.as_py(), dtype=np.int64) for b in blocks_of.column("own")]
        parts = _split(best, np.concatenate(own), [len(o) for o in own])
        rows = [{"block": b, "bucket": stays.column("bucket")[0].as_py()} | part for b, part in zip(blocks_of.column("block").to_pylist(), parts, strict=True)]
        return pa.Table.from_pylist(rows, schema=answer)

    of_blocks = shared.where("block is not null").select("block", "bucket", "owner", "own")
    several = of_blocks.groupBy("bucket", "owner").cogroup(united.groupBy("bucket", "owner")).applyInArrow(spread, _ANSWER)
    return owned.where("owners = 1").select("block", "bucket", *_STAYS).unionByName(several)


def dedup(
    docs: DataFrame, text: str = "text", key: str = "doc_id", hashed: Callable[[bytes], int] = text_key,
    bucket_keys: int = BUCKET_KEYS, bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """Every row with its columns, and the row of its group of equal texts that stays.

    Adds keep_id (the key of that row), group_size (rows of the group), kept
    (whether it is this row) and text_sha256 (of the text without white space,
    UTF-8). The row with most code points stays, of these the one with the
    smallest key, nulls last; of rows that agree in both the first as stored, so
    one row of a group is kept and no more. A null text counts as empty. The
    column key is a whole number. Columns of the input that are called like a
    result are replaced by it.

    hashed: the 64-bit key of a text without white space. Texts that it makes
    collide still part, as bytes decide.
    """
    spark, path = docs.sparkSession, scratch.folder(docs.sparkSession)
    names = [f for f in docs.schema.fields if f.name not in RESULTS.fieldNames()]
    if not isinstance(docs.schema[key].dataType, T.IntegralType):
        raise ValueError(f"{key} is no column of whole numbers")
    docs = docs.select(*[F.col(f"`{f.name}`") for f in names])
    packed = blocks.pack(docs, text, f"{path}/blocks")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob in zip(batch.column("block").to_pylist(), batch.column("blob"), strict=True):
                own = entries(blocks.unpacked(blob.as_py()), text, key, hashed)
                sizes = np.array([len(t) for t in own.texts], dtype=np.int64)
                yield pa.RecordBatch.from_pydict({"block": [block], "keys": [own.keys.tobytes()], "sizes": [sizes.tobytes()]})

    asked = packed.select("block", "blob").mapInArrow(ask, "block long, keys binary, sizes binary")
    asked = scratch.save(asked, f"{path}/asked")
    count = (asked.agg(F.sum(F.octet_length("keys"))).first()[0] or 0) // 8
    bucket_keys = max(bucket_keys, count >> (MAX_DEPTH - 2))
    depth = prefix_depth(count, bucket_keys)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << depth, dtype=np.int64)
        for batch in batches:
            for keys in batch.column("keys"):
                seen += np.bincount(_prefixes(np.frombuffer(keys.as_py(), dtype=_U), depth), minlength=1 << depth)
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"prefix": used, "weight": seen[used]})

    directory, _ = grown(_bins(asked.mapInArrow(tally, "prefix long, weight long"), depth), bucket_keys)
    texts = packed.agg(F.sum("size")).first()[0] or 0
    bucket_bytes = max(bucket_bytes, texts >> (MAX_DEPTH - 2))
    depth = max(directory.depth, prefix_depth(texts + ENTRY_BYTES * count, bucket_bytes))
    told = scratch.save(contested(asked, directory, depth), f"{path}/told")
    scratch.drop(spark, f"{path}/asked")

    heavy = told.where("block is null").select(F.explode(F.arrays_zip("prefixes", "weights")).alias("at"))
    weights = _bins(heavy.select(F.col("at.prefixes").alias("prefix"), F.col("at.weights").alias("weight")), depth)
    second, held = grown(weights, bucket_bytes, directory)
    owners = np.maximum(1, -(-held // bucket_bytes))
    told = told.where("block is not null").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "bits"))).alias("told"))

    def several(own: Entries, parts: list[dict]) -> np.ndarray:
        """The contested entries of a block."""
        cuts = list(_by_bucket(directory.of(own.keys)))
        bits = [np.unpackbits(np.frombuffer(p["bits"], dtype=np.uint8), count=at.stop - at.start) for p, (_, at) in zip(parts, cuts, strict=True)]
        return np.flatnonzero(np.concatenate(bits)) if bits else np.zeros(0, dtype=np.int64)

    entry_schema = pa.schema([*_PLACE, *[(n, pa.binary()) for n in (*_KINDS, "texts")]])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = entries(blocks.unpacked(row["blob"]), text, key, hashed)
                some = several(own, row["told"])
                out = []
                for bucket, at in _by_bucket(second.of(own.keys[some])):
                    mine = some[at]
                    arrays = {
                        "keys": own.keys[mine], "rows": own.rows[mine], "chars": own.chars[mine],
                        "ids": own.ids[mine], "known": own.known[mine], "places": own.best[mine],
                    }
                    dealt = int(owners[bucket])
                    owner = ((row["block"] >> 32) + (row["block"] & 0xFFFFFFFF)) % dealt
                    place = {"block": row["block"], "bucket": bucket, "owner": owner, "owners": dealt}
                    out.append(place | _written(arrays, [own.texts[k] for k in mine.tolist()]))
                yield from pa.Table.from_pylist(out, schema=entry_schema).to_batches()

    joined = packed.select("block", "blob").join(told, "block")
    sent = joined.mapInArrow(send, f"block long, bucket int, owner int, owners int, {_ENTRY}")
    each = chained(sent)
    stays = F.struct("bucket", *_STAYS)
    answers = scratch.save(each.groupBy("block").agg(F.sort_array(F.collect_list(stays)).alias("stays")), f"{path}/answers")
    schema = T.StructType([*names, *RESULTS.fields])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                table = blocks.unpacked(row["blob"])
                own = entries(table, text, key, hashed)
                ids, known, rows, place = own.ids.copy(), own.known.copy(), own.rows.copy(), own.best.copy()
                block = np.full(len(ids), row["block"], dtype=np.int64)
                parts = row["stays"] or []
                if parts:
                    some = several(own, row["told"])
                    for array, (name, kind) in zip((ids, known, rows, block, place), _STAYS.items(), strict=True):
                        array[some] = np.concatenate([np.frombuffer(p[name], dtype=kind) for p in parts])
                digests = [hashlib.sha256(t).hexdigest() for t in own.texts]
                at = own.of_row
                kept = (block[at] == row["block"]) & (place[at] == np.arange(len(at)))
                results = [pa.array(ids[at], pa.int64(), mask=~known[at]), pa.array(rows[at], pa.int64()), pa.array(kept), pa.array([digests[k] for k in at.tolist()])]
                for name, values in zip(RESULTS.fieldNames(), results, strict=True):
                    table = table.append_column(name, values)
                yield from table.to_batches()

    whole = packed.select("block", "blob").join(told, "block").join(answers, "block", "left")
    return whole.select("block", "blob", "told", "stays").mapInArrow(finish, schema)
