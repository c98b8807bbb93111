"""Exact self-join on Jaccard distance, in the metric space of shingle sets.

One minus the Jaccard coefficient is a metric, and documents link at distance
0.2 or less. The join works with pivots, regions and triangle bounds:

1. Pivots of the first level are single shingles: a document is nearest to the
   pivots it holds, and ties go by shingle hash, so its home region is that of
   its smallest hash. A linked document lacks at most n/5 of its n shingles;
   so the document is replicated into the regions of its n/5 + 1 first pivots
   and no others, and meets every linked one in one of them. Shingles that very
   many points hold, as templates and notices do, come after all others in the
   order of pivots: where a region is found to be crowded, its points' shingles
   are counted, and points with such pivots get rarer ones. Any order will do,
   so long as it is the same for all.
2. Most documents are far from all others. Of a somewhat longer list of first
   pivots a linked document may be alone in n/5 regions at most. Blocks of
   documents ask shards of pivots which regions hold a second document; who
   is alone in more than n/5 goes no further. This is exact, not a sample:
   listed() makes the lists of linked documents long enough for each other.
3. Equal sets are one point. In each region PIVOTS points, those of smallest
   hash under as many seeds, are the second-level pivots, and every other point
   is compared with them. Regions of one group mostly have the same pivots, so
   links found this way join groups of near copies by a few comparisons a point.
4. The regions join recursively: points of a region that step 3 left in
   different components are compared with one another. Large regions are cut
   into blocks, each pair of blocks being a group of its own.

Before sets are compared a third kind of pivot prunes: hash classes of the
universe of shingles, first 64, then 256. The difference of two points' counts
in each class, summed up, bounds the size of their symmetric difference from
below (the triangle inequality of the counting metric); linked sets differ in
(|x| + |y|) / 9 at most.

Shingles are known by 64-bit hashes, sets by 128-bit hashes.

Pivots that are whole documents cannot do the first level: nearly all documents
of a corpus are at distance 1 from nearly all others, so no bound would hold
any region apart from any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorlake.llm import blocks, graph, scratch, skew, words

_U = np.uint64
SHINGLE = 5
CLASSES = 256
#: Sums of neighbouring classes, which are compared first.
COARSE = 64
#: Points of each region that all others of the region are compared with.
PIVOTS = 4
#: Pairs whose classes are compared at a time.
PAIRS_AT_ONCE = 1 << 14
#: The most that is broadcast, in bytes.
BROADCAST_BYTES = 32 << 20
#: Points of a region that are compared in one group.
REGION_POINTS = 2048
#: Points, of whatever regions, that one group compares.
GROUP_ROWS = 30_000
#: A region of more points is crowded.
CROWD = 512
#: Shingles of points that ask together which of them are frequent.
BLOCK_SHINGLES = 1 << 19
_TOLD = -1


def shingles(rows: pa.ChunkedArray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The number of each document and its distinct shingles, sorted by document, then by hash."""
    docs, all_hashes = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=_U)]
    for part in words.split(rows):
        hashes = part.hashes(lower=True)
        who = np.repeat(np.arange(len(part.counts)), part.counts)
        whole = np.arange(len(hashes)) + size <= part.offsets[1:][who]
        at = np.flatnonzero(whole)
        found, of = [words.grams(hashes, size, 3)[at]], [who[at]]
        for length in range(1, size):
            short = np.flatnonzero(part.counts == length)
            starts = part.offsets[short]
            found.append(words.grams(hashes, length, 100 + length)[starts] if len(short) else np.zeros(0, dtype=_U))
            of.append(short)
        hash_of, doc_of = np.concatenate(found), np.concatenate(of)
        order = np.lexsort((hash_of, doc_of))
        hash_of, doc_of = hash_of[order], doc_of[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (hash_of[1:] != hash_of[:-1]) | (doc_of[1:] != doc_of[:-1])
        docs.append(doc_of[new] + part.first)
        all_hashes.append(hash_of[new])
    return np.concatenate(docs), np.concatenate(all_hashes)


def listed(n: np.ndarray) -> np.ndarray:
    """How many of its n first shingles a document lists.

    Of x's list a linked y may lack the |x - y| shingles it does not hold, and those
    that its own |y - x| push off its list: listed(x) - listed(y) + |y - x| of them.
    Neither may exceed |x| // 5. 0.35 n rounded to the nearest leaves room for that
    from 48 shingles on; sizes below are enumerated in the tests. Rounded down, the
    lists of some short texts were one too short.
    """
    return np.maximum(n // 5 + 1, (7 * n + 10) // 20)


def _firsts(docs: np.ndarray, counts: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Places of the first limits[d] shingles of each document."""
    starts = np.cumsum(counts) - counts
    return np.flatnonzero(np.arange(len(docs)) - starts[docs] < limits[docs])


def _questions(text: str, shards: int):
    """Pivots that each block's documents have first, and one row with the documents themselves."""
    fields = [("block", pa.int64()), ("shard", pa.int32()), ("keys", pa.binary()), ("who", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob in zip(batch.column("block").to_pylist(), batch.column("blob"), strict=True):
                rows = blocks.unpacked(blob.as_py())
                docs, hashes = shingles(rows.column(text))
                counts = np.bincount(docs, minlength=rows.num_rows)
                names = b"".join(
                    xxhash.xxh3_128_digest(h.tobytes()) for h in np.split(hashes, np.cumsum(counts)[:-1])
                )
                at = _firsts(docs, counts, listed(counts))
                order = np.argsort(hashes[at], kind="stable")
                keys, who = hashes[at][order], docs[at][order].astype(np.uint16)
                cuts = blocks.by_shard(keys, shards)
                used = np.flatnonzero(np.diff(cuts))
                rows_out = {
                    "block": [block] * (len(used) + 1),
                    "shard": [_TOLD, *used.tolist()],
                    "keys": [counts.astype(np.int64).tobytes(), *(keys[cuts[s] : cuts[s + 1]].tobytes() for s in used)],
                    "who": [names, *(who[cuts[s] : cuts[s + 1]].tobytes() for s in used)],
                }
                yield pa.RecordBatch.from_pydict(rows_out, schema=pa.schema(fields))

    return run


def _alone(table: pa.Table) -> pa.Table:
    """For each question, how many of its documents' pivots no second document has, by document."""
    if table.column("shard")[0].as_py() == _TOLD:
        return table
    keys = [np.frombuffer(b.as_py(), dtype=_U) for b in table.column("keys")]
    who = [np.frombuffer(b.as_py(), dtype=np.uint16) for b in table.column("who")]
    order, number = blocks.groups(np.concatenate(keys))
    single = np.empty(len(order), dtype=bool)
    single[order] = np.bincount(number)[number] == 1
    out = [
        np.bincount(w[s]).astype(np.uint32).tobytes()
        for w, s in zip(who, np.split(single, np.cumsum([len(k) for k in keys])[:-1]), strict=True)
    ]
    return pa.table({"block": table["block"], "shard": table["shard"], "keys": pa.array(out, pa.binary()), "who": pa.array([b""] * len(out), pa.binary())})


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document of a block: its place, size, set name, and whether it may have links."""
    for batch in batches:
        for block, told in zip(batch.column("block").to_pylist(), batch.column("told").to_pylist(), strict=True):
            first = next(x for x in told if x["shard"] == _TOLD)
            counts = np.frombuffer(first["keys"], dtype=np.int64)
            alone = np.zeros(len(counts), dtype=np.int64)
            for x in told:
                if x["shard"] != _TOLD:
                    own = np.frombuffer(x["keys"], dtype=np.uint32)
                    alone[: len(own)] += own
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(counts), block), pa.int64()),
                    pa.array(np.arange(len(counts)), pa.int32()),
                    pa.array(counts, pa.int64()),
                    pa.array([first["who"][16 * k : 16 * k + 16] for k in range(len(counts))], pa.binary()),
                    pa.array((counts > 0) & (alone <= counts // 5), pa.bool_()),
                ],
                names=["block", "place", "n_shingles", "set", "near"],
            )


def _points(text: str):
    """Of the chosen documents of a block: set name, size, class counts, shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, places in zip(batch.column("blob"), batch.column("places").to_pylist(), strict=True):
                rows = blocks.unpacked(blob.as_py()).select([text]).take(pa.array(places))
                docs, hashes = shingles(rows.column(text))
                counts = np.bincount(docs, minlength=rows.num_rows)
                classes = np.bincount(docs * CLASSES + (hashes % _U(CLASSES)).astype(np.int64), minlength=CLASSES * rows.num_rows)
                sets = np.split(hashes, np.cumsum(counts)[:-1])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in sets], pa.binary()),
                        pa.array(counts, pa.int64()),
                        pa.array(_clipped(classes.reshape(-1, CLASSES)), pa.binary()),
                        pa.array([h.tobytes() for h in sets], pa.binary()),
                    ],
                    names=["set", "n", "classes", "hashes"],
                )

    return run


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        firsts = [np.frombuffer(b.as_py(), dtype=np.int64)[: n // 5 + 1] for b, n in zip(batch.column("hashes"), batch.column("n").to_pylist(), strict=True)]
        sizes = [len(f) for f in firsts]
        at = pa.array(np.repeat(np.arange(len(sizes)), sizes))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(firsts)) if firsts else pa.array([], pa.int64()), batch.column("set").take(at)], names=["region", "set"])


def _few(rows: DataFrame, count: int) -> DataFrame:
    """Rows of a long, to be broadcast if they are few enough."""
    return F.broadcast(rows) if 8 * count <= BROADCAST_BYTES else rows


def _packed_points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        places = np.concatenate(([0], np.cumsum(batch.column("n").to_numpy())))
        for low, high in words.chunks(places, BLOCK_SHINGLES):
            blob = blocks.packed(batch.slice(low, high - low))
            yield pa.RecordBatch.from_pydict({"block": [number], "size": [int(places[high] - places[low])], "blob": [blob]})
            number += 1


def _held(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(b.as_py(), dtype=_U) for b in table.column("hashes")]


def _frequent(held: DataFrame, path: str) -> DataFrame:
    """The shingles that more than CROWD of the points hold; blocks of points send shards what they hold and how often."""
    packed = scratch.save(held.mapInArrow(_packed_points, "block long, size long, blob binary"), path)
    shards = blocks.shards_for(packed.agg(F.sum("size")).first()[0] or 0)

    def keys(table: pa.Table) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        own, counts = np.unique(np.concatenate(_held(table)), return_counts=True)
        return own, {"counts": counts.astype(np.int64)}

    def count(table: pa.Table) -> pa.Table:
        own = np.concatenate([np.frombuffer(b.as_py(), dtype=_U) for b in table["keys"]])
        counts = np.concatenate([np.frombuffer(b.as_py(), dtype=np.int64) for b in table["counts"]])
        distinct, at = np.unique(own, return_inverse=True)
        return pa.table({"region": distinct[np.bincount(at, weights=counts) > CROWD].view(np.int64)})

    return blocks.questions(packed, shards, keys, ["counts"]).groupBy("shard").applyInArrow(count, "region long")


def _late(asked: pa.Table, frequent: pa.Table) -> pa.Table:
    """For each question, which of its keys are frequent."""
    known = np.sort(frequent["region"].to_numpy().view(_U))
    bits = []
    for keys in asked["keys"]:
        own = np.frombuffer(keys.as_py(), dtype=_U)
        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
        bits.append((known[at] == own if len(known) else np.zeros(len(own), dtype=bool)).tobytes())
    return pa.table({"block": asked["block"], "shard": asked["shard"], "bits": pa.array(bits, pa.binary())})


def _dealt_anew(held: DataFrame, frequent: DataFrame, path: str) -> DataFrame:
    """The regions of points by their first shingles, frequent ones last: blocks of points ask shards which are."""
    packed = scratch.save(held.mapInArrow(_packed_points, "block long, size long, blob binary"), path)
    shards = blocks.shards_for(packed.agg(F.sum("size")).first()[0] or 0)
    asked = blocks.questions(packed, shards, lambda table: (np.unique(np.concatenate(_held(table))), {}), [])

    def of_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.sort(batch.column("region").to_numpy().view(_U))
            shard = np.repeat(np.arange(shards, dtype=np.int32), np.diff(blocks.by_shard(keys, shards)))
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(keys.view(np.int64))], names=["shard", "region"])

    owned = frequent.mapInArrow(of_shard, "shard int, region long")
    told = asked.groupBy("shard").cogroup(owned.groupBy("shard")).applyInArrow(_late, "block long, shard int, bits binary")
    both = packed.select("block", "blob").join(blocks.gathered(told, "told"), "block").select("blob", "told")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, parts in zip(batch.column("blob"), batch.column("told").to_pylist(), strict=True):
                table = blocks.unpacked(blob.as_py())
                hashes = _held(table)
                keys, late = np.unique(np.concatenate(hashes)), blocks.joined(parts, bool)
                firsts = [h[np.argsort(late[np.searchsorted(keys, h)], kind="stable")[: len(h) // 5 + 1]] for h in hashes]
                at = pa.array(np.repeat(np.arange(len(firsts)), [len(f) for f in firsts]))
                regions = pa.array(np.concatenate(firsts).view(np.int64))
                sets = table.column("set").combine_chunks().take(at)
                yield pa.RecordBatch.from_arrays([regions, sets], names=["region", "set"])

    return both.mapInArrow(deal, "region long, set binary")


def _uncrowded(points: DataFrame, path: str) -> DataFrame:
    """The regions of each point: rows (region, set).

    Frequent shingles are those that more than CROWD points of crowded regions
    hold. They come last in the order of every point, and only points that have
    one among their first pivots are dealt anew. That may crowd other regions, so
    it is repeated until no region is crowded but those of frequent shingles, which
    points have as pivots that hold little else.
    """
    members = points.select("set", "n", "hashes").mapInArrow(_regions, "region long, set binary")
    frequent, known, turn = None, 0, 0
    crowded_sets = None
    while True:
        crowds = members.groupBy("region").agg(F.count("*").alias("points")).where(F.col("points") > CROWD).select("region")
        if frequent is not None:
            crowds = crowds.join(_few(frequent, known), "region", "left_anti")
        crowds = scratch.save(crowds, f"{path}/crowds-{turn}")
        count = crowds.count()
        if not count:
            return members
        found = members.join(_few(crowds, count), "region", "left_semi").select("set")
        found = found if crowded_sets is None else found.union(crowded_sets)
        crowded_sets = scratch.save(found.distinct(), f"{path}/crowded-{turn}")
        held = _frequent(points.join(crowded_sets, "set", "left_semi").select("set", "n", "hashes"), f"{path}/counted-{turn}")
        frequent = scratch.save(held if frequent is None else held.union(frequent).distinct(), f"{path}/frequent-{turn}")
        known = frequent.count()
        dealt = members.join(_few(frequent, known), "region", "left_semi").select("set")
        dealt = scratch.save(dealt.distinct(), f"{path}/dealt-{turn}")
        anew = _dealt_anew(points.join(dealt, "set", "left_semi").select("set", "n", "hashes"), frequent, f"{path}/anew-{turn}")
        members = scratch.save(members.join(dealt, "set", "left_anti").unionByName(anew), f"{path}/dealt-members-{turn}")
        turn += 1


def _clipped(counts: np.ndarray) -> list[bytes]:
    """Counts as bytes. Counts that stop at 255 differ by less than the counts do, so bounds hold."""
    return [row.tobytes() for row in np.minimum(counts, 255).astype(np.uint8)]


def _counts(column: pa.Array, width: int) -> np.ndarray:
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset :][: len(column) + 1]
    held = column.buffers()[2]
    return np.frombuffer(held if held else b"", dtype=np.uint8)[ends[0] : ends[-1]].reshape(-1, width)


def _allowed(classes: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs (a, b) of rows may be linked as far as these class counts tell."""
    keep = [np.zeros(0, dtype=bool)]
    for at in range(0, len(a), PAIRS_AT_ONCE):
        x, y = a[at : at + PAIRS_AT_ONCE], b[at : at + PAIRS_AT_ONCE]
        keep.append(9 * np.abs(classes[x].astype(np.int16) - classes[y]).sum(axis=1, dtype=np.int64) <= n[x] + n[y])
    return np.concatenate(keep)


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose class counts allow a link."""
    for batch in batches:
        rows, n = batch.num_rows, np.concatenate([batch.column(c).to_numpy() for c in ("n_a", "n_b")])
        classes = np.concatenate([_counts(batch.column(c), CLASSES) for c in ("classes_a", "classes_b")])
        yield batch.filter(pa.array(_allowed(classes, n, np.arange(rows), np.arange(rows) + rows))).select(["a", "b"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs at distance 0.2 or less."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("hashes_a"), batch.column("hashes_b"), strict=True):
            a, b = np.frombuffer(x.as_py(), dtype=_U), np.frombuffer(y.as_py(), dtype=_U)
            at = np.minimum(np.searchsorted(b, a), len(b) - 1)
            both = int((b[at] == a).sum())
            keep.append(100 * both >= 80 * (len(a) + len(b) - both))
        yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])


def _across(table: pa.Table) -> pa.Table:
    """Pairs of points of a region in different components that the bounds allow, for many regions at once."""
    table = table.sort_by([("region", "ascending"), ("low", "ascending"), ("high", "ascending"), ("n", "ascending")])
    region, low, high, n, block = (table[c].to_numpy() for c in ("region", "low", "high", "n", "part"))
    roots = table["root"].combine_chunks().dictionary_encode().indices.to_numpy()
    points, classes = table["set"].combine_chunks(), _counts(table["classes"].combine_chunks(), CLASSES)
    coarse = classes.reshape(-1, COARSE, CLASSES // COARSE).sum(axis=2, dtype=np.int16)
    new = np.ones(len(n), dtype=bool)
    new[1:] = (region[1:] != region[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    begins = np.append(np.flatnonzero(new), len(n))
    coded = points.dictionary_encode()
    name, names = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
    found, held = [np.zeros(0, dtype=np.int64)], 0
    for begin, end in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
        for at in range(begin, end - 1, 64):
            # 64 points against those that follow, up to a quarter larger
            own = np.arange(at, min(at + 64, end - 1))
            other = np.arange(at + 1, begin + int(np.searchsorted(n[begin:end], n[own[-1]] * 5 // 4, side="right")))
            allowed = (other[None, :] > own[:, None]) & (roots[other][None, :] != roots[own][:, None])
            allowed &= 4 * n[other][None, :] <= 5 * n[own][:, None]
            if low[at] != high[at]:
                allowed &= block[other][None, :] != block[own][:, None]
            a, b = np.nonzero(allowed)
            a, b = own[a], other[b]
            for counts in (coarse, classes):
                near = _allowed(counts, n, a, b)
                a, b = a[near], b[near]
            a, b = name[a], name[b]
            found.append(np.minimum(a, b) * names + np.maximum(a, b))
            held += len(a)
            if held > 1 << 20:  # a pair of near copies shares many regions
                found = [np.unique(np.concatenate(found))]
                held = 0
    pairs = np.unique(np.concatenate(found))
    return pa.table({"a": coded.dictionary.take(pa.array(pairs // names)), "b": coded.dictionary.take(pa.array(pairs % names))})


def _verified(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """The pairs (a, b) of set names that are linked, bounds first."""

    def side(name: str, *columns: str) -> DataFrame:
        return points.select(F.col("set").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in columns])

    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    sized = pairs.join(side("a", "n", "classes"), "a").join(side("b", "n", "classes"), "b")
    sized = sized.where("5 * least(n_a, n_b) >= 4 * greatest(n_a, n_b)")
    close = sized.select("a", "b", "n_a", "n_b", "classes_a", "classes_b").mapInArrow(_bounded, "a binary, b binary")
    whole = close.join(side("a", "hashes"), "a").join(side("b", "hashes"), "b")
    return whole.select("a", "b", "hashes_a", "hashes_b").mapInArrow(_linked, "a binary, b binary")


def _seeded(seed: Column) -> Column:
    return F.xxhash64("set", seed)


def _resolved(docs: DataFrame, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows in blocks, one row per document (block, place, n_shingles, set), and the root of each linked set."""
    spark = docs.sparkSession
    path = scratch.folder(spark)
    packed = blocks.pack(docs, text, f"{path}/blocks")
    size = packed.agg(F.sum("size")).first()[0] or 0
    schema = "block long, shard int, keys binary, who binary"
    asked = packed.select("block", "blob").mapInArrow(_questions(text, blocks.shards_for(size // 18)), schema)
    told = asked.groupBy("shard", F.when(F.col("shard") == _TOLD, F.col("block")).alias("own")).applyInArrow(_alone, schema)
    told = told.groupBy("block").agg(F.collect_list(F.struct("shard", "keys", "who")).alias("told"))
    placed = "block long, place int, n_shingles long, set binary, near boolean"
    sized = scratch.save(told.mapInArrow(_documents, placed), f"{path}/documents")

    # one document of each set that may have links
    chosen = sized.where("near").groupBy("set").agg(F.min(F.struct("block", "place")).alias("at"))
    chosen = chosen.groupBy("at.block").agg(F.collect_list("at.place").alias("places"))
    points = _beside(packed, scratch.save(chosen, f"{path}/chosen"))
    points = scratch.save(points.mapInArrow(_points(text), "set binary, n long, classes binary, hashes binary"), f"{path}/points")
    members = _uncrowded(points, path)
    least = [F.min(_seeded(F.lit(k))).alias(f"m{k}") for k in range(PIVOTS)]
    regions = members.groupBy("region").agg(F.count("*").alias("points"), *least).where("points > 1")
    regions = regions.select("region", F.array(*[f"m{k}" for k in range(PIVOTS)]).alias("pivots"))
    members = scratch.save(members.join(regions, "region"), f"{path}/members")

    # a pivot is found by its hash; should two points share one, both are compared
    named = members.select(F.col("set").alias("b"), F.posexplode("pivots").alias("seed", "pivot")).distinct()
    pivots = points.select(F.col("set").alias("a"), "set", F.explode(F.array(*map(F.lit, range(PIVOTS)))).alias("seed"))
    pivots = pivots.select("a", "seed", _seeded(F.col("seed")).alias("pivot"))
    near = scratch.save(_verified(named.join(pivots, ["seed", "pivot"]).select("a", "b"), points), f"{path}/near")
    members = members.select("region", "set")
    roots = graph.components(near, f"{path}/first")
    rest = scratch.save(_apart(members, points, roots, path), f"{path}/apart")
    links = near.union(_verified(rest, points))
    return packed, sized, scratch.save(graph.components(links, f"{path}/all"), f"{path}/roots")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Components of documents whose shingle sets link at Jaccard 0.8 or more.

    Returns per row: the key, n_shingles (long) and component_id, the smallest
    key reachable by links. Words are lower-cased in A-Z; fewer than five words
    are one shingle. A text without words, or null, has no shingle and no link,
    and is its own component. Repeated rows are equal sets and so one component.
    A null key is never the smallest unless all keys of the component are null.
    Other columns are left out.
    """
    held = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    packed, sized, roots = _resolved(held, "text")

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob in zip(batch.column("block").to_pylist(), batch.column("blob"), strict=True):
                own = blocks.unpacked(blob.as_py()).column("id").combine_chunks()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(own), block), pa.int64()), pa.array(np.arange(len(own)), pa.int32()), own],
                    names=["block", "place", "id"],
                )

    rows = packed.select("block", "blob").mapInArrow(ids, "block long, place int, id long")
    rows = _rooted(sized, roots).join(rows, ["block", "place"])
    rows = scratch.save(rows, f"{scratch.folder(docs.sparkSession)}/rooted")
    least = rows.where("root is not null").groupBy("root").agg(F.min("id").alias("least"), F.count("*").alias("rows"))
    # no name of a set has 17 bytes
    other = F.concat(F.unhex(F.md5(F.concat_ws(" ", "block", "place"))), F.unhex(F.lit("00")))
    out = skew.beside(rows, least, "root", "rows", rows.count(), other)
    return out.select(F.col("id").alias(key), "n_shingles", F.coalesce("found.least", "id").alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, that of the smallest key, with its columns as they are.

    Rows without words are no one's copies and all stay. Of rows that repeat the
    smallest key one stays; a null key comes before all others here.
    """
    packed, sized, roots = _resolved(docs, text)
    path = scratch.folder(docs.sparkSession)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob in zip(batch.column("block").to_pylist(), batch.column("blob"), strict=True):
                own = blocks.unpacked(blob.as_py()).column(key).combine_chunks().cast(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(own), block), pa.int64()), pa.array(np.arange(len(own)), pa.int32()), own],
                    names=["block", "place", "id"],
                )

    named = packed.select("block", "blob").mapInArrow(keys, "block long, place int, id long")
    rows = _rooted(sized, roots).join(named, ["block", "place"])
    first = rows.where("root is not null").groupBy("root").agg(F.min(F.struct("id", "block", "place")).alias("at")).select("at.block", "at.place")
    kept = first.union(rows.where("root is null").select("block", "place"))
    kept = kept.groupBy("block").agg(F.sort_array(F.collect_list("place")).alias("places"))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, places in zip(batch.column("blob"), batch.column("places").to_pylist(), strict=True):
                yield from blocks.unpacked(blob.as_py()).take(pa.array(places)).to_batches()

    return _beside(packed, scratch.save(kept, f"{path}/kept")).mapInArrow(take, docs.schema)


def _beside(packed: DataFrame, chosen: DataFrame) -> DataFrame:
    """blob and places of each block that is chosen.

    Lists of places of BROADCAST_BYTES together at most are broadcast, so that
    blocks stay where they are; beyond that both sides are joined by block.
    """
    size = chosen.agg(F.sum(64 + 4 * F.size("places"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        chosen = F.broadcast(chosen)
    return packed.select("block", "blob").join(chosen, "block").select("blob", "places")


def _rooted(sized: DataFrame, roots: DataFrame) -> DataFrame:
    """block, place, n_shingles and root, the name of the row's component; null for rows without shingles."""
    rows = sized.select("block", "place", "n_shingles", "set").join(roots.withColumnRenamed("node", "set"), "set", "left")
    return rows.select("block", "place", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("root", "set")).alias("root"))


def _apart(members: DataFrame, points: DataFrame, roots: DataFrame, path: str) -> DataFrame:
    """Pairs of points that share a region and are still in different components.

    Pairs with a pivot of the region may come again. A group of work is some
    regions, or blocks of a large one, of about GROUP_ROWS rows. Regions with the
    same smallest component go to one group where they fit, so that a pair of near
    copies, which shares many regions, comes out of few groups and not of each region.
    """
    groups = max(1, -(-members.count() // GROUP_ROWS))
    rooted = members.join(roots.withColumnRenamed("node", "set"), "set", "left")
    rooted = scratch.save(rooted.select("region", "set", F.coalesce("root", "set").alias("root")), f"{path}/rooted")
    # components by hash: regions whose components all share one would stay shut, at odds of 2 ** -64
    ends = [f(F.xxhash64("root")).alias(name) for f, name in ((F.min, "least"), (F.max, "most"))]
    open_ = rooted.groupBy("region").agg(*ends, F.count("*").alias("points")).where("least < most")
    open_ = open_.select("region", "least", "points", F.ceil(F.col("points") / REGION_POINTS).cast("int").alias("parts"))
    open_ = scratch.save(open_, f"{path}/open")
    shares = F.ceil(F.sum(F.col("points") * F.col("parts")) / GROUP_ROWS).alias("shares")
    open_ = open_.join(open_.groupBy("least").agg(shares), "least").drop("points")
    dealt = rooted.join(open_, "region").withColumn("part", F.expr("cast(pmod(xxhash64(set), parts) as int)"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")})
    share = F.xxhash64("least", F.pmod(F.xxhash64("region", "low", "high"), F.col("shares")))
    group = F.when(F.col("shares") > 1, share).otherwise(F.pmod(F.xxhash64("least"), F.lit(groups))).alias("group")
    dealt = dealt.select("region", "set", "root", "part", "low", "high", group)
    dealt = dealt.join(points.select("set", "n", "classes"), "set")
    return dealt.groupBy("group").applyInArrow(_across, "a binary, b binary").distinct()
