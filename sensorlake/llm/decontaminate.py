"""Benchmark decontamination: BM25 with block-max WAND, then overlap.

The test items are the indexed texts and every passage of the corpus is a query.
A passage is two neighbouring stretches of a document, each as long as the longest
item, and stretches overlap by one; so whatever stands in the corpus in one piece
stands in one passage as a whole. Impacts are BM25 weights over the item's own
score, so an item whose every word is in the passage scores 1, and one threshold
fits all items.

Items lie in blocks. For every term and block the index holds the highest impact
in the block. A passage first adds up the block maxima of its terms, and only
blocks whose sum can reach the threshold are scored item by item; what its terms
have in other blocks is never read. Terms of so
little weight that all of them together stay below SLACK take no part in the
first step; the threshold there is lower by as much. Both bounds are upper
bounds, so every item above the threshold is retrieved.

What is retrieved is verified on five-word shingles: the item, or both its
question (all but the last sentence) and its answer (the last one), must be
contained in the passage to 0.8 or more. The item as a whole is enough, since
passages may end within the answer; both overlaps are returned.

All chunks of a task's texts are scored by array operations, CELLS sums of block
maxima at a time. The index is built
from one shard of items at a time, of SHARD_ITEMS at most, and sent with the job.
Item count, document frequencies, mean length and the length of a stretch are
those of all items, counted by Spark, so results do not depend on the shards.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from sensorlake.llm import scratch, words
from sensorlake.llm.words import Words

_U = np.uint64
THRESHOLD = 0.5
OVERLAP = 0.8
SHINGLE = 5
BLOCK_ITEMS = 4
SLACK = 0.1
SHARD_ITEMS = 20_000
#: Stretches times blocks of items that are bounded at a time.
CELLS = 1 << 17
K1, B = 1.2, 0.75


def _sentences(text: str) -> tuple[str, str]:
    """The question and the answer of an item: all sentences but the last, and the last."""
    ends = [m.end() for m in re.finditer(r"[.!?](?=[\x20\x09-\x0D])", text.rstrip())]
    return (text[: ends[-1]], text[ends[-1] :]) if ends else (text, text)


def _shingles(hashes: np.ndarray) -> np.ndarray:
    size = min(SHINGLE, len(hashes))
    return np.unique(words.grams(hashes, size, size)) if size else np.zeros(0, dtype=_U)


def _hashes(text: str) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype=_U), *(p.hashes(lower=True) for p in words.split(pa.array([text])))])


@dataclass
class Index:
    """Impacts by term and block, as runs in arrays. Items without words are not in it."""

    ids: list
    terms: np.ndarray  # sorted hashes
    items: np.ndarray  # by term, then by item
    impacts: np.ndarray
    block_starts: np.ndarray  # where each term's run of (block, highest impact) begins
    blocks: np.ndarray
    highest: np.ndarray
    block_items: np.ndarray  # where each of these blocks begins in items and impacts, and the end
    slight: np.ndarray  # of each term: whether it is left out of the first step
    slack: float
    stretch: int  # words
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # shingles: item, question, answer


@dataclass
class Statistics:
    """Of all items that have words: their number, mean and highest length, and how many hold a term."""

    items: int
    mean: float
    longest: int
    terms: np.ndarray  # sorted hashes, at least those of the items that are indexed
    frequency: np.ndarray


def build(rows: list[tuple], whole: Statistics | None = None) -> Index | None:
    """The index of rows (id, text); None if none has a word. Without statistics the rows are all items."""
    held = [(key, text, hashes) for key, text in rows if text and len(hashes := _hashes(text))]
    if not held:
        return None
    lengths = np.array([len(h) for _, _, h in held])
    found = [np.unique(h, return_counts=True) for _, _, h in held]
    item = np.repeat(np.arange(len(held)), [len(t) for t, _ in found])
    term, counts = np.concatenate([t for t, _ in found]), np.concatenate([c for _, c in found])
    terms, at = np.unique(term, return_inverse=True)
    if whole is None:
        whole = Statistics(len(held), float(lengths.mean()), int(lengths.max()), terms, np.bincount(at))
    frequency = whole.frequency[np.searchsorted(whole.terms, terms)]
    idf = np.log(1 + (whole.items - frequency + 0.5) / (frequency + 0.5))
    weight = idf[at] * counts * (K1 + 1) / (counts + K1 * (1 - B + B * lengths[item] / whole.mean))
    impact = weight / np.bincount(item, weights=weight)[item]
    order = np.lexsort((item, at))
    at, item, impact = at[order], item[order], impact[order]
    block = item // BLOCK_ITEMS
    new = np.ones(len(at), dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | (block[1:] != block[:-1])
    first = np.flatnonzero(new)
    top = np.maximum.reduceat(impact, np.searchsorted(at, np.arange(len(terms))))
    by_weight = np.argsort(top, kind="stable")
    slight = np.zeros(len(terms), dtype=bool)
    running = np.cumsum(top[by_weight])
    slight[by_weight[running < SLACK]] = True
    parts = []
    for _, text, hashes in held:
        question, answer = (_shingles(_hashes(x)) for x in _sentences(text))
        parts.append((_shingles(hashes), question, answer))
    return Index(
        [key for key, _, _ in held], terms, item, impact,
        np.searchsorted(at[first], np.arange(len(terms) + 1)), block[first], np.maximum.reduceat(impact, first),
        np.append(first, len(at)), slight, float(running[running < SLACK].max(initial=0.0)), max(32, whole.longest), parts,
    )


def _runs(starts: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the runs with the given numbers, and the size of each run."""
    begins = starts[of]
    sizes = starts[of + 1] - begins
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - ends + sizes, sizes), sizes


def retrieve(index: Index, term: np.ndarray, stretch: np.ndarray, pairs: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passages, items and scores of all pairs that score the threshold or more.

    term, stretch: distinct pairs of an indexed term and the stretch that has it,
    by stretch; pairs: the two stretches of each passage (equal for a document of
    one), ascending. Passages are taken in slices of CELLS stretches times blocks.
    """
    n_blocks = int(index.blocks.max()) + 1
    begins = np.searchsorted(stretch, np.arange(int(pairs.max()) + 2))
    found = []
    low = 0
    while low < len(pairs):
        high = max(low + 1, int(np.searchsorted(pairs[:, 1], pairs[low, 0] + CELLS // n_blocks)))
        for passage, item, score in _retrieve(index, term, begins, pairs[low:high], threshold, n_blocks):
            found.append((passage + low, item, score))
        low = high
    if not found:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none.astype(float)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _retrieve(index: Index, term: np.ndarray, begins: np.ndarray, pairs: np.ndarray, threshold: float, n_blocks: int) -> Iterator[tuple]:
    base, end = int(pairs[0, 0]), int(pairs[-1, 1]) + 1
    own = term[begins[base] : begins[end]]
    where = np.repeat(np.arange(end - base), np.diff(begins[base : end + 1]))
    strong = ~index.slight[own]
    at, sizes = _runs(index.block_starts, own[strong])
    cell = np.repeat(where[strong] * n_blocks, sizes) + index.blocks[at]
    sums = np.bincount(cell, weights=index.highest[at], minlength=(end - base) * n_blocks).reshape(-1, n_blocks)
    # a passage of a block sums what its two stretches have there
    two = pairs[:, 0] != pairs[:, 1]
    bound = sums[pairs[:, 0] - base]
    bound[two] += sums[pairs[two, 1] - base]
    passage, block = np.nonzero(bound >= threshold - index.slack - 1e-9)
    if not len(passage):
        return
    # items of those blocks, by all distinct terms of the passage; what the terms have in other blocks is skipped
    number = np.full(bound.shape, -1)
    number[passage, block] = np.arange(len(passage))
    wanted = np.unique(passage)
    keys = []
    for side, chosen in ((0, wanted), (1, wanted[two[wanted]])):
        at, sizes = _runs(begins, pairs[chosen, side])
        keys.append(np.repeat(chosen * len(index.terms), sizes) + term[at])
    keys = np.unique(np.concatenate(keys))
    at, sizes = _runs(index.block_starts, keys % len(index.terms))
    candidate = number[np.repeat(keys // len(index.terms), sizes), index.blocks[at]]
    reached = candidate >= 0
    at, sizes = _runs(index.block_items, at[reached])
    place = np.repeat(candidate[reached] * BLOCK_ITEMS, sizes) + index.items[at] % BLOCK_ITEMS
    scores = np.bincount(place, weights=index.impacts[at], minlength=len(passage) * BLOCK_ITEMS)
    over = np.flatnonzero(scores >= threshold)
    yield passage[over // BLOCK_ITEMS], block[over // BLOCK_ITEMS] * BLOCK_ITEMS + over % BLOCK_ITEMS, scores[over]


def _contained(part: np.ndarray, whole: np.ndarray) -> float:
    """The share of a part's shingles that a passage has."""
    return float(np.isin(part, whole).mean()) if len(part) else 0.0


def leaks(part: Words, index: Index, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> list[tuple[int, int, float, float, float]]:
    """(text, item, score, question overlap, answer overlap) of all leaks, the best passage of each pair."""
    hashes, offsets = part.hashes(lower=True), part.offsets
    who = np.repeat(np.arange(len(part.counts)), part.counts)
    n_stretches = -(-part.counts // index.stretch)
    first = np.cumsum(n_stretches) - n_stretches
    stretch = first[who] + (np.arange(len(hashes)) - offsets[who]) // index.stretch
    at = np.minimum(np.searchsorted(index.terms, hashes), len(index.terms) - 1)
    known = index.terms[at] == hashes
    pair = np.unique(stretch[known] * len(index.terms) + at[known])
    if not len(pair):
        return []
    starts = np.concatenate([np.arange(f, f + max(n - 1, 1)) for f, n in zip(first.tolist(), n_stretches.tolist(), strict=True) if n])
    text_of = np.repeat(np.arange(len(part.counts)), n_stretches)
    last = first + n_stretches - 1
    pairs = np.stack([starts, np.minimum(starts + 1, last[text_of[starts]])], axis=1)
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    found = retrieve(index, pair % len(index.terms), pair // len(index.terms), pairs, threshold)
    for passage, item, score in zip(*(x.tolist() for x in found), strict=True):
        text = int(text_of[pairs[passage, 0]])
        low = int(offsets[text] + (pairs[passage, 0] - first[text]) * index.stretch)
        own = hashes[low : min(low + 2 * index.stretch, int(offsets[text + 1]))]
        grams = [words.grams(own, size, size) for size in range(1, SHINGLE + 1)]
        there = np.concatenate(grams)
        whole, question, answer = (_contained(part_of, there) for part_of in index.parts[item])
        if whole >= overlap or (question >= overlap and answer >= overlap):
            best[text, item] = max(best.get((text, item), (0.0, 0.0, 0.0)), (score, question, answer))
    return [(text, item, *values) for (text, item), values in sorted(best.items())]


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per item and distinct term; the first of an item carries its length, the others 0."""
    for batch in batches:
        for text, shard in zip(batch.column("text").to_pylist(), batch.column("shard").to_pylist(), strict=True):
            hashes = _hashes(text) if text else np.zeros(0, dtype=_U)
            if len(hashes):
                terms = np.unique(hashes)
                length = np.zeros(len(terms), dtype=np.int64)
                length[0] = len(hashes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(terms), shard), pa.int32()), pa.array(terms.view(np.int64)), pa.array(length)],
                    names=["shard", "term", "length"],
                )


def indexes(items: DataFrame, key: str = "item_id", text: str = "text") -> list[Index]:
    """The indexes of all items, by shards of about SHARD_ITEMS at most."""
    held = items.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    shards = max(1, -(-held.count() // SHARD_ITEMS))
    if shards == 1:
        index = build([tuple(r) for r in held.orderBy("key", "text").collect()])
        return [index] if index else []
    path = scratch.folder(items.sparkSession)
    held = held.withColumn("shard", F.expr(f"cast(pmod(xxhash64(key, text), {shards}) as int)"))
    found = scratch.save(held.select("shard", "text").mapInArrow(_terms, "shard int, term long, length long"), f"{path}/terms")
    sizes = found.where("length > 0").agg(F.count("*"), F.avg("length"), F.max("length")).first()
    counted = found.groupBy("term").agg(F.count("*").alias("n"), F.collect_set("shard").alias("shards"))
    counted = scratch.save(counted.select("term", "n", F.explode("shards").alias("shard")), f"{path}/counted")
    out = []
    for shard in range(shards):
        rows = held.where(F.col("shard") == shard).select("key", "text").orderBy("key", "text").collect()
        told = counted.where(F.col("shard") == shard).select("term", "n").toArrow()
        terms = told["term"].to_numpy().view(_U)
        order = np.argsort(terms)
        index = build([tuple(r) for r in rows], Statistics(*sizes, terms[order], told["n"].to_numpy()[order]))
        if index:
            out.append(index)
    return out


def find(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """Leaks: the key, item_id, score, question_overlap, answer_overlap.

    One row per row of docs and item that leaks into it. Null and empty texts
    and items leak nothing; items that repeat are found each under its id. Rows
    of docs that repeat are each searched. Other columns are left out. The key
    may have any name but those of the other four columns.
    """
    held = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    names = [key, "item_id", "score", "question_overlap", "answer_overlap"]
    types = [held.schema["key"].dataType, items.schema["item_id"].dataType, *[DoubleType()] * 3]
    schema = StructType([StructField(name, kind) for name, kind in zip(names, types, strict=True)])
    out = docs.sparkSession.createDataFrame([], schema)
    for index in indexes(items):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in words.split(batch.column("text")):
                    found = leaks(part, index, threshold, overlap)
                    if found:
                        at, item, *values = zip(*found, strict=True)
                        keys = batch.column("key").take(pa.array([part.first + k for k in at]))
                        arrays = [keys, pa.array([index.ids[k] for k in item]), *[pa.array(v, pa.float64()) for v in values]]
                        yield pa.RecordBatch.from_arrays(arrays, names=names)

        out = out.union(held.mapInArrow(run, schema))
    return out


def clean(docs: DataFrame, items: DataFrame, text: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """The rows into which no item leaks, with their columns as they are."""
    for index in indexes(items):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in words.split(batch.column(text)):
                    keep = np.ones(len(part.counts), dtype=bool)
                    keep[[row[0] for row in leaks(part, index, threshold, overlap)]] = False
                    yield batch.slice(part.first, len(keep)).filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
