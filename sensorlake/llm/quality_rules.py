"""Quality rules as a short-circuit cascade.

Each rule rejects documents by a count over their text. On a sample, a few rows of
each partition, the cost (CPU seconds) and the share of rejections of each rule
are measured where the rows lie; rules then run in the order of rejections per
cost, and a rule sees only the documents that all rules before it let pass. A document is kept if no rule rejects it, so
the order changes the time and never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorlake.llm import blocks, words
from sensorlake.llm.words import Words

#: Rows of a partition on which costs and rejections are estimated, and bytes of their texts.
SAMPLE_ROWS = 128
SAMPLE_BYTES = 1 << 20
REPEAT = 5


def _table(characters: str) -> np.ndarray:
    out = np.zeros(256, dtype=np.int64)
    out[list(characters.encode())] = 1
    return out


_SYMBOLS = _table("#*$%&|<>")
_CRIES = _table("!?")
_UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LOWER = _table("abcdefghijklmnopqrstuvwxyz")


def symbols(part: Words) -> np.ndarray:
    """Characters of ``#*$%&|<>`` in each text."""
    return part.bytes_in(_SYMBOLS)


def duplicate_lines(part: Words) -> np.ndarray:
    """Lines of each text that have a word and are equal to an earlier line."""
    out, data = np.zeros(len(part.counts), dtype=np.int64), part.data.tobytes()
    for k, (low, high) in enumerate(zip(part.text_starts.tolist(), part.text_ends.tolist(), strict=True)):
        lines = data[low:high].split(b"\n")
        if len(set(lines)) < len(lines):
            seen: set[bytes] = set()
            for line in lines:
                if line.strip(b" \t\n\x0b\x0c\r"):
                    out[k] += line in seen
                    seen.add(line)
    return out


def repeated_words(part: Words, size: int = REPEAT) -> np.ndarray:
    """Words of each text that lie in windows of ``size`` words found twice or more in it."""
    hashes, offsets = part.hashes(), part.offsets
    who = np.repeat(np.arange(len(part.counts)), part.counts)
    at = np.flatnonzero(np.arange(len(hashes)) + size <= offsets[1:][who])
    own = words.mix(words.grams(hashes, size, 7)[at] ^ words.mix(who[at].astype(np.uint64) + np.uint64(1)))
    order, number = blocks.groups(own)
    twice = np.zeros(len(own), dtype=bool)
    twice[order] = np.bincount(number)[number] > 1 if len(own) else False
    edge = np.zeros(len(hashes) + 1, dtype=np.int64)
    starts = at[twice]
    edge[starts] += 1
    np.subtract.at(edge, starts + size, 1)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(edge[:-1]) > 0)))
    return np.diff(covered[offsets])


def _per_text(part: Words, marked: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(marked)))[part.offsets])


def _lines(part: Words) -> np.ndarray:
    return part.bytes_in(_table("\n")) + 1


def _shouted(part: Words) -> np.ndarray:
    """Words with two capitals or more and no small letter, by text."""
    return _per_text(part, (part.bytes_in(_UPPER, words=True) > 1) & (part.bytes_in(_LOWER, words=True) == 0))


@dataclass(frozen=True)
class Rule:
    """count: a number of each text of a part; rejects: whether a text goes, by its count."""

    name: str
    count: Callable[[Words], np.ndarray]
    rejects: Callable[[np.ndarray, Words], np.ndarray]


#: Every text of fewer words, or with more than this share of repeated ones, fails the base.
BASE = (
    Rule("n_words", lambda p: p.counts, lambda n, p: n < 10),
    Rule("n_repeat_words", repeated_words, lambda n, p: 100 * n > 20 * p.counts),
)
FURTHER = (
    Rule("n_symbols", symbols, lambda n, p: 10 * n > p.counts),
    Rule("n_dup_lines", duplicate_lines, lambda n, p: 2 * n > _lines(p)),
    Rule("shouted", _shouted, lambda n, p: 2 * n > p.counts),
    Rule("cries", lambda p: p.bytes_in(_CRIES), lambda n, p: 2 * n > p.counts),
    Rule("word_chars", lambda p: p.code_points(), lambda n, p: (n < 2 * p.counts) | (n > 20 * p.counts)),
)
RULES = BASE + FURTHER


def cascade(
    part: Words, rules: tuple[Rule, ...], alive: np.ndarray | None = None, known: dict[str, np.ndarray] | None = None
) -> np.ndarray:
    """Whether each text passes all rules; texts that are not alive are not looked at.

    known: counts by name that are there already and are not made again.
    """
    left = np.arange(len(part.counts)) if alive is None else np.flatnonzero(alive)
    for rule in rules:
        if not len(left):
            break
        own = part.take(left)
        counts = known[rule.name][left] if known and rule.name in known else rule.count(own)
        left = left[~rule.rejects(counts, own)]
    out = np.zeros(len(part.counts), dtype=bool)
    out[left] = True
    return out


def ordered(docs: DataFrame, text: str, rules: tuple[Rule, ...], rows: int = SAMPLE_ROWS, known: tuple[str, ...] = ()) -> tuple[Rule, ...]:
    """The rules by rejections per CPU second, as measured on the first ``rows`` rows of each partition of docs.

    A task looks at its first batch of rows and leaves the rest unread; a row per
    rule and task is what it sends on. known: counts that cost a rule nothing.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, lost = np.zeros(len(rules)), np.zeros(len(rules))
        for batch in batches:
            _, places = words.utf8(batch.column(0).slice(0, rows))
            fit = max(1, int(np.searchsorted(places, SAMPLE_BYTES, side="right")) - 1)
            for part in words.split(batch.column(0).slice(0, min(rows, fit))):
                for k, rule in enumerate(rules):
                    counts = rule.count(part) if rule.name in known else None
                    begun = time.thread_time()
                    counts = rule.count(part) if counts is None else counts
                    lost[k] += rule.rejects(counts, part).sum()
                    spent[k] += time.thread_time() - begun
            break
        yield pa.RecordBatch.from_pydict({"rule": np.arange(len(rules)), "spent": spent, "lost": lost})

    sample = docs.select(F.col(f"`{text}`").alias("text"))
    found = sample.mapInArrow(measure, "rule long, spent double, lost double").groupBy("rule").agg(F.sum("spent"), F.sum("lost"))
    rate = {k: lost / max(spent, 1e-9) for k, spent, lost in found.collect()}
    return tuple(rules[k] for k in sorted(range(len(rules)), key=lambda k: (-rate.get(k, 0.0), k)))


_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = FURTHER) -> DataFrame:
    """Every row with its columns, the counts of its text, base_failed and kept.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long),
    base_failed (fewer than ten words, or over a fifth of them in repeated
    windows) and kept (the base held and no rule of the cascade rejects).
    A null or empty text has no words and fails the base. Each row is judged
    alone, so repeated rows get equal verdicts. Columns of the input that are
    called like a result are replaced by it.
    """
    names = [f for f in docs.schema.fields if f.name not in (*_MEASURES, "base_failed", "kept")]
    docs = docs.select(*[F.col(f"`{f.name}`") for f in names])
    order = ordered(docs, text, rules, known=_MEASURES)
    schema = T.StructType(
        [*names, *[T.StructField(m, T.LongType()) for m in _MEASURES], T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.split(batch.column(text)):
                counts = {rule.name: rule.count(part) for rule in RULES if rule.name in _MEASURES}
                base = cascade(part, BASE, known=counts)
                kept = cascade(part, order, base, counts)
                out = batch.slice(part.first, len(part.counts))
                arrays = [*out.columns, *[pa.array(counts[m], pa.int64()) for m in _MEASURES], pa.array(~base), pa.array(kept)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*out.schema.names, *_MEASURES, "base_failed", "kept"])

    return docs.mapInArrow(run, schema)


def keep(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that no rule rejects, with their columns as they are.

    The same verdicts as ``measure`` gives; counts that no rule asks for are not made.
    """
    order = ordered(docs, text, rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.split(batch.column(text)):
                yield batch.slice(part.first, len(part.counts)).filter(pa.array(cascade(part, order)))

    return docs.mapInArrow(run, docs.schema)
