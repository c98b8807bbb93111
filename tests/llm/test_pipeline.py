"""The pipeline, stage by stage, against brute force on small tables."""

from __future__ import annotations

import collections
import math
import zlib

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sensorlake.llm import quality_rules
from tests.llm.test_llm import SCHEMA, WORD, WORD_FILE, _components, _texts


def _prose(rng, n: int) -> str:
    names = ["river", "stone", "garden", "window", "market", "letter", "winter", "bridge", "morning", "captain"]
    tails = ["", "s", "ing", "ed", "er", "ly", "ish", "less", "ful", "ward"]
    small = ["the", "of", "and", "to", "in", "that", "with", "a", "is", "for"]
    own = [rng.choice(small) if rng.random() < 0.4 else rng.choice(names) + rng.choice(tails) for _ in range(n)]
    return "".join(w + (". " if k % 11 == 10 else " ") for k, w in enumerate(own))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = np.random.default_rng(21)
    items = [_prose(rng, 30) + "\n" + _prose(rng, 9) for _ in range(12)]
    clean = [_prose(rng, 120) for _ in range(40)]
    near = [" ".join("changed" if p == 7 * k else w for p, w in enumerate(t.split())) for k, t in enumerate(clean[:6])]
    leaked = [f"{_prose(rng, 80)}\n{items[k]}\n{_prose(rng, 60)}" for k in range(4)]
    texts = [*clean, *near, *clean[10:14], *([clean[20]] * 5), *leaked, *_texts()]
    rows = [(k, t, "en", (None, "web", "book", "web", "web")[k % 5], k) for k, t in enumerate(texts)]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    bench = [*enumerate(items), (50, None), (51, "")]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, [t for _, t in bench]


def _leaks(text: str | None, items: list[str | None]) -> bool:
    own = WORD.findall((text or "").lower())
    have = {tuple(own[p : p + 5]) for p in range(len(own) - 4)}
    cut = [WORD.findall((t or "").lower()) for t in items]
    grams = [{tuple(c[p : p + 5]) for p in range(len(c) - 4)} for c in cut]
    return any(g and len(g & have) >= 0.8 * len(g) for g in grams)


def _targets(sizes: dict) -> dict:
    """Of each source: shares by weight, what is above three times its size shared again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    fixed: dict = {}
    while True:
        free = [s for s in order if s not in fixed]
        left, total = sum(sizes.values()) - sum(fixed.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 3 * sizes[s]]
        if not over:
            return fixed | {s: left * weight[s] / total for s in free}
        fixed |= {s: 3 * sizes[s] for s in over}


def test_pipeline(spark, tables):
    folder, items = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    outputs = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, folder)
        assert docs.columns == before.columns
        docs = docs.checkpoint()
        outputs.append((before.collect(), docs.collect()))

    given, kept = outputs[0]
    verdicts = {r.doc_id: r.kept for r in quality_rules.measure(spark.createDataFrame(given, SCHEMA)).collect()}
    assert sorted(r.doc_id for r in kept) == sorted(k for k, v in verdicts.items() if v)
    assert not any(len(WORD.findall(r.text or "")) < 10 for r in kept)
    assert set(range(59)) <= {r.doc_id for r in kept}  # prose written for this test, copies and leaks among it

    given, kept = outputs[1]
    root = _components({r.doc_id: r.text for r in given})[1]
    assert sorted(r.doc_id for r in kept) == sorted(set(root.values()))
    assert len(kept) < len(given) - 9

    given, kept = outputs[2]
    assert sorted(r.doc_id for r in kept) == sorted(r.doc_id for r in given if not _leaks(r.text, items))
    assert len(kept) == len(given) - 4

    given, kept = outputs[3]
    size = {r.doc_id: len(WORD.findall(r.text)) for r in given}
    sizes = collections.Counter()
    for r in given:
        sizes[r.source] += size[r.doc_id]
    wanted = _targets(sizes)
    taken = collections.Counter(r.doc_id for r in kept)
    for r in given:
        rate = wanted[r.source] / sizes[r.source]
        assert math.floor(rate) <= taken[r.doc_id] <= math.ceil(rate) <= 3
    assert len(set(kept)) == len(taken)

    tokenizer = Tokenizer.from_file(WORD_FILE)
    start, expected = 0, []
    for r in sorted(kept, key=lambda r: r.doc_id):
        ids = [*tokenizer.encode(r.text, add_special_tokens=False).ids, 2]
        expected.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    result = corpus_pipeline.run(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted(map(tuple, result.collect())) == expected


def test_pipeline_of_an_empty_table(spark, tables, tmp_path):
    spark.read.parquet(f"{tables[0]}/documents.parquet").where(F.lit(False)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{tables[0]}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
