"""Results do not depend on the shards of the benchmark."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from sensorlake.llm import decontaminate, words


def test_shards_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(6)
    vocabulary = [f"b{k}" for k in range(300)] + ["of", "the", "in"] * 30
    items = [" ".join(rng.choice(vocabulary, int(rng.integers(8, 30)))) + ". " + " ".join(rng.choice(vocabulary, 9)) for _ in range(40)]
    items.append(" ".join(f"long{k}" for k in range(400)))  # its shard alone had long passages
    prose = [" ".join(f"p{rng.integers(0, 5000)}" for _ in range(150)) for _ in range(40)]
    texts = {k: f"{t} {items[k]} {t}" for k, t in enumerate(prose)}
    for k, t in enumerate(prose):  # question and answer apart
        question, answer = items[k].split(". ")
        texts[100 + k] = f"{question}. {t} {answer} {t}"
    texts[200] = prose[0]  # no item
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, "")], "item_id long, text string")

    def results():
        found = {(r.doc_id, r.item_id): (round(r.score, 9), r.question_overlap, r.answer_overlap) for r in decontaminate.find(table, bench).collect()}
        return found, {r.doc_id for r in decontaminate.clean(table, bench).collect()}

    one = results()
    assert len(one[0]) >= 80 and one[1] == {200}
    monkeypatch.setattr(decontaminate, "SHARD_ITEMS", 11)
    assert results() == one


@pytest.mark.parametrize("cells", [1, 60, 1000])
@pytest.mark.parametrize("block", [1, 3, 8])
def test_slices_and_blocks_change_nothing(monkeypatch, cells, block):
    rng = np.random.default_rng(9)
    vocabulary = [f"b{k}" for k in range(120)] + ["of", "the", "in"] * 15
    items = [" ".join(rng.choice(vocabulary, int(rng.integers(8, 30)))) for _ in range(50)]
    texts = [None, "", items[7], " ".join(items)]
    texts += [" ".join([*rng.choice(vocabulary, int(rng.integers(1, 300))), items[k], *rng.choice(vocabulary, 70)]) for k in range(50)]

    def results():
        index = decontaminate.build(list(enumerate(items)))
        return [row for part in words.split(pa.array(texts)) for row in decontaminate.leaks(part, index, threshold=0.3)]

    whole = results()
    assert len(whole) >= 100
    monkeypatch.setattr(decontaminate, "CELLS", cells)
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", block)
    assert [row[:2] for row in results()] == [row[:2] for row in whole]
    assert np.allclose(results(), whole, rtol=0, atol=1e-12)


def test_a_key_of_any_name(spark):
    table = spark.createDataFrame([(1, "Which of these is it. The seventh one.")], "`doc id` long, text string")
    bench = spark.createDataFrame([(5, "which of these is it. the seventh one.")], "item_id long, text string")
    (row,) = decontaminate.find(table, bench, key="doc id").collect()
    assert (row["doc id"], row["item_id"]) == (1, 5)
