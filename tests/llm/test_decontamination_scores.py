"""Scores, threshold and both ways of overlap against BM25 worked out item by item."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest

from sensorlake.llm import decontaminate as d

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _grams(own, size):
    return {tuple(own[p : p + size]) for p in range(len(own) - size + 1)}


def _share(part, passage):
    size = min(d.SHINGLE, len(part))
    grams = _grams(part, size) if part else set()
    return len(grams & _grams(passage, size)) / len(grams) if grams else 0.0


def _brute(texts, items, threshold):
    cut = {i: WORD.findall(t.lower()) for i, t in items.items() if t and WORD.search(t)}
    mean = sum(map(len, cut.values())) / len(cut)
    stretch = max(32, max(map(len, cut.values())))
    frequency = Counter(w for own in cut.values() for w in set(own))
    impacts = {}
    for i, own in cut.items():
        weights = {}
        for w, c in Counter(own).items():
            idf = math.log(1 + (len(cut) - frequency[w] + 0.5) / (frequency[w] + 0.5))
            weights[w] = idf * c * (d.K1 + 1) / (c + d.K1 * (1 - d.B + d.B * len(own) / mean))
        impacts[i] = {w: x / sum(weights.values()) for w, x in weights.items()}
    best, retrieved = {}, 0
    for k, text in texts.items():
        own = WORD.findall((text or "").lower())
        pieces = range(0, max(len(own) - stretch, 1), stretch)
        for passage in (own[p : p + 2 * stretch] for p in pieces if own):
            have = set(passage)
            for i, weights in impacts.items():
                score = sum(x for w, x in weights.items() if w in have)
                assert abs(score - threshold) > 1e-9
                if score < threshold:
                    continue
                retrieved += 1
                end = items[i].rfind(". ") + 1
                parts = (items[i][:end], items[i][end:]) if end else (items[i], items[i])
                question, answer = (_share(WORD.findall(x.lower()), passage) for x in parts)
                if _share(cut[i], passage) >= d.OVERLAP or (question >= d.OVERLAP and answer >= d.OVERLAP):
                    best[k, i] = max(best.get((k, i), (0.0, 0.0, 0.0)), (score, question, answer))
    return best, retrieved


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.8])
def test_scores_equal_those_of_every_item(spark, threshold):
    rng = np.random.default_rng(21)
    vocabulary = [f"b{k}" for k in range(150)] + ["of", "the", "in"] * 15

    def some(n):
        return " ".join(rng.choice(vocabulary, n))

    items = {k: f"{some(int(rng.integers(6, 25)))}. {some(int(rng.integers(3, 9)))}" for k in range(60)}
    items |= {60: some(12), 61: items[4], 62: None, 63: " \n"}
    texts = {}
    for k in range(60):
        question, answer = items[k].split(". ")
        own = items[k].split()
        texts[k] = f"{some(40)} {items[k].upper()} {some(150)}"
        texts[100 + k] = f"{some(9)} {question}. {some(5)} {answer} {some(20)}"  # both parts, apart
        texts[200 + k] = f"{some(30)} {' '.join(own[: int(rng.integers(2, len(own)))])} {some(30)}"  # a beginning
        texts[300 + k] = some(int(rng.integers(1, 200)))
    texts |= {400: None, 401: "", 402: items[60], 403: " ".join(t for t in items.values() if t)}
    expected, retrieved = _brute(texts, items, threshold)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    found = {(r.doc_id, r.item_id): (r.score, r.question_overlap, r.answer_overlap) for r in d.find(docs, bench, threshold=threshold).collect()}
    assert set(found) == set(expected) and len(found) < retrieved
    for pair, values in expected.items():
        assert found[pair] == pytest.approx(values, abs=1e-9)
