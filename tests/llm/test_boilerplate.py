"""Texts that share much of their words without being near copies."""

from __future__ import annotations

import numpy as np

from sensorlake.llm import ngram_join


def _notice(rng, n, shared, own):
    notice = [f"n{k}" for k in range(shared)]
    return [" ".join([*notice, *(f"w{x}" for x in rng.integers(0, 10**9, own))]) for _ in range(n)]


def _expected(texts):
    sets = []
    for text in texts:
        w = text.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    holders: dict = {}
    for k, own in enumerate(sets):
        for s in own:
            holders.setdefault(s, []).append(k)
    for k, own in enumerate(sets):
        counts: dict = {}
        for s in own:
            for other in holders[s]:
                if other < k:
                    counts[other] = counts.get(other, 0) + 1
        for other, both in counts.items():
            if 100 * both >= 80 * (len(own) + len(sets[other]) - both):
                a, b = top(k), top(other)
                root[max(a, b)] = min(a, b)
    return [(k, len(s), top(k)) for k, s in enumerate(sets)]


def test_components_among_notices_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CROWD", 12)
    rng = np.random.default_rng(7)
    texts = _notice(rng, 150, 34, 20) + _notice(rng, 60, 70, 12) + _notice(rng, 60, 40, 9)
    near = []
    for k in rng.integers(0, len(texts), 120):  # copies with a word or two changed
        w = texts[k].split()
        for _ in range(int(rng.integers(0, 3))):
            w[int(rng.integers(0, len(w)))] = f"x{rng.integers(0, 50)}"
        near.append(" ".join(w))
    texts += near + [" ".join(f"n{k}" for k in range(34))] * 20 + ["", "n1 n2"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = sorted(tuple(r) for r in ngram_join.join(rows).collect())
    assert got == _expected(texts)
    assert len({c for _, _, c in got}) < len(texts) - 50


def test_regions_of_notices_stay_small(spark, monkeypatch):
    rng = np.random.default_rng(9)
    texts = _notice(rng, 2000, 34, 20)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    sizes, apart = [], ngram_join._apart

    def seen(members, *rest):
        sizes.append(members.groupBy("region").count().agg({"count": "max"}).first()[0] or 0)
        return apart(members, *rest)

    monkeypatch.setattr(ngram_join, "_apart", seen)
    _, _, roots = ngram_join._resolved(rows, "text")
    assert roots.count() == 0 and sizes[0] < 10
    monkeypatch.setattr(ngram_join, "CROWD", 10**9)
    ngram_join._resolved(rows, "text")
    assert sizes[1] > 1000
