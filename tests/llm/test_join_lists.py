"""Lists of first shingles are long enough for every pair of sizes."""

from __future__ import annotations

import numpy as np

from sensorlake.llm import ngram_join


def test_no_linked_pair_pushes_shingles_off_a_list():
    for n in range(1, 400):
        m = np.arange(-(-4 * n // 5), 5 * n // 4 + 1)
        common = -(-4 * (n + m) // 9)  # the fewest of a linked pair
        linked = common <= np.minimum(n, m)
        lost = ngram_join.listed(np.array(n)) - ngram_join.listed(m) + m - common
        assert (lost[linked] <= n // 5).all(), n


def test_short_texts_with_words_added_are_linked(spark):
    """Every pair has shingles of its own; one in twenty was lost where lists were one too short."""
    texts = {}
    for k in range(300):
        length = (13, 6, 10, 18)[k % 4] if k >= 200 else 13
        own = [f"p{k}w{i}" for i in range(length)]
        texts[2 * k], texts[2 * k + 1] = " ".join(own), " ".join([*own, f"p{k}x", f"p{k}y"])
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sets = {k: {tuple(t.split()[p : p + 5]) for p in range(len(t.split()) - 4)} for k, t in texts.items()}
    expected = {}
    for k in texts:
        a, b = sets[k - k % 2], sets[k - k % 2 + 1]
        expected[k] = k - k % 2 if 100 * len(a & b) >= 80 * len(a | b) else k
    assert {r.doc_id: r.component_id for r in ngram_join.join(table).collect()} == expected
