"""Exact dedup against grouping by bytes, with keys that collide and groups of every size."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pytest

from sensorlake.llm import exact_dedup

SPACES = " \t\n\x0b\x0c\r"


def _bare(text: str | None) -> str:
    return (text or "").translate({ord(c): None for c in SPACES})


def _check(got: list, table: list[tuple]) -> None:
    groups: dict[str, list] = defaultdict(list)
    for key, text, *_ in table:
        groups[_bare(text)].append((-len(text or ""), key is None, key or 0, key))
    assert len(got) == len(table)
    kept: dict[str, int] = defaultdict(int)
    for r in got:
        bare = _bare(r.text)
        best = min(groups[bare], key=lambda g: g[:3])
        assert (r.keep_id, r.group_size) == (best[3], len(groups[bare])), r
        assert r.text_sha256 == hashlib.sha256(bare.encode()).hexdigest()
        assert not r.kept or (r.doc_id, len(r.text or "")) == (best[3], -best[0])
        kept[bare] += r.kept
    assert all(kept[bare] == 1 for bare in groups)


def _rows(seed: int, n: int = 600) -> list[tuple]:
    rng = np.random.default_rng(seed)
    pool = ["".join(rng.choice(list("abcé 漢\n\t"), int(rng.integers(0, 40)))) for _ in range(120)]
    hot = "the hot text that a third of all rows hold"
    rows = []
    for k in range(n):
        text = pool[int(rng.integers(0, len(pool)))]
        if rng.random() < 0.33:
            text = hot
        if rng.random() < 0.5:
            text = text.replace(" ", SPACES[int(rng.integers(0, 6))] * int(rng.integers(0, 3)))
        rows.append((int(rng.integers(0, 500)), text))
    return rows + [(None, hot), (None, ""), (3, None), (4, ""), (5, " \t\n"), (6, "x" * 300_000), (7, "x " * 300_000), (7, "x " * 300_000)]


@pytest.mark.parametrize(
    ("hashed", "keys", "size"),
    [
        (exact_dedup.text_key, exact_dedup.BUCKET_KEYS, exact_dedup.BUCKET_BYTES),
        (exact_dedup.text_key, 16, 2000),  # many buckets, several owners for the hot text
        (lambda body: (len(body) % 3) << 62, 16, 2000),  # nearly all texts collide
        (lambda body: 7, 4, 500),
    ],
)
def test_groups_of_equal_texts(spark, hashed, keys, size):
    table = _rows(keys)
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(7)
    _check(exact_dedup.dedup(docs, hashed=hashed, bucket_keys=keys, bucket_bytes=size).collect(), table)


def test_clashing_columns_and_no_rows(spark):
    table = [(1, "a b", True, "q"), (2, "ab", None, None), (2, "ab", None, None)]
    docs = spark.createDataFrame(table, "doc_id int, text string, kept boolean, block string")
    done = exact_dedup.dedup(docs)
    assert done.columns == ["doc_id", "text", "block", "keep_id", "group_size", "kept", "text_sha256"]
    got = done.collect()
    assert sorted((r.doc_id, r.block, r.keep_id, r.group_size, r.kept) for r in got if r.block) == [(1, "q", 1, 3, True)]
    assert [(r.keep_id, r.kept) for r in got if not r.block] == [(1, False)] * 2
    assert exact_dedup.dedup(docs.where("doc_id > 5")).collect() == []
    with pytest.raises(ValueError, match="whole numbers"):
        exact_dedup.dedup(docs, key="block")


def test_the_directory_doubles_until_buckets_fit():
    rng = np.random.default_rng(2)
    for _ in range(50):
        depth = int(rng.integers(0, 9))
        weights = rng.integers(0, 20, 1 << depth) * (rng.random(1 << depth) < 0.5)
        weights[int(rng.integers(0, 1 << depth))] = 500
        directory, held = exact_dedup.grown(weights, 60)
        prefixes = np.arange(1 << depth)
        keys = (prefixes << (64 - depth) if depth else prefixes).astype(np.uint64)
        buckets = directory.of(keys)
        assert (np.diff(buckets) >= 0).all() and len(directory.buckets) == 1 << directory.depth
        assert held.tolist() == np.bincount(buckets, weights=weights, minlength=len(held)).tolist()
        for bucket, total in enumerate(held):
            assert total <= 60 or (buckets == bucket).sum() == 1
        later, more = exact_dedup.grown(rng.integers(0, 3, 1 << depth), 60, directory)
        own = later.of(keys)
        assert all(len(set(buckets[own == b])) == 1 for b in range(len(more)))
    # a bucket splits only on the bits it needs
    weights = np.zeros(16, dtype=np.int64)
    weights[:2] = 50
    directory, held = exact_dedup.grown(weights, 60)
    assert directory.depth == 4 and held.tolist() == [50, 50, 0, 0, 0]
