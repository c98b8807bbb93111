"""Whitening against one pass of numpy over the listed rows."""

from __future__ import annotations

import math

import numpy as np
import pytest

from sensorlake.llm import queries, whitening

SF_DIR = "/root/testdata/sf0.001"


def _usable(v) -> bool:
    return v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) and abs(1024 * c) < 2**62 for c in v)


def _brute(vectors: list[list[float]], components: int = 8, distinct: bool = False) -> tuple:
    """n, exact sums, deviations, whitened, shares; over vectors of one length."""
    x = [[math.floor(1024 * c) + 100_000 for c in v] for v in vectors]
    fit = sorted(set(map(tuple, x))) if distinct else x
    n, total = len(fit), [sum(col) for col in zip(*fit, strict=True)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(v, total, strict=True)) for v in x]
    mean = np.array([s / n for s in total])
    centred = np.array(fit, dtype=np.float64) - mean
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    good = e > 1e-12 * max(e.max(), 0) if len(e) else []
    e, u = e[good], u[:, good]
    return n, deviation, (np.array(x, dtype=np.float64) - mean) @ u / np.sqrt(e), e / np.trace(cov)


def _agree(got: list, vectors: list, **options) -> None:
    n, deviation, white, share = _brute(vectors, **options)
    assert len(got) == len(vectors)
    found = np.array([r.whitened for r in got]).reshape(len(got), -1)
    assert found.shape == white.shape
    signs = np.sign((found * white).sum(axis=0))
    assert np.abs(found - white * signs).max(initial=0) < 1e-6
    assert [r.deviation for r in got] == [d if d < 2**63 else None for d in deviation]
    assert all(r.n == n and r.explained == pytest.approx(share.tolist(), rel=1e-6) and r.identity_error < 1e-6 for r in got)


def test_query_equals_numpy(spark):
    rows = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()
    rows = {r.vec_id: r.embedding for r in rows if _usable(r.embedding)}
    n, deviation, white, share = _brute(list(rows.values()))
    got: dict = {}
    for r in queries.op12_embedding_whitening(spark, SF_DIR).collect():
        got.setdefault(r.component, {})[r.vec_id] = r
    assert sorted(got) == list(range(1, 9))
    for k, by_id in got.items():
        assert by_id.keys() == rows.keys()
        found = np.array([by_id[v].whitened for v in rows])
        assert np.abs(found * np.sign(found @ white[:, k - 1]) - white[:, k - 1]).max() < 1e-6
        assert [by_id[v].deviation for v in rows] == deviation
        assert all(r.n == n and r.explained == pytest.approx(share[k - 1], rel=1e-9) and r.identity_error < 1e-9 for r in by_id.values())


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    pool = [rng.normal(size=5).tolist() for _ in range(40)]
    vectors: list = [pool[0]] * 300 + [pool[int(k)] for k in rng.integers(0, 40, 200)]
    odd = [None, [], [1.0, None, 2.0, 3.0, 4.0], [float("nan")] * 5, [float("inf"), 0.0, 0.0, 0.0, 0.0], [1e300] * 5, [1.0, 2.0], [None] * 5]
    table = [(k, v, "kept", 7) for k, v in enumerate(vectors + odd)] + [(None, pool[3], None, None), (0, pool[0], "kept", 7)]
    docs = spark.createDataFrame(table, "vec_id long, embedding array<double>, x string, n int")
    done = whitening.whiten(docs)
    assert done.columns == ["vec_id", "embedding", "x", *whitening.RESULTS]
    got = done.collect()
    _agree(got, [r.embedding for r in got])
    assert sorted(str(r.vec_id) for r in got) == sorted(map(str, [*range(500), None, 0]))
    assert {r.x for r in got} == {"kept", None}
    distinct = whitening.whiten(docs, weighted=False, components=2).collect()
    _agree(distinct, [r.embedding for r in distinct], components=2, distinct=True)
    assert distinct[0].n == len({tuple(r.embedding) for r in got})


def test_few_rows(spark):
    one = spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5, 0.25])], "vec_id long, embedding array<float>")
    got = whitening.whiten(one).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got] == [(2, 0, [], [], 0.0)] * 2
    assert whitening.whiten(one.where("vec_id > 5")).collect() == []
    assert whitening.whiten(one.where("vec_id > 5")).columns == ["vec_id", "embedding", *whitening.RESULTS]
    line = spark.createDataFrame([(k, [float(k), 2.0 * k]) for k in range(9)], "vec_id long, embedding array<double>")
    _agree(whitening.whiten(line).collect(), [[float(k), 2.0 * k] for k in range(9)])


def test_large_entries_are_exact(spark):
    rng = np.random.default_rng(6)
    vectors = [[float(c) for c in rng.integers(-(2**40), 2**40, 3)] for _ in range(50)]
    table = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").coalesce(1)
    got = whitening.whiten(table).collect()
    _agree(got, [r.embedding for r in got])
    assert all(r.deviation is None for r in got)
    assert whitening._deviations(np.array([[2**40, 3], [5, -(2**20)]]), 3, [2**41, 7]) == [
        (3 * a - 2**41) ** 2 + (3 * b - 7) ** 2 if (3 * a - 2**41) ** 2 + (3 * b - 7) ** 2 < 2**63 else None
        for a, b in ((2**40, 3), (5, -(2**20)))
    ]
