"""Periodic runs against a search over all periods."""

from __future__ import annotations

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from sensorlake.llm import periodic_runs, queries

SF_DIR = "/root/testdata/sf0.001"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _brute(w: list) -> list[tuple[int, int, int]]:
    found = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            size = j + q - i
            if size >= max(6, 4 * q) and not any(
                all(w[x] == w[x + d] for x in range(i, i + size - d)) for d in range(1, q)
            ):
                found.append((i, size, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def _expected(doc_id: int | None, text: str | None) -> tuple:
    own = _WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and own:
        g, n = h // 10, len(own)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        own = [own[i] if i < a else own[a + (i - a) % p] for i in range(n)]
    runs = _brute(own)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    kept = " ".join(x for i, x in enumerate(own) if i not in gone)
    listed = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    first = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (len(runs), *first, *(hashlib.sha256(x.encode()).hexdigest() for x in (listed, kept)))


def _stretches(rng: np.random.Generator) -> list[int]:
    kind, n = int(rng.integers(4)), int(rng.integers(0, 120))
    if kind == 0:
        return rng.integers(0, 2, n).tolist()
    if kind == 1:
        return np.resize(rng.integers(0, 3, int(rng.integers(1, 20))), n).tolist()
    if kind == 2:
        out: list[int] = []
        while len(out) < n:
            out += np.resize(rng.integers(0, 2, int(rng.integers(1, 9))), int(rng.integers(1, 60))).tolist()
        return out
    long = np.resize(rng.integers(0, 2, int(rng.integers(1, 4))), int(rng.integers(2, 25))).tolist()
    out = np.resize([*long, 0, 1], n).tolist()
    if n and rng.random() < 0.5:
        out[int(rng.integers(n))] = 7
    return out


def test_runs_equal_those_of_a_search_over_all_periods():
    rng, seen = np.random.default_rng(1), 0
    for _ in range(400):
        texts = [_stretches(rng) for _ in range(int(rng.integers(1, 6)))]
        bounds = np.cumsum([0, *map(len, texts)])
        ids = np.array([1000 * k + x for k, text in enumerate(texts) for x in text], dtype=np.uint64)
        got = list(zip(*(x.tolist() for x in periodic_runs.find(ids, bounds)), strict=True))
        assert got == [(bounds[k] + s, size, q) for k, text in enumerate(texts) for s, size, q in _brute(text)], texts
        seen += len(got)
    assert seen > 1000


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000])
def test_wavelet_tree_counts_and_selects(n):
    rng = np.random.default_rng(n)
    values = rng.integers(0, max(1, n // 3), n)
    tree = periodic_runs.WaveletTree(values)
    low = rng.integers(0, n + 1, 200)
    high = rng.integers(low, n + 1)
    bound = rng.integers(0, n + 3, 200)
    counts = tree.below(low, high, bound)
    assert counts.tolist() == [(values[a:b] < x).sum() for a, b, x in zip(low, high, bound, strict=True)]
    some = np.flatnonzero(high > low)
    k = rng.integers(0, (high - low)[some])
    got = tree.smallest(low[some], high[some], k)
    assert got.tolist() == [np.sort(values[a:b])[x] for a, b, x in zip(low[some], high[some], k, strict=True)]


def test_each_period_has_one_level():
    levels = {q: k for k in range(1, 12) for q in range(periodic_runs.nearest(k), periodic_runs.farthest(k) + 1)}
    assert sorted(levels) == list(range(1, max(levels) + 1))
    # an aligned block among the first words of a run, and its copy, lie within four periods
    assert all(2 * 2**k - 1 + q <= 4 * q for q, k in levels.items())


def test_query_equals_brute_force_on_every_document(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in queries.op13_periodic_runs(spark, SF_DIR).collect()}
    short = [r for r in rows if len(r.text or "") < 20_000]
    assert len(got) == len(rows) and len(short) > 150
    for r in short:
        assert got[r.doc_id] == _expected(r.doc_id, r.text), r.doc_id


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    texts = [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "\x0b" + "b c " * 9, "é x " * 4 + "é x", "ha " * 5000]
    texts += [" ".join(f"w{x}" for x in _stretches(rng)) for _ in range(150)]
    texts += [" ".join(f"w{x}" for x in rng.integers(0, 5000, 30_000)) + " x y z" * 7]
    table = [(k, t, 1.5, "kept", "old") for k, t in enumerate(texts)] + [(None, texts[5], None, None, None), (5, texts[5], 1.5, "kept", "old")]
    docs = spark.createDataFrame(table, "doc_id long, text string, period double, row string, _text string")
    found = periodic_runs.detect(docs, key="doc_id", arrange=periodic_runs.planted)
    assert found.columns == ["doc_id", "text", "row", "_text", *periodic_runs.RESULTS.fieldNames()]
    rows = found.collect()
    assert len(rows) == len(table)
    for r in rows:
        assert (r.row, r._text) == (("kept", "old") if r.doc_id is not None else (None, None))
        runs = [tuple(x) for x in r.runs]
        listed = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
        digests = tuple(hashlib.sha256(x.encode()).hexdigest() for x in (listed, r.collapsed))
        got = (r.n_runs, r.start, r.length, r.period, r.exponent_milli, *digests)
        if r.doc_id is None or len(r.text or "") < 20_000:
            assert got == _expected(r.doc_id, r.text), r.doc_id
    plain = periodic_runs.detect(docs.where("doc_id = 8")).first()
    assert (plain.n_runs, plain.length, plain.period, plain.collapsed) == (1, 5000, 1, "ha")
    assert periodic_runs.detect(docs.where("false")).collect() == []
    last = periodic_runs.detect(docs.where(f"doc_id = {len(texts) - 1}")).first()
    assert (last.start, last.length, last.period) == (30_000, 21, 3)
