"""Licences wrapped over lines inside longer documents."""

from __future__ import annotations

import re
import textwrap

import numpy as np
import pytest

from sensorlake.llm import license_scan


def _pairs(text: str) -> set:
    words = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    return set(zip(words, words[1:], strict=False))


def _prose(seed: int, lines: int) -> list[str]:
    rng = np.random.default_rng(seed)
    return [" ".join(f"{x}{rng.integers(0, 9999)}" for x in "abcdefgh") for _ in range(lines)]


def _texts() -> dict[int, tuple[str, str | None, int]]:
    apache, mit, gpl = (license_scan.TEMPLATES[k][1] for k in (5, 3, 7))
    out = {}
    for k, (name, body, width) in enumerate([("Apache-2.0", apache, 75), ("MIT", mit, 60), ("GPL-3.0", gpl, 40), ("MIT", mit, 20)]):
        wrapped = textwrap.wrap(" ".join(body.split()), width)
        out[k] = ("\n".join([*_prose(k, 3), "", *wrapped, *_prose(k + 50, 40)]), name, 4)
        out[10 + k] = ("\n".join(["x = 1", *(f"# {w}" for w in wrapped), "", *_prose(k + 90, 40)]), name, 1)
    out[20] = ("\n".join([*_prose(7, 4), "Licensed under the", "Apache License, Version 2.0.", *_prose(8, 3)]), "Apache-2.0", 4)
    out[30] = ("\n".join([*_prose(9, 30), *textwrap.wrap(" ".join(mit.split()), 70)[:3], *_prose(10, 5)]), None, 0)
    return out


def test_wrapped_licences_in_longer_documents(spark):
    texts = _texts()
    rows = [(k, t) for k, (t, _, _) in texts.items()]
    table = spark.createDataFrame([*rows, (None, texts[0][0]), rows[0]], "doc_id long, text string")
    got = license_scan.scan(table).where("unit <= -2").collect()
    expected = [(k, name, -2 - line) for k, (_, name, line) in texts.items() if name] + [(None, "Apache-2.0", -6)]
    assert sorted(map(str, expected)) == sorted(str((r.doc_id, r.license_id, r.unit)) for r in got)
    assert all(r.dice > 0.95 for r in got if r.doc_id not in (3, 13))


def test_every_run_that_matches_is_near_one_that_is_found(spark):
    rng = np.random.default_rng(4)
    pool = [*_prose(1, 3), "", "a", "released under", "the mit license", "licensed under the mit license", "under the", "mit license project", "licensed"]
    texts = {k: "\n".join(rng.choice(pool, int(rng.integers(2, 9)))) for k in range(120)}
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    known = [(name, _pairs(t)) for name, t in license_scan.TEMPLATES]
    got: dict = {}
    for r in license_scan.scan(table).collect():
        got.setdefault(r.doc_id, []).append((r.unit, r.license_id, r.n_common, r.n_bigrams, r.dice))
    seen = 0
    for k, text in texts.items():
        lines = text.split("\n")
        matches = {}
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                own = _pairs("\n".join(lines[a : b + 1]))
                for name, other in known:
                    dice = 2 * len(own & other) / (len(own) + len(other))
                    if dice >= 0.8:
                        matches.setdefault(name, []).append((dice, len(own & other), len(own), a))
        found = got.get(k, [])
        assert {f[1] for f in found} <= set(matches), k
        for name, each in matches.items():
            seen += 1
            assert max(f[4] for f in found if f[1] == name) == pytest.approx(max(each)[0]), k
        for unit, name, common, size, dice in found:
            if unit <= license_scan.RUN:
                assert any(m[1:3] == (common, size) and m[3] == -2 - unit for m in matches[name])
    assert seen > 20


def test_wrapped_and_edited_licences_against_all_runs(spark):
    """Every template but the longest, wrapped, with lines lost, doubled or changed, among prose with common words."""
    rng = np.random.default_rng(8)
    known = [(name, _pairs(text), text) for name, text in license_scan.LICENCES if len(_pairs(text)) < 250]
    texts = {}
    for k, (_, _, text) in enumerate(known):
        lines = textwrap.wrap(" ".join(text.split()), int(rng.integers(25, 90)))
        for _ in range(int(rng.integers(0, 1 + len(lines) // 5))):
            at = int(rng.integers(0, len(lines)))
            lines[at : at + 1] = [[], [lines[at]] * 2, [lines[at].replace("the", "a")]][int(rng.integers(0, 3))]
        before = [*_prose(k, int(rng.integers(0, 4))), "the software is provided in any form", ""]
        after = ["copy of the license", *_prose(k + 60, int(rng.integers(0, 4)))]
        twice = [*after, *lines] if k % 4 == 0 else []
        texts[k] = "\n".join([*before, *lines, *twice, *after])
    table = spark.createDataFrame([*texts.items(), *((1000 + k, texts[3]) for k in range(200))], "doc_id long, text string")
    got: dict = {}
    for r in license_scan.scan(table).collect():
        got.setdefault(r.doc_id, {}).setdefault(r.license_id, []).append((r.dice, r.unit, r.n_bigrams, r.n_common))
    hits = 0
    for k, text in texts.items():
        lines = [_line(x) for x in text.split("\n")]
        best: dict = {}
        for a in range(len(lines)):
            words: list[str] = []
            for b in range(a, len(lines)):
                words += lines[b]
                own = set(zip(words, words[1:], strict=False))
                for name, other, _ in known:
                    if 0.6 < len(own) / len(other) < 1.6:
                        best[name] = max(best.get(name, 0), 2 * len(own & other) / (len(own) + len(other)))
        best = {name: dice for name, dice in best.items() if dice >= 0.8}
        found = {name: max(rows)[0] for name, rows in got.get(k, {}).items()}
        # where several templates match at one place the best is named
        assert found.keys() <= best.keys() and (not best or max(found.values()) == pytest.approx(max(best.values()))), k
        assert all(dice == pytest.approx(best[name]) for name, dice in found.items()) or len(best) > 1, k
        hits += bool(best)
    assert hits > 20
    assert all(got[1000 + k] == got[3] for k in range(200))


def _line(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.lower()).split()
