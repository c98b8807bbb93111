"""Full texts of licences, as files and inside longer documents."""

from __future__ import annotations

import re

from sensorlake.llm import license_scan

FULL = {f.name.removesuffix(".txt"): f.read_text(encoding="utf-8") for f in license_scan._FILES}


def test_full_texts_are_found_by_name(spark):
    prose = "\n".join(" ".join(f"w{k}x{i}" for i in range(9)) for k in range(60))
    rows = [(name, "Copyright (c) 2024 Somebody " + " ".join(text.split())) for name, text in FULL.items()]
    short = ("ISC", "BSD-2-Clause", "BSD-3-Clause", "Zlib", "BSL-1.0", "Unlicense", "0BSD")
    rows += [(f"in {name}", f"{prose}\n{FULL[name]}\n{prose}") for name in short]
    rows += [(f"header {name}", " ".join(text.split())) for name, text in license_scan._HEADERS]
    got: dict = {}
    for r in license_scan.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect():
        if not r.doc_id.startswith("in ") or r.dice > 0.97:
            got[r.doc_id] = r.license_id
    assert got == {name: name.split()[-1] for name, _ in rows}


def test_a_match_always_has_a_cue():
    for low, high in zip(license_scan.CLASSES, (*license_scan.CLASSES[1:], 10**9), strict=True):
        own = tuple(t for t in license_scan.LICENCES if low <= len(license_scan._pairs(t[1])) < high)
        chosen = set(license_scan.cues(own))
        for name, text in own:
            pairs = license_scan._pairs(text)
            without = sum(not set(p) & chosen for p in pairs)
            assert without < len(pairs) * license_scan.MIN_DICE / (2 - license_scan.MIN_DICE), name


def test_the_sql_keeps_its_templates():
    assert license_scan.LICENCES[: len(license_scan.TEMPLATES)] == license_scan.TEMPLATES
    assert all(re.search("[a-z]", text) for _, text in license_scan.LICENCES)
