"""The training-data operators against brute force, on small tables with awkward rows."""

from __future__ import annotations

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sensorlake.llm import (
    decontaminate,
    graph,
    html_extract,
    license_scan,
    line_dedup,
    mixing,
    ngram_join,
    quality_rules,
    scratch,
    substring_dedup,
    token_binary,
    token_counts,
    words,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_FILE = public_tokenizers.path("word_bpe_49k.json")
PIECE_FILE = public_tokenizers.path("piece_bpe_32k.model")


def _texts() -> list[str | None]:
    rng = np.random.default_rng(5)
    vocabulary = [f"w{k}" for k in range(300)] + ["Über", "naïve", "x,", "A"]

    def prose(n: int) -> str:
        out = rng.choice(vocabulary, n).tolist()
        return "".join(w + (" ", "\n", "\t ")[k % 17 // 15 + k % 29 // 28] for k, w in enumerate(out))

    base = [prose(int(n)) for n in rng.integers(1, 120, 40)]
    passage = prose(60)
    near = [" ".join(w if k % 40 else f"e{i}" for k, w in enumerate(base[3].split())) for i in range(4)]
    shared = [f"{prose(30)}\n{passage}\n{prose(20)}" for _ in range(12)]
    lines = [f"{prose(12)}\n  Same LINE here \x0b\n{prose(9)}" for _ in range(12)]
    odd = [None, "", " \n\t", "one", "one two three", "a\x00b \x7f", "\n\n", "don't I'll 's <|endoftext|> ß É 12"]
    return [*base, *base[:9], *near, *shared, *lines, *odd, prose(20_000), *([base[0]] * 5)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k * 3, t, "en", f"s{k % 4}" if k % 5 else None, k) for k, t in enumerate(_texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).select("*", F.lit(1).alias("n_words"), F.lit("x").alias("block"))


@pytest.fixture(scope="module")
def rows(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def test_words_are_cut_and_hashed_alike_everywhere(rows):
    texts = list(rows.values())
    for size in (1, 500, 1 << 20):
        seen: dict[int, str] = {}
        for part in words.split(pa.array(texts), size):
            own = texts[part.first : part.first + len(part.counts)]
            flat = [w for t in own for w in WORD.findall(t or "")]
            assert part.counts.tolist() == [len(WORD.findall(t or "")) for t in own]
            assert part.code_points().tolist() == [sum(map(len, WORD.findall(t or ""))) for t in own]
            for word, value in zip(flat, part.hashes().tolist(), strict=True):
                assert seen.setdefault(value, word) == word


def test_line_dedup(docs, rows):
    keys = collections.Counter()

    def key(line: str) -> str:
        return line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})

    for text in rows.values():
        keys.update({key(x) for x in (text or "").split("\n")})
    got = line_dedup.dedup(docs).collect()
    assert len(got) == len(rows) and any(r.n_dropped for r in got)
    for r in got:
        lines = (rows[r.doc_id] or "").split("\n")
        kept = "\n".join(x for x in lines if not key(x) or keys[key(x)] < 10)
        assert (r.n_lines, r.kept_sha256) == (len(lines), hashlib.sha256(kept.encode()).hexdigest())
        assert r.text == (None if rows[r.doc_id] is None else kept) and r.block == "x"


def test_perfect_hash_is_minimal_and_stored_whole():
    keys = np.unique(words.mix(np.arange(5000, dtype=np.uint64)))
    levels = line_dedup.build(keys)
    packed = b"".join(np.packbits(x).tobytes() for x in levels)
    opened = line_dedup.opened([len(x) for x in levels], packed)
    assert sorted(line_dedup.slots(opened, keys).tolist()) == list(range(5000))
    assert line_dedup.slots([], keys).max() == -1


def test_substring_dedup(docs, rows):
    lowest: dict[tuple, int] = {}
    cut = {k: WORD.findall(t or "") for k, t in rows.items()}
    for k, own in cut.items():
        for p in range(len(own) - 12):
            seq = tuple(own[p : p + 13])
            lowest[seq] = min(lowest.get(seq, k), k)
    got = substring_dedup.dedup(docs).collect()
    assert len(got) == len(rows) and any(r.n_removed for r in got)
    for r in got:
        own, gone = cut[r.doc_id], set()
        for p in range(len(own) - 12):
            if lowest[tuple(own[p : p + 13])] < r.doc_id:
                gone.update(range(p, p + 13))
        kept = " ".join(w for k, w in enumerate(own) if k not in gone)
        assert (r.n_words, r.n_removed) == (len(own), len(gone))
        assert r.kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()
        assert {k for s in r.spans for k in range(s.start, s.end)} == gone


def _components(rows: dict) -> tuple[dict, dict]:
    sets = {}
    for k, text in rows.items():
        own = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[k] = {tuple(own[p : p + 5]) for p in range(max(1, len(own) - 4))} if own else set()
    parent = {k: k for k in sets}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sets, {k: find(k) for k in sets}


def test_ngram_join(docs, rows):
    sets, root = _components(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(docs).collect()}
    assert got == {k: (len(sets[k]), root[k]) for k in rows}
    kept = ngram_join.keep_one(docs)
    assert kept.schema == docs.schema
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r if sets[k] else k for k, r in root.items()})


def test_ngram_join_finds_links_that_no_pivot_has(spark):
    rng = np.random.default_rng(1)
    base = [f"t{k}" for k in range(200)]
    texts = []
    for _ in range(60):
        own = list(base)
        for k in rng.integers(0, 200, int(rng.integers(0, 6))):
            own[k] = f"n{rng.integers(0, 9)}"
        texts.append(" ".join(own))
    rows = dict(enumerate(texts))
    table = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.join(table).collect()} == _components(rows)[1]


def test_components_of_chains_and_stars(spark):
    edges = [(f"n{k:03}", f"n{k + 1:03}") for k in range(40)] + [("z", f"y{k}") for k in range(30)] + [("q", "q"), (None, "q")]
    table = spark.createDataFrame(edges, "a string, b string")
    got = {r.node: r.root for r in graph.components(table, scratch.folder(spark)).collect()}
    assert got == {f"n{k:03}": "n000" for k in range(41)} | {f"y{k}": "y0" for k in range(30)} | {"z": "y0"}


def test_quality_rules(docs, rows):
    got = quality_rules.measure(docs.drop("n_words")).collect()
    assert len(got) == len(rows)
    for r in got:
        text = rows[r.doc_id] or ""
        own = WORD.findall(text)
        grams = collections.Counter(tuple(own[p : p + 5]) for p in range(len(own) - 4))
        repeated = {q for p in range(len(own) - 4) if grams[tuple(own[p : p + 5])] > 1 for q in range(p, p + 5)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        counts = (len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        assert r.base_failed == (len(own) < 10 or 100 * len(repeated) > 20 * len(own))
        assert not (r.base_failed and r.kept)
    assert sorted(r.doc_id for r in got if r.kept) == sorted(r.doc_id for r in quality_rules.keep(docs).collect())


def test_rule_order_never_changes_the_verdict(rows):
    for part in words.split(pa.array(list(rows.values()))):
        first = quality_rules.cascade(part, quality_rules.RULES)
        assert (first == quality_rules.cascade(part, quality_rules.RULES[::-1])).all()


def test_html_extraction():
    page = """<html><head><title>T</title><script>var t="</p>";</script></head><body><header><h1>Site</h1></header>
    <div id="cookie-notice"><p>We use cookies to improve your stay, as all do.</p></div><nav><ul><li><a href=x>Home</a></li></ul></nav>
    <article><h1>Head &amp;
    line</h1><p>First <b>para</b> is here.<p>Second,<br>too.</p><div class="ad">Buy this now, at once!</div><p>Third one ends.</p></article>
    <div class="comments"><p>I liked it very much, thank you for it.</p></div><form><p>Send us your name.</p></form>
    <footer>&copy; 2020 Site</footer>"""
    assert html_extract.main_text(page) == "Head & line\nFirst para is here.\nSecond, too.\nThird one ends."
    assert [html_extract.main_text(x) for x in (None, "", "<p>", "<!-- <p>x", "<script>x")] == [""] * 5


def test_html_extraction_keeps_columns(spark):
    table = spark.createDataFrame([(1, "u", "<p>Some text of a page, long enough to stay.</p>"), (2, None, None)], "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract(table.withColumn("n_chars", F.lit("old"))).collect()}
    assert got == {1: ("Some text of a page, long enough to stay.", 41), 2: ("", 0)}


def test_minimum_cut_is_the_cheapest_labelling():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = int(rng.integers(1, 8))
        source, sink = rng.random(n).tolist(), rng.random(n).tolist()
        edges = [(a, b, float(rng.random())) for a in range(n) for b in range(a) if rng.random() < 0.6]

        def cost(keep):
            own = sum(sink[k] if keep[k] else source[k] for k in range(n))
            return own + sum(w for a, b, w in edges if keep[a] != keep[b])

        best = min(cost([bool(m >> k & 1) for k in range(n)]) for m in range(1 << n))
        assert cost(html_extract.min_cut(n, source, sink, edges)) == pytest.approx(best)


def test_token_binary(spark, docs, rows):
    tokenizer = Tokenizer.from_file(WORD_FILE)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_binary.read(token_binary.write(docs, WORD_FILE, scratch.folder(spark))).collect()}
    start, expected = 0, {}
    for k in sorted(rows):
        ids = [*tokenizer.encode(rows[k] or "", add_special_tokens=False).ids, 2]
        expected[k] = (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    assert got == expected


def test_encoder_cuts_words_as_the_tokenizer_does():
    tokenizer, encoder = Tokenizer.from_file(WORD_FILE), token_binary.Encoder(WORD_FILE)
    odd = ["''s a''t x'RE 'S don't", "ÀÖØ÷×µªº ß É", "á é \u0301x \u00a0y z\u2003w x\x1cq \x85", "İI ﬁ 你好", "<|startoftext|>a<|endoftext|>b <| |>", "A.b,C--d 1a2'd3"]
    for texts in (odd, [*odd, None, "", " ", "x" * 5000], [None, ""], []):
        ids, counts = encoder.encode(pa.array(texts, pa.string()))
        each = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert counts.tolist() == [len(e) for e in each]
        assert ids.tolist() == [i for e in each for i in e]


def test_elias_fano_round_trip():
    rng = np.random.default_rng(2)
    for n, top in ((0, 1), (1, 1), (300, 1), (300, 10**9), (5000, 10**6)):
        values = np.sort(rng.integers(0, top, n))
        coded = token_binary.EliasFano.of(values)
        again = token_binary.EliasFano.from_bytes(coded.to_bytes())
        assert again.all().tolist() == values.tolist()
        assert [again[k] for k in range(0, n, 7)] == values[::7].tolist()
    assert len(coded.to_bytes()) < 5000 * 1.6


def test_token_counts_use_the_cache(spark, docs, rows):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE_FILE)
    path = f"{scratch.folder(spark)}/cache"
    for _ in range(2):
        got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count(docs, PIECE_FILE, path).collect()}
        assert got == {k: (len((t or "").encode()), len(model.encode(t or ""))) for k, t in rows.items()}
    assert token_counts.open_cache(spark, path).count() == len({t or "" for t in rows.values()})


def test_mixing(docs, rows):
    got = mixing.rates(docs).collect()
    assert sorted(r.doc_id for r in got) == sorted(rows)
    targets = {r.source: (r.source_size, r.target) for r in got}
    assert sum(t for _, t in targets.values()) == pytest.approx(sum(s for s, _ in targets.values()))
    order = sorted(targets, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    level = max(t / weight[s] for s, (_, t) in targets.items())
    for s, (own, target) in targets.items():
        assert target == pytest.approx(min(3 * own, level * weight[s]))
    for r in got:
        assert r.size == len(WORD.findall(rows[r.doc_id] or ""))
        rate = r.target / r.source_size
        assert int(rate) <= r.copies <= int(np.ceil(rate)) <= 3
    emitted = collections.Counter(r.doc_id for r in mixing.mix(docs).collect())
    assert emitted == collections.Counter({r.doc_id: r.copies for r in got if r.copies})


def test_licences(spark):
    mit = license_scan.TEMPLATES[3][1]
    texts = ["Prose.\n  Released under the MIT License.", mit, mit.replace("Software", "Program", 2), "licensed under cc by nc 4 0!",
             None, "", "the", "Released under the", "This is under no license at all, and says so here."]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.license_id) for r in license_scan.scan(table).collect()}
    assert got == {(0, "MIT"), (1, "MIT"), (2, "MIT"), (3, "CC-BY-NC-4.0")}


def test_decontamination(spark, rows):
    rng = np.random.default_rng(8)
    vocabulary = [f"b{k}" for k in range(400)] + ["of", "the", "in"] * 40
    items = [" ".join(rng.choice(vocabulary, 30)) + ". " + " ".join(rng.choice(vocabulary, 9)) for _ in range(50)]
    long = [rows[k] or "" for k in sorted(rows)][:20]
    texts = {k: f"{t} {items[k].upper() if k == 3 else items[k]}\n{t}" for k, t in enumerate(long)}
    texts |= {100 + k: " ".join(items[k].split()[:12]) + " " + t for k, t in enumerate(long)}
    texts |= {200: None, 201: "", 202: " ".join(items)}
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, "")], "item_id long, text string")
    expected = set()
    for k, text in texts.items():
        own = WORD.findall((text or "").lower())
        have = {tuple(own[p : p + n]) for n in range(1, 6) for p in range(len(own) - n + 1)}
        for i, item in enumerate(items):
            cut = item.split()
            grams = [tuple(cut[p : p + 5]) for p in range(len(cut) - 4)]
            if sum(g in have for g in set(grams)) >= 0.8 * len(set(grams)):
                expected.add((k, i))
    assert {(r.doc_id, r.item_id) for r in decontaminate.find(table, bench).collect()} == expected
    left = {r.doc_id for r in decontaminate.clean(table, bench).collect()}
    assert left == set(texts) - {k for k, _ in expected}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    bench = spark.createDataFrame([], "item_id long, text string")
    for result in (
        line_dedup.dedup(empty),
        substring_dedup.dedup(empty),
        ngram_join.join(empty),
        ngram_join.keep_one(empty),
        quality_rules.measure(empty),
        quality_rules.keep(empty),
        mixing.rates(empty),
        mixing.mix(empty),
        license_scan.scan(empty),
        token_binary.read(token_binary.write(empty, WORD_FILE, scratch.folder(spark))),
        token_counts.count(empty, PIECE_FILE, f"{scratch.folder(spark)}/cache"),
        decontaminate.find(empty, bench),
        decontaminate.clean(empty, bench),
        html_extract.extract(empty.withColumn("html", F.col("text"))),
    ):
        assert result.collect() == []
