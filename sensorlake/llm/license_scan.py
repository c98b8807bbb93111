"""Licence scan by Dice coefficient over word bigrams, in Spark expressions only.

The lines of a text, the whole text where it has several, and runs of its
neighbouring lines are units; so a licence that is wrapped over lines inside a
longer document is one. A unit is normalised (A-Z to lower case, other characters than a-z and 0-9 to one
space) and compared with licence templates by 2 * common / (own + template)
over distinct word bigrams. A coefficient of d or more bounds the sizes: neither
side may have fewer than d / (2 - d) of the other's bigrams; units that no
template allows are dropped before bigrams are made, and templates that a unit's
size does not allow before common bigrams are counted.

Most text is looked at only once, for cues. The same bound says how many of its
bigrams a template may lack at most; cues are words of the templates that, for
each template, stand in more bigrams than that, long words first, as these are
rare elsewhere. So a text without any cue is no licence and holds none. Of the
others, equal ones are compared once, and only those are cut into units that
hold, in all, as many of a template's bigrams as a match needs.

A run begins and ends at lines with common bigrams, and counts if no line more
or less at either end makes it better and it lies in no run as good; from every
run that matches, such steps lead to one that counts, or to a line or the whole
text. A line with more bigrams than the size bound allows is in no run, so runs
are looked for in the stretches between such lines, where a stretch holds enough
common bigrams. Lines from which on too few of these are left, or within reach,
begin no run; the reach ends where a run would hold more bigrams that the
stretches have only once than the size bound allows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence
from functools import cache
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sensorlake.functions.plan import once
from sensorlake.llm import scratch

MIN_DICE = 0.8
#: The unit number of a whole text; lines count from 0, a run that begins at line k is RUN - k.
WHOLE = -1
RUN = -2

# Names and texts of licences and of the notices that grant them.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
        permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright
        notice and this permission notice shall be included in all copies or substantial portions of the Software. THE
        SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
        WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS
        OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
        OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
        the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License.""",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
        details. You should have received a copy of the GNU General Public License along with this program. If not, see
        <https://www.gnu.org/licenses/>.""",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    (
        "MPL-2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    ),
    (
        "BSD-2-Clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution.""",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

# Standard headers, and full texts from the folder beside this module.
_HEADERS = tuple(
    (f"{short}-{version}", TEMPLATES[7][1].replace("GNU General", f"GNU {name} General").replace("version 3", f"version {number}"))
    for short, name, version, number in (("LGPL", "Lesser", "3.0", "3"), ("LGPL", "Lesser", "2.1", "2.1"), ("AGPL", "Affero", "3.0", "3"))
)
_FILES = sorted((f for f in resources.files("sensorlake.llm").joinpath("licences").iterdir() if f.name.endswith(".txt")), key=lambda f: f.name)
LICENCES = (*TEMPLATES, *_HEADERS, *((f.name.removesuffix(".txt"), f.read_text(encoding="utf-8")) for f in _FILES))
#: Templates of so many bigrams, and more, have cues of their own.
CLASSES = (0, 50, 1000)
#: Cues have so many letters, where longer ones do not do.
LETTERS = (9, 7, 5, 2)
#: Texts of more than one row in HOT are dealt to SALTS tasks when rows get their units.
HOT, SALTS = 1000, 64


def normalised(text: Column) -> Column:
    """Words of a-z and 0-9, one space apart."""
    return F.trim(F.lower(F.regexp_replace(text, "[^A-Za-z0-9]+", " ")))


def bigrams(words: Column) -> Column:
    """The distinct pairs of neighbouring words of an array."""
    pairs = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.when(F.size(words) > 1, pairs).otherwise(F.array().cast("array<string>")))


def _pairs(text: str) -> set[tuple[str, str]]:
    words = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    return set(zip(words, words[1:], strict=False))


@cache
def cues(texts: tuple[tuple[str, str], ...] = LICENCES, min_dice: float = MIN_DICE) -> list[str]:
    """Words of which a unit must have one, to be near enough to any of the texts.

    Words are chosen one after another by the bigrams they add to templates that
    need more; shorter words only where longer ones do not do.
    """
    open_: list[tuple[int, set[tuple[str, str]]]] = []
    for _, text in texts:
        pairs = _pairs(text)
        open_.append((len(pairs) - math.ceil(len(pairs) * min_dice / (2 - min_dice) - 1e-9) + 1, pairs))
    chosen: list[str] = []
    for shortest in LETTERS:
        while True:
            gain: Counter[str] = Counter()
            for need, pairs in open_:
                if need > 0:
                    for word, new in Counter(w for p in pairs for w in set(p) if len(w) >= shortest).items():
                        gain[word] += min(need, new)
            best = max(gain, key=lambda w: (gain[w], len(w), w), default=None)
            if best is None:
                break
            chosen.append(best)
            left = [{p for p in pairs if best not in p} for _, pairs in open_]
            open_ = [(need - len(pairs) + len(rest), rest) for (need, pairs), rest in zip(open_, left, strict=True)]
    return chosen


def may_match(words: Column, texts: tuple[tuple[str, str], ...], min_dice: float) -> Column:
    """Whether an array of words is long enough for, and has a cue of, any of the templates."""
    least, chosen = math.inf, set()
    for low, high in zip(CLASSES, (*CLASSES[1:], math.inf), strict=True):
        own = tuple(t for t in texts if low <= len(_pairs(t[1])) < high)
        if own:
            least = min(least, min(len(_pairs(t)) for _, t in own) * min_dice / (2 - min_dice))
            chosen |= set(cues(own, min_dice))
    return (F.size(words) > least) & F.arrays_overlap(words, F.lit(sorted(chosen)))


def templates(spark: SparkSession, texts: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """One row per template: template (its number), license_id, own (its bigrams)."""
    rows = spark.createDataFrame([(k, name, text) for k, (name, text) in enumerate(texts)], "template int, license_id string, text string")
    return rows.select("template", "license_id", bigrams(F.split(normalised(F.col("text")), " ")).alias("own"))


def _by_line(texts: DataFrame) -> DataFrame:
    """Texts of several lines: body, lines (the words of each)."""
    cut = F.transform(F.split("text", "\n"), lambda line: F.filter(F.split(normalised(line), " "), lambda w: w != ""))
    return texts.where(F.contains("text", F.lit("\n"))).select("body", once(cut).alias("lines"))


def _occurrences(by_line: DataFrame) -> DataFrame:
    """Where bigrams are found: the columns of by_line but lines, bigram, first, last (the lines of its words)."""
    kept = [c for c in by_line.columns if c != "lines"]
    words = F.flatten(F.transform("lines", lambda line, k: F.transform(line, lambda w: F.struct(k.alias("line"), w.alias("word")))))
    rows = by_line.select(*kept, once(words).alias("words")).where(F.size("words") > 1)
    words = F.col("words")
    both = F.zip_with(
        F.slice(words, 1, F.size(words) - 1),
        F.slice(words, 2, F.size(words) - 1),
        lambda x, y: F.struct(x.line.alias("first"), y.line.alias("last"), F.concat_ws(" ", x.word, y.word).alias("bigram")),
    )
    return rows.select(*kept, F.explode(both).alias("at")).select(*kept, "at.*")


def _stretches(lines: DataFrame, common: DataFrame, near: DataFrame, ratio: float) -> DataFrame:
    """Lines between which a run may lie: body, t, from, to.

    lines: body, line and own, its bigrams. common: occurrences of bigrams of near templates, with t.
    """
    here = common.groupBy("body", "t", F.col("first").alias("line")).agg(F.count_distinct("bigram").alias("here"))
    rows = lines.join(near, "body").join(here, ["body", "t", "line"], "left")
    long = (F.col("own") > F.col("t.other") / ratio + 1e-9).cast("int")
    rows = rows.withColumns({"long": long, "number": F.sum(long).over(W.partitionBy("body", "t").orderBy("line"))}).where("long = 0")
    rows = rows.groupBy("body", "t", "number").agg(F.min("line").alias("from"), F.max("line").alias("to"), F.sum("here").alias("here"))
    return rows.where((F.col("here") >= F.col("t.other") * ratio - 1e-9) & (F.col("from") < F.col("to"))).select("body", "t", "from", "to")


def _starts(lines: DataFrame, common: DataFrame, ratio: float) -> DataFrame:
    """Lines at which a run may begin: body, t, a, to, base.

    lines: body, last (the line) and before, how many bigrams that are found
    only once stand in earlier lines. common: occurrences of bigrams of near
    templates, with t and the stretch that they lie in.
    """
    need, most = F.col("t.other") * ratio - 1e-9, F.col("t.other") / ratio
    here = common.groupBy("body", "t", "to", F.col("first").alias("a")).agg(F.count_distinct("bigram").alias("here"))
    last = common.groupBy("body", "t", "bigram").agg(F.max("first").alias("a")).groupBy("body", "t", "a").agg(F.count("*").alias("ends"))
    each = here.join(last, ["body", "t", "a"], "left").join(lines.withColumnRenamed("last", "a"), ["body", "a"])
    onward = W.partitionBy("body", "t").orderBy(F.desc("a"))
    each = each.withColumn("left", F.sum(F.coalesce("ends", F.lit(0))).over(onward)).withColumn("at", F.floor(1000 * F.col("before") / most))
    within = W.partitionBy("body", "t").orderBy("at").rangeBetween(0, 1000)
    each = each.withColumn("near", F.sum("here").over(within)).where((F.col("left") >= need) & (F.col("near") >= need))
    return each.select("body", "t", "a", "to", F.floor(F.col("before") / most).alias("base"))


def runs(texts: DataFrame, near: DataFrame, known: DataFrame, index: DataFrame, path: str, min_dice: float = MIN_DICE) -> DataFrame:
    """Runs of neighbouring lines that match: body, unit, size, n_common, dice, t (template, other).

    texts: body (a digest of the text) and text; near: body and t, the templates
    it holds enough bigrams of; known, index: templates by number and by bigram.
    """
    ratio = min_dice / (2 - min_dice)
    by_line = _by_line(texts)
    lines = by_line.select("body", F.posexplode(F.transform("lines", lambda w: F.struct(F.size(w).alias("words"), F.size(bigrams(w)).alias("own")))).alias("line", "at"))
    lines = scratch.save(lines.select("body", "line", "at.*"), f"{path}/lines")
    ends = lines.where("words > 0").groupBy("body").agg(F.min("line").alias("top"), F.max("line").alias("bottom"))
    common = _occurrences(by_line).join(F.broadcast(index), "bigram").select("body", "bigram", "first", "last", F.explode("held").alias("t"))
    common = scratch.save(common.join(near, ["body", "t"], "left_semi").distinct(), f"{path}/common")
    stretches = scratch.save(_stretches(lines, common, near, ratio), f"{path}/stretches")

    between = stretches.groupBy("body").agg(F.collect_set(F.struct("from", "to")).alias("between"))
    found = _occurrences(by_line.join(between, "body"))
    found = found.where(F.exists("between", lambda s: (F.col("first") >= s["from"]) & (F.col("last") <= s["to"])))
    found = scratch.save(found.select("body", "bigram", "first", "last").distinct(), f"{path}/occurrences")
    alone = found.groupBy("body", "bigram").agg(F.count("*").alias("n"), F.min("first").alias("first"), F.min("last").alias("last"))
    alone = alone.where("n = 1 and first = last").groupBy("body", "last").agg(F.count("*").alias("own"))
    places = found.select("body", F.explode(F.array("first", "last")).alias("last")).distinct().join(alone, ["body", "last"], "left")
    earlier = W.partitionBy("body").orderBy("last").rowsBetween(W.unboundedPreceding, -1)
    places = places.select("body", "last", F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("before"))

    common = common.join(stretches, ["body", "t"]).where("first >= from and last <= to")
    # a run that matches, and the next line that adds to it, lie in these two parts of the text
    starts = _starts(places, common, ratio)
    starts = starts.withColumn("base", F.explode(F.array("base", F.col("base") + 1)))
    inside = found.join(places, ["body", "last"]).join(stretches, "body").where("first >= from and last <= to")
    inside = inside.withColumn("base", F.floor(F.col("before") / (F.col("t.other") / ratio))).drop("from")

    # a bigram is in all runs from its first place after a
    new = starts.join(inside, ["body", "t", "to", "base"]).where(F.col("first") >= F.col("a"))
    new = new.groupBy("body", "t", "to", "a", "bigram").agg(F.min("last").alias("b"))
    own = known.select(F.col("template").alias("of"), F.explode("own").alias("bigram"), F.lit(1).alias("common"))
    new = new.withColumn("of", F.col("t.template")).join(F.broadcast(own), ["of", "bigram"], "left")
    each = new.groupBy("body", "t", "to", "a", "b").agg(F.count("*").alias("n"), F.count("common").alias("c"))
    longer, later = W.partitionBy("body", "t", "a").orderBy("b"), W.partitionBy("body", "t", "b").orderBy("a")
    each = each.withColumns({"size": F.sum("n").over(longer), "n_common": F.sum("c").over(longer), "reach": F.coalesce(F.lead("b").over(longer) - 1, "to")})
    each = each.where("c > 0")
    each = each.withColumn("dice", 2 * F.col("n_common") / (F.col("size") + F.col("t.other")))
    less = F.greatest(F.coalesce(F.lag("dice").over(longer), F.lit(0.0)), F.coalesce(F.lead("dice").over(later), F.lit(0.0)))
    more = F.greatest(F.coalesce(F.lead("dice").over(longer), F.lit(0.0)), F.coalesce(F.lag("dice").over(later), F.lit(0.0)))
    each = each.withColumns({"less": less, "more": more})
    best = each.where((F.col("dice") >= min_dice) & (F.col("dice") > F.col("less")) & (F.col("dice") >= F.col("more")) & (F.col("a") < F.col("b")))
    best = scratch.save(best, f"{path}/runs")
    # a run inside an equal or better one, of whatever template, goes; lines that add nothing new count as inside
    wider = best.select("body", F.col("a").alias("from"), F.col("b").alias("upto"), F.col("reach").alias("until"), F.col("dice").alias("over"))
    around = ((F.col("from") < F.col("a")) & (F.col("until") >= F.col("b"))) | ((F.col("from") == F.col("a")) & (F.col("upto") > F.col("b")))
    best = best.drop("reach").join(wider, (best["body"] == wider["body"]) & around & (F.col("over") >= F.col("dice")), "left_anti")
    best = best.join(ends, "body").where((F.col("a") > F.col("top")) | (F.col("b") < F.col("bottom")))
    return best.select("body", (F.lit(RUN) - F.col("a")).alias("unit"), "size", "n_common", "dice", "t")


def _alone(texts: DataFrame, index: DataFrame, least: float, most: float, chosen: Column, ratio: float) -> DataFrame:
    """Lines and whole texts with common bigrams: body, unit, size, n_common, t."""
    lines = F.transform(F.split("text", "\n"), lambda line, k: F.struct(k.alias("unit"), line.alias("line")))
    whole = F.array(F.struct(F.lit(WHOLE).alias("unit"), F.col("text").alias("line")))
    units = texts.select("body", F.explode(F.when(F.size(lines) > 1, F.concat(lines, whole)).otherwise(lines)).alias("at"))
    units = units.select("body", "at.unit", once(F.split(normalised(F.col("at.line")), " ")).alias("words")).where(chosen)
    units = units.select("body", "unit", once(bigrams(F.col("words"))).alias("own"))
    units = units.withColumn("size", F.size("own")).where((F.col("size") >= least) & (F.col("size") <= most))
    each = units.select("body", "unit", "size", F.explode("own").alias("bigram"))
    common = each.join(F.broadcast(index), "bigram").select("body", "unit", "size", F.explode("held").alias("t"))
    allowed = (F.col("size") >= F.col("t.other") * ratio) & (F.col("t.other") >= F.col("size") * ratio)
    return common.where(allowed).groupBy("body", "unit", "size", "t").agg(F.count("*").alias("n_common"))


def _spread(rows: DataFrame, hot: DataFrame, salts: Column) -> DataFrame:
    """Rows with a salt of 0, and salts of their own for hot bodies."""
    marked = rows.join(F.broadcast(hot), "body", "left")
    return marked.withColumn("salt", F.explode(F.when(F.col("hot"), salts).otherwise(F.array(F.lit(0))))).drop("hot")


def scan(
    docs: DataFrame, key: str = "doc_id", text: str = "text",
    texts: Sequence[tuple[str, str]] = LICENCES, min_dice: float = MIN_DICE,
) -> DataFrame:
    """The units that are a licence: key, unit, license_id, n_bigrams, n_common (long), dice.

    unit: the number of the line, -1 for a whole text of several lines, or -2 - k
    for a run of lines that begins at line k. Of several templates the one of the
    highest coefficient counts, then the first; likewise of the runs that begin
    at a line.
    A null or empty text has no unit that matches. Rows that repeat key and text
    give one row per unit. Other columns are left out. Texts are told apart by
    their MD5 digest.
    """
    spark, path, texts = docs.sparkSession, scratch.folder(docs.sparkSession), tuple(texts)
    known = templates(spark, texts).withColumn("size", F.size("own"))
    sizes = [len(_pairs(t)) for _, t in texts]
    ratio = min_dice / (2 - min_dice)
    least, most = min(sizes) * ratio, max(sizes) / ratio
    index = known.select("template", F.col("size").alias("other"), F.explode("own").alias("bigram"))
    index = index.groupBy("bigram").agg(F.collect_list(F.struct("template", "other")).alias("held"))

    cued = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), once(F.split(normalised(F.col(f"`{text}`")), " ")).alias("words"))
    cued = cued.where(may_match(F.col("words"), texts, min_dice)).select("key", F.md5("text").alias("body"), "text")
    cued = scratch.save(cued, f"{path}/cued")
    distinct = cued.groupBy("body").agg(F.first("text").alias("text"))
    words = distinct.select("body", once(F.split(normalised(F.col("text")), " ")).alias("words"))
    near = words.select("body", F.explode(bigrams(F.col("words"))).alias("bigram")).join(F.broadcast(index), "bigram")
    near = near.select("body", F.explode("held").alias("t")).groupBy("body", "t").agg(F.count("*").alias("n"))
    near = scratch.save(near.where(F.col("n") >= F.col("t.other") * ratio - 1e-9).select("body", "t"), f"{path}/near")
    held = scratch.save(distinct.join(near.select("body").distinct(), "body", "left_semi"), f"{path}/held")

    alone = _alone(held, index, least, most, may_match(F.col("words"), texts, min_dice), ratio)
    dice = 2 * F.col("n_common") / (F.col("size") + F.col("t.other"))
    found = alone.withColumn("dice", dice).where(F.col("dice") >= min_dice).select("body", "unit", "size", "n_common", "dice", "t")
    found = found.unionByName(runs(held, near, known, index, path, min_dice))
    found = found.withColumn("template", F.col("t.template")).join(F.broadcast(known.select("template", "license_id")), "template")
    best = W.partitionBy("body", "unit").orderBy(F.col("dice").desc(), "template", "size")
    named = found.withColumn("rank", F.row_number().over(best)).where("rank = 1")
    named = named.select("body", "unit", "license_id", F.col("size").cast("long").alias("n_bigrams"), "n_common", "dice")

    rows = cued.select("key", "body").distinct()
    # bodies of more rows than this are fewer than HOT
    bound = cued.count() // HOT
    hot = cued.groupBy("body").agg(F.count("*").alias("n")).where(F.col("n") > max(bound, SALTS)).select("body", F.lit(True).alias("hot"))
    rows = _spread(rows, hot, F.array(F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")))
    named = _spread(named, hot, F.array(*[F.lit(k) for k in range(SALTS)]))
    return rows.join(named, ["body", "salt"]).select(F.col("key").alias(key), "unit", "license_id", "n_bigrams", "n_common", "dice")
