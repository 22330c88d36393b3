"""Licence scans (operator 5): Dice coefficient over word bigrams between text units and licence templates.

Units of a text are its lines, its paragraphs (between blank lines) and the whole of it, in lower case with anything
but ASCII letters and digits as blanks; and, for notices inside longer lines, across paragraphs or run together with
code, windows of a template's number of words: those that begin with its first two words and those that end with its
last two. Equal units of a text are one. The Dice coefficient of two sets of bigrams can reach a threshold t only if
their sizes differ by a factor of (2 - t) / t at most, so each template is looked for only among units of such sizes:
units that fit no template's bounds are gone, by their number of words, before any bigram is made, and the rest meet
templates by an equi-join on the size. Before that, texts and units without a word that every match must have are gone:
for each template some words touch more of its bigrams than a match can lack. Everything is built-in expressions.

Repeated bigrams of a unit count as often as they come, so that its size is its number of words less one.

Defined cases: null is the empty text, without matches; ids without a match give no row; rows with one id (or with
none) are taken together; units of fewer than two words match nothing; other columns of the input are not looked at;
whole texts are scanned.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 0.8
#: Short notices by which licences are declared, and the headers that they ask for.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Released under CC0 1.0 Universal."],
}


#: Fits the words of a unit.
WORDS = "[A-Za-z0-9]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, even where lambdas below refer to it for each of their elements."""
    return F.element_at(F.transform(F.array(value), use), 1)


def normal(text: Column) -> Column:
    """The words of a text in lower case, with a blank between them."""
    return F.lower(F.trim(F.regexp_replace(text, "[^A-Za-z0-9]+", " ")))


def tagged_bigrams(text: Column) -> Column:
    """Neighbouring words of a text, each with how often it has come so far, so that array functions respect repeats."""
    words = F.split(normal(text), " ")
    pairs = let(words, lambda w: F.transform(F.sequence(F.lit(1), F.size(w)), lambda i: F.concat_ws(" ", F.slice(w, i, 2))))
    count = lambda ps, p, i: F.size(F.filter(F.slice(ps, 1, i), lambda x: x == p))
    tagged = let(pairs, lambda ps: F.transform(ps, lambda p, i: F.concat_ws("#", p, count(ps, p, i + 1).cast("string"))))
    return let(tagged, lambda t: F.slice(t, 1, F.size(t) - 1))  # the last word has no neighbour


def size_bounds(n: Column, least: float) -> tuple[Column, Column]:
    """Numbers of bigrams with which a unit can reach ``least`` against a template of ``n``."""
    return F.ceil(n * (least / (2 - least)) - 1e-9).cast("int"), F.floor(n * ((2 - least) / least) + 1e-9).cast("int")


def anchor_words(template: str, least: float) -> set[str]:
    """Words of which any unit that reaches ``least`` against the template has one.

    A match lacks a bounded number of the template's bigrams; words that together touch more of them can't all be
    missing. Longer words are taken first, then numbers, as they are rarer.
    """
    words = re.findall("[a-z0-9]+", template.lower())
    n = len(words) - 1
    fewest = math.ceil(n * least / (2 - least) - 1e-9)  # bigrams of a unit; the fewer, the more may be lacking
    spare = n - math.ceil((fewest + n) * least / 2 - 1e-9)
    chosen: set[str] = set()
    for word in sorted(set(words), key=lambda w: (-(4 if w.isdigit() else len(w)) * (len(w) > 2 or w.isdigit()), w)):
        if sum(a in chosen or b in chosen for a, b in zip(words, words[1:])) > spare:
            break
        chosen.add(word)
    return chosen


def text_units(text: Column) -> Column:
    """Lines, paragraphs of several lines, and the whole text if it has several lines."""
    several = lambda u: F.contains(u, F.lit("\n"))
    return F.concat(F.split(text, "\n"), F.filter(F.split(text, r"\n[ \t\r]*\n"), several), F.filter(F.array(text), several))


def template_windows(words: Column, templates: dict[str, list[str]]) -> Column:
    """The windows of a text's words that begin or end as a template of their size does."""
    cut = [w for ts in templates.values() for t in ts if len(w := re.findall("[a-z0-9]+", t.lower())) > 1]
    shapes = [F.struct(F.lit(len(w)).alias("n"), F.lit(" ".join(w[:2])).alias("first"), F.lit(" ".join(w[-2:])).alias("last")) for w in cut]
    if not shapes:
        return F.array().cast("array<string>")
    pair = lambda w, i: F.concat_ws(" ", F.element_at(w, i), F.element_at(w, i + 1))

    def windows(w: Column) -> Column:
        padded = F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))
        has = lambda p, pairs: F.contains(p, F.concat(F.lit(" "), pairs, F.lit(" ")))
        there = let(padded, lambda p: F.filter(F.array(*shapes), lambda s: (s["n"] <= F.size(w)) & (has(p, s["first"]) | has(p, s["last"]))))
        fits = lambda s: lambda i: (pair(w, i) == s["first"]) | (pair(w, i + s["n"] - 2) == s["last"])
        starts = lambda s: F.filter(F.sequence(F.lit(1), F.size(w) - s["n"] + 1), fits(s))
        return F.flatten(F.transform(there, lambda s: F.transform(starts(s), lambda i: F.array_join(F.slice(w, i, s["n"]), " "))))

    return let(words, windows)


def anchored(text: Column, templates: dict[str, list[str]], least: float) -> Column:
    """Whether a text has an anchor word of some template; words that hold others are not asked for."""
    words = set().union(*(anchor_words(t, least) for ts in templates.values() for t in ts)) if templates else set()
    words = [w for w in sorted(words) if not any(v in w for v in words - {w})]
    return let(F.lower(text), lambda t: F.exists(F.array(*map(F.lit, words)).cast("array<string>"), lambda w: F.contains(t, w)))


def license_hits(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """(doc_id, license, dice, units) for each id of ``docs`` and each licence in its texts: the best Dice coefficient
    and the number of matches of units with the licence's templates."""
    spark = docs.sparkSession
    known = spark.createDataFrame([(name, t) for name, ts in templates.items() for t in ts], "license string, template string")
    known = known.select("license", tagged_bigrams(F.col("template")).alias("wanted"))
    known = known.withColumn("n_wanted", F.size("wanted")).filter("n_wanted > 0")
    low, high = size_bounds(F.col("n_wanted"), least)
    bounds = known.agg(F.min(low), F.max(high)).first()
    known = known.withColumn("n", F.explode(F.sequence(low, high)))  # a few dozen sizes for each template of a fixed list
    fits = lambda u: let(F.regexp_count(u, F.lit(WORDS)), lambda n: n.between((bounds[0] or 1) + 1, (bounds[1] or 0) + 1))
    may = lambda u: anchored(u, templates, least)
    units = F.transform(F.filter(F.filter(text_units(F.col("text")), may), fits), normal)
    units = F.array_distinct(F.concat(units, template_windows(F.split(normal(F.col("text")), " "), templates)))
    units = docs.select("doc_id", "text").filter(may(F.col("text"))).select("doc_id", F.explode(units).alias("unit"))
    cut = units.select("doc_id", tagged_bigrams(F.col("unit")).alias("held")).withColumn("n", F.size("held"))
    met = cut.join(F.broadcast(known), "n")
    dice = 2 * F.size(F.array_intersect("held", "wanted")) / (F.col("n") + F.col("n_wanted"))
    hits = met.select("doc_id", "license", dice.alias("dice")).filter(F.col("dice") >= least)
    return hits.groupBy("doc_id", "license").agg(F.max("dice").alias("dice"), F.count("*").alias("units"))


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_hits(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_TAGGED = """list_transform(pairs, lambda b, i: b || '#' || len(list_filter(pairs[1:i], lambda x: x = b)))"""
_PAIRS = """list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])"""
_NORMAL = """lower(trim(regexp_replace({text}, '[^A-Za-z0-9]+', ' ', 'g')))"""
_WORDS = f"""string_split({_NORMAL}, ' ')"""
LICENSE_SQL = f"""
WITH templates(license, template) AS (VALUES {", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, ts in TEMPLATES.items() for t in ts)}),
tw AS (SELECT license, {_WORDS.format(text="template")} AS words FROM templates),
tp AS (SELECT license, {_PAIRS} AS pairs FROM tw),
tt AS (SELECT license, {_TAGGED} AS wanted FROM tp),
docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents WHERE text IS NOT NULL),
units AS (
  SELECT r, doc_id, unnest(list_concat(string_split(text, chr(10)),
    list_filter(regexp_split_to_array(text, '\n[ \t\r]*\n'), lambda u: contains(u, chr(10))),
    CASE WHEN contains(text, chr(10)) THEN [text] ELSE [] END)) AS unit
  FROM docs),
dw AS (SELECT r, doc_id, {_WORDS.format(text="text")} AS ws, ' ' || {_NORMAL.format(text="text")} || ' ' AS padded FROM docs),
shapes AS (SELECT DISTINCT len(words) AS n, words[1:2] AS a, words[len(words) - 1:] AS z FROM tw),
windows AS (
  SELECT r, doc_id, unnest(list_transform(list_filter(range(1, len(ws) - n + 2), lambda i: ws[i:i + 1] = a OR ws[i + n - 2:i + n - 1] = z),
    lambda i: array_to_string(ws[i:i + n - 1], ' '))) AS unit
  FROM dw JOIN shapes ON len(ws) >= n AND (contains(padded, ' ' || a[1] || ' ' || a[2] || ' ') OR contains(padded, ' ' || z[1] || ' ' || z[2] || ' '))),
fit AS (
  SELECT DISTINCT r, doc_id, {_NORMAL.format(text="unit")} AS unit FROM units WHERE len(regexp_extract_all(unit, '{WORDS}')) BETWEEN 2 AND 400
  UNION SELECT r, doc_id, unit FROM windows),
uw AS (SELECT doc_id, string_split(unit, ' ') AS words FROM fit),
up AS (SELECT doc_id, {_PAIRS} AS pairs FROM uw),
ut AS (SELECT doc_id, {_TAGGED} AS held FROM up),
hits AS (
  SELECT doc_id, license, 2 * len(list_intersect(held, wanted)) / (len(held) + len(wanted))::DOUBLE AS dice
  FROM ut JOIN tt ON len(held) BETWEEN ceil(len(wanted) * {LEAST / (2 - LEAST)} - 1e-9) AND floor(len(wanted) * {(2 - LEAST) / LEAST} + 1e-9))
SELECT doc_id, license, max(dice) AS dice, count(*) AS units FROM hits WHERE dice >= {LEAST} GROUP BY doc_id, license
"""
