"""Licence scans (operator 3): Dice coefficient over word bigrams against licence templates, in DataFrame functions alone.

A text is normalised to lower-case words of [a-z0-9.] without outer dots.  With A and B the sets of word bigrams of a unit and a
template, dice = 2 |A n B| / (|A| + |B|).  As dice <= 2 min(|A|, |B|) / (|A| + |B|), only templates with
|A| t / (2 - t) <= |B| <= |A| (2 - t) / t can reach the threshold t.  The same bound on the number of words drops most units
before any bigram is made, and for each remaining unit all but a few templates.

Units are the lines, the sentences of lines that name a licence, the paragraphs (lines without words divide them), the whole
text, and windows: wherever three words in a
row are one of a template's seeds, the words that would be the template, if the seed stood in its place, are compared with
it.  So a licence is found inside a longer text however its lines are wrapped, as long as one of its seeds (`SEEDS` for each
template of `LONG` words or more) is unchanged.

All of it is one projection of the scan: no shuffle, and a long text costs in proportion to its length.

Defined cases: null and empty texts, and texts without a unit of two words, have no match (n_matches 0, licence null, dice
0); of equally good templates the first id in alphabetical order is reported; repeated rows are each scanned; a null doc_id
stays null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_documents

#: Licence texts, notices and titles in public use (fixed values).
TEXTS = [
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE '
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE "
        "LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
        "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
        "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "BSD-3-Clause",
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission.",
    ),
    (
        "BSL-1.0",
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this '
        'license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to '
        "permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    ),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
        "Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "GPL-3.0",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim "
        "copies of this license document, but changing it is not allowed.",
    ),
    (
        "AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "LGPL-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free "
        "Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    (
        "LGPL-3.0",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free "
        "Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "0BSD",
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND '
        "THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
        "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of "
        "this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it "
        "freely, subject to the following restrictions:",
    ),
]

#: Licences and the names they go by in a statement (fixed values).
NAMES = {
    "Apache-2.0": ["the Apache License, Version 2.0", "the Apache 2.0 License"],
    "BSD-2-Clause": ["the BSD 2-Clause License"],
    "BSD-3-Clause": ["the BSD 3-Clause License"],
    "CC-BY-4.0": ["a Creative Commons Attribution 4.0 International License", "CC BY 4.0"],
    "CC-BY-NC-4.0": ["a Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0"],
    "CC-BY-SA-4.0": ["a Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0"],
    "GPL-2.0": ["the GNU General Public License, version 2"],
    "GPL-3.0": ["the GNU General Public License, version 3"],
    "LGPL-3.0": ["the GNU Lesser General Public License, version 3"],
    "AGPL-3.0": ["the GNU Affero General Public License, version 3"],
    "ISC": ["the ISC License"],
    "MIT": ["the MIT License"],
    "MPL-2.0": ["the Mozilla Public License, version 2.0"],
}
#: How a statement begins (fixed values).
SAID = ["Licensed under", "Released under", "Distributed under", "This work is licensed under", "This software is released under"]
TEMPLATES = [*TEXTS, *((licence, f"{said} {name}.") for licence, names in NAMES.items() for name in names for said in SAID)]

#: A line that may hold a statement among other sentences, and what parts them.
NAMED, SENTENCE = "(?i)licen[cs]e|CC BY", "[.!?][ \t]+"

#: Templates of this many words or more are looked for inside longer texts, by this many seeds each.
LONG, SEEDS = 16, 6
#: What bounds yield to rounding.
EPS = 1e-9

_WORD = "[a-z0-9]+(?:[.][a-z0-9]+)*"


def _words(text: str) -> list[str]:
    return re.findall(_WORD, text.lower())


def _bigrams(text: str) -> list[str]:
    w = _words(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])})


def _seeds(templates) -> list[tuple[str, str, int, int, list[str]]]:
    """(three words, licence, their place in the template, its number of words, its bigrams) of all long templates."""
    out = []
    for licence, text in templates:
        w = _words(text)
        if len(w) >= LONG:
            for at in sorted({(2 * k + 1) * (len(w) - 2) // (2 * SEEDS) for k in range(SEEDS)}):
                out.append((" ".join(w[at : at + 3]), licence, at, len(w), _bigrams(text)))
    return sorted(out)


def _let(value, body):
    return F.element_at(F.transform(F.array(value), body), 1)


def _constant(value, kind: str):
    """A constant of any type, which the optimizer makes once."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, templates=None) -> DataFrame:
    """Per document: the best licence, its dice, and all licences and the number of units at or above the threshold."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie in (0, 1]")
    templates = TEMPLATES if templates is None else templates
    table = sorted((name, _bigrams(text)) for name, text in templates)
    table = [(name, b) for name, b in table if b]
    sizes = [len(b) for _, b in table] or [0]
    t = threshold
    # a unit of k words has at most k - 1 bigrams; repeats only lower that, so only the lower bound holds for words
    least = min(sizes) * t / (2 - t) - EPS
    hit_type = "array<struct<dice:double,licence:string>>"
    nothing = F.array().cast(hit_type)

    def grams(w):
        pairs = F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.filter(F.array_distinct(pairs), lambda g: g.isNotNull())

    def dice(a, template):
        n, m = F.size(a), F.size(template["b"])
        in_bounds = (n >= m * (t / (2 - t)) - EPS) & (n <= m * ((2 - t) / t) + EPS)
        score = F.when(in_bounds, 2.0 * F.size(F.array_intersect(a, template["b"])) / (n + m)).otherwise(F.lit(0.0))
        return F.struct(score.alias("dice"), template["licence"].alias("licence"))

    every = _constant([{"licence": name, "b": b} for name, b in table], "array<struct<licence:string,b:array<string>>>")
    any_gram = _constant(sorted({g for _, b in table for g in b}), "array<string>")

    def hits(w):
        """Matches of one unit's words."""

        def by_grams(a):
            made = F.filter(F.transform(every, lambda x: dice(a, x)), lambda s: s["dice"] >= t)
            return F.when(F.arrays_overlap(a, any_gram), made).otherwise(nothing)

        return F.when(F.size(w) - 1 >= least, _let(grams(w), by_grams)).otherwise(nothing)

    seeds: dict[str, list] = {}
    for seed, licence, at, n, b in _seeds(templates):
        seeds.setdefault(seed, []).append({"at": at, "n": n, "licence": licence, "b": b})
    window = "struct<at:int,n:int,licence:string,b:array<string>>"
    seeded = _constant(seeds, f"map<string,array<{window}>>")

    def windows(w):
        """Matches of the windows of a text's words, one list for each window."""
        three = lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
        places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0))), lambda i: three(i).isin(list(seeds)))
        begin = lambda i, x: F.struct((i - x["at"]).alias("start"), x["n"].alias("n"), x["licence"].alias("licence"), x["b"].alias("b"))
        # the same window may be found by several seeds
        found = F.array_distinct(F.flatten(F.transform(places, lambda i: F.transform(F.element_at(seeded, three(i)), lambda x: begin(i, x)))))
        cut = lambda x: F.slice(w, F.greatest(x["start"], F.lit(0)) + 1, F.greatest(F.least(x["start"], F.lit(0)) + x["n"], F.lit(0)))
        return F.transform(found, lambda x: F.filter(F.array(_let(grams(cut(x)), lambda a: dice(a, x))), lambda s: s["dice"] >= t))

    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(_WORD), F.lit(0))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")).withColumn("w", words(F.col("t")))
    text = F.col("t")
    paragraphs = F.split(text, r"\n[^\p{L}\p{N}]*\n")
    lines = F.split(text, "\n")
    sentences = F.flatten(F.transform(F.filter(lines, lambda x: x.rlike(NAMED)), lambda x: F.split(x, SENTENCE)))
    units = F.array_except(F.concat(lines, sentences, paragraphs), F.array(text))
    # at least two characters a word: shorter units have too few words; a unit with more distinct bigrams than the longest template allows is found by its own bound
    units = F.filter(units, lambda u: F.length(u) >= 2 * least)
    found = F.transform(F.concat(F.transform(units, words), F.array("w")), hits) if table else F.array().cast(f"array<{hit_type}>")
    if seeds:
        found = F.concat(found, F.when(F.size("w") >= 3, windows(F.col("w"))).otherwise(F.array().cast(f"array<{hit_type}>")))
    d = d.select("doc_id", F.filter(found, lambda x: F.size(x) > 0).alias("found"))
    best = lambda h: F.aggregate(
        h, F.struct(F.lit(0.0).alias("dice"), F.lit(None).cast("string").alias("licence")),
        lambda s, x: F.when((x["dice"] > s["dice"]) | ((x["dice"] == s["dice"]) & (x["licence"] < s["licence"])), x).otherwise(s),
    )
    d = d.select("doc_id", F.size("found").cast("long").alias("n_matches"), F.flatten("found").alias("h"))
    d = d.withColumn("best", best(F.col("h")))
    return d.select(
        "doc_id",
        F.col("best.licence").alias("licence"),
        F.round("best.dice", 6).alias("dice"),
        "n_matches",
        F.array_join(F.array_sort(F.array_distinct(F.transform("h", lambda x: x["licence"]))), ",").alias("licences"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_documents(spark, sf_dir))


def _oracle(threshold: float = 0.8) -> str:
    rows = sorted({(name, tuple(_bigrams(text))) for name, text in TEMPLATES})
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    listed = lambda b: f"[{', '.join(map(quote, b))}]"
    values = ", ".join(f"({quote(n)}, {listed(b)})" for n, b in rows)
    seeds = ", ".join(f"({quote(s)}, {quote(name)}, {at}, {n}, {listed(b)})" for s, name, at, n, b in _seeds(TEMPLATES))
    bounds = f"len(a) BETWEEN len(b) * {threshold / (2 - threshold)!r}::double - {EPS}::double AND len(b) * {(2 - threshold) / threshold!r}::double + {EPS}::double"
    score = "2.0::double * len(list_intersect(a, b)) / (len(a) + len(b))"
    return rf"""
WITH tmpl(licence, b) AS (VALUES {values}),
seed(seed, licence, place, n, b) AS (VALUES {seeds}),
d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
u AS (SELECT doc_id, unnest(list_distinct(string_split(t, chr(10)) ||
        flatten(list_transform(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{NAMED}')), lambda x: regexp_split_to_array(x, '{SENTENCE}'))) || regexp_split_to_array(t, '\n[^\p{{L}}\p{{N}}]*\n') || [t])) AS unit FROM d),
w AS (SELECT doc_id, unit, regexp_extract_all(lower(unit), '{_WORD}') AS w FROM u),
g AS (SELECT doc_id, unit, list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS a FROM w WHERE len(w) >= 2),
s AS (SELECT doc_id, 'u' || unit AS unit, licence, {score} AS dice FROM g, tmpl WHERE {bounds}),
x AS (SELECT doc_id, regexp_extract_all(lower(t), '{_WORD}') AS w FROM d),
p AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest([w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] for k in range(1, len(w) - 1)]) AS seed FROM x WHERE len(w) >= 3),
q AS (SELECT DISTINCT doc_id, licence, n, b, i - place AS start FROM p JOIN seed USING (seed)),
y AS (SELECT q.*, w[greatest(start, 1) : start + n - 1] AS v FROM q JOIN x USING (doc_id)),
z AS (SELECT doc_id, licence, n, start, b, list_distinct([v[i] || ' ' || v[i + 1] for i in range(1, len(v))]) AS a FROM y),
s2 AS (SELECT doc_id, 'w' || start || ' ' || licence || ' ' || n || ' ' || len(b) AS unit, licence, {score} AS dice FROM z WHERE {bounds}),
h AS (SELECT * FROM s WHERE dice >= {threshold} UNION ALL SELECT * FROM s2 WHERE dice >= {threshold}),
r AS (SELECT doc_id, first(licence ORDER BY dice DESC, licence) AS licence, max(dice) AS dice, count(DISTINCT unit) AS n_matches,
             string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences FROM h GROUP BY doc_id)
SELECT d.doc_id, r.licence, round(coalesce(r.dice, 0.0), 6) AS dice, coalesce(r.n_matches, 0)::bigint AS n_matches, coalesce(r.licences, '') AS licences
FROM d LEFT JOIN r USING (doc_id)"""


ORACLE_SQL = _oracle()
