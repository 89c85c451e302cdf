"""Licence scans: lines of text against licence templates by the Dice coefficient over word bigrams.

A unit is a line, the whole text where that has several lines, or a window: as many words as a template has, from a place
where the text holds the first three words of that template, whatever lines they stand on. So notices wrapped over lines,
or inside a paragraph, and licence bodies inside a longer text are units too. All are normalised to lower-case words of
letters and digits. By its number of bigrams a template can reach the threshold only with units of a bounded size, so most
units are dropped by their size before any bigram is made, and the rest meet only the templates that can fit.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

_WARRANTY_BSD = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
    "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_TERMS_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
#: The notices by which common licences are stated, and the bodies of the short ones.
TEMPLATES = {
    "agpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "bsd-2-clause-text": _TERMS_BSD + _WARRANTY_BSD,
    "bsd-3-clause-text": (
        _TERMS_BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission. " + _WARRANTY_BSD
    ),
    "bsd-3-clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl-2.0-header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    ),
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "isc-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH "
        "REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
        "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "lgpl-2.1-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ),
    "mit": "Released under the MIT License.",
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
        "IN THE SOFTWARE."
    ),
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
}
THRESHOLD = 0.8
#: The threshold in whole numbers: a size bound in doubles would drop units that reach it exactly.
TENTHS = 8
#: Words of a template that open a window.
OPENING = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(lowered: Column) -> Column:
    return F.regexp_extract_all(lowered, F.lit("[a-z0-9]+"), 0)


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed a single time."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def bigrams(words: Column) -> Column:
    """The set of pairs of neighbouring words."""
    pairs = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1)))
    return F.when(F.size(words) > 1, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def template_words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def openings() -> list[tuple[str, int]]:
    """The distinct (first words, number of words) of the templates."""
    every = [template_words(x) for x in TEMPLATES.values()]
    return sorted({(" ".join(w[:OPENING]), len(w)) for w in every})


def windows(spaced: Column) -> Column:
    """The words of every window of a text given as words with one space around each.

    A window ends with the text where that has fewer words left. The look-ahead lets windows overlap.
    """
    none, cuts = F.array().cast("array<string>"), []
    for first, size in openings():
        pattern = f"(?<= )(?=({first}(?: [a-z0-9]++){{0,{size - OPENING}}}+) )"
        cuts.append(F.when(F.contains(spaced, F.lit(f" {first} ")), F.regexp_extract_all(spaced, F.lit(pattern), 1)).otherwise(none))
    return F.transform(F.flatten(F.array(*cuts)), lambda s: F.split(s, " "))


def template_pairs(text: str) -> list[str]:
    w = template_words(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])})


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, license, dice, n_matches) of every row.

    ``license`` is the template with the highest coefficient in the text, the first by name among equals, null if none
    reaches the threshold; ``dice`` its coefficient, ``n_matches`` the number of units that match some template (a notice
    that fills a line counts as a line and as a window). Null and empty texts match nothing. Each row is judged by its own
    text, so repeated rows give repeated rows.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    sizes = [len(template_pairs(x)) for x in TEMPLATES.values()]
    # With p and t bigrams the coefficient is at most 2 min(p, t) / (p + t).
    low, high = -(-TENTHS * min(sizes) // (20 - TENTHS)), (20 - TENTHS) * max(sizes) // TENTHS
    # A unit of n distinct bigrams has more than n words and may repeat some: only the lower bound holds for words.
    table = F.array(*[F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, template_pairs(x))).alias("pairs")) for name, x in TEMPLATES.items()])

    def against(p: Column) -> Column:
        def fits(x: Column) -> Column:
            return 20 * F.least(F.size(p), F.size(x["pairs"])) >= TENTHS * (F.size(p) + F.size(x["pairs"]))

        fitting = F.filter(table, fits)
        scores = F.transform(
            fitting,
            lambda x: F.struct((F.lit(2.0) * F.size(F.array_intersect(p, x["pairs"])) / (F.size(p) + F.size(x["pairs"]))).alias("dice"), x["name"].alias("name")),
        )
        return F.filter(scores, lambda s: s["dice"] >= THRESHOLD)

    def matches(lowered: Column) -> Column:
        lines = F.split(lowered, "\n")
        units = F.when(F.size(lines) > 1, F.concat(lines, F.array(lowered))).otherwise(lines)
        spaced = F.concat(F.lit(" "), F.trim(F.regexp_replace(lowered, "[^a-z0-9]+", " ")), F.lit(" "))
        wordy = F.filter(F.concat(F.transform(units, words_of), once(spaced, windows)), lambda w: F.size(w) > low)
        sets = F.filter(F.transform(wordy, bigrams), lambda p: (F.size(p) >= low) & (F.size(p) <= high))
        return F.filter(F.transform(sets, against), lambda s: F.size(s) > 0)

    found = docs.select("doc_id", F.explode(F.array(once(F.translate(t, UPPER, LOWER), matches))).alias("found"))
    flat = F.flatten("found")
    top = F.array_max(F.transform(flat, lambda s: s["dice"]))
    found = found.withColumn("dice", top)
    name = F.array_min(F.transform(F.filter(flat, lambda s: s["dice"] == F.col("dice")), lambda s: s["name"]))
    return found.select("doc_id", name.alias("license"), "dice", F.size("found").cast("long").alias("n_matches"))


def oracle(docs: str = "documents") -> str:
    """The same scan in SQL, without the size bounds."""
    rows = ", ".join("('{}', [{}])".format(n, ", ".join("'" + p.replace("'", "''") + "'" for p in template_pairs(x))) for n, x in TEMPLATES.items())
    starts = ", ".join(f"('{first}', {size})" for first, size in openings())
    return f"""
WITH t(name, pairs) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM {docs}),
l AS (SELECT r, text, string_split(text, chr(10)) AS lines FROM d),
u AS (SELECT r, unnest(CASE WHEN len(lines) > 1 THEN list_concat(lines, [text]) ELSE lines END) AS unit FROM l),
o(opening, size) AS (VALUES {starts}),
a AS (SELECT r, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-z0-9]+') AS w FROM l),
g AS (SELECT r, w, unnest(list_filter(range(1, len(w) - {OPENING - 2}), lambda i: list_contains([{", ".join(repr(first) for first in sorted({f for f, _ in openings()}))}], {" || ' ' || ".join(f"w[i + {k}]" for k in range(OPENING))}))) AS i FROM a),
c AS (SELECT r, w[i : i + size - 1] AS w FROM g JOIN o ON opening = {" || ' ' || ".join(f"w[i + {k}]" for k in range(OPENING))}),
w AS (SELECT r, row_number() OVER () AS n, w FROM (SELECT r, regexp_extract_all(translate(unit, '{UPPER}', '{LOWER}'), '[a-z0-9]+') AS w FROM u UNION ALL SELECT r, w FROM c)),
p AS (SELECT r, n, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS p FROM w WHERE len(w) > 1),
s AS (SELECT r, n, name, 2.0::DOUBLE * len(list_intersect(p, pairs)) / (len(p) + len(pairs)) AS dice FROM p, t),
h AS (SELECT * FROM s WHERE dice >= {THRESHOLD}),
b AS (SELECT r, max(dice) AS dice, count(DISTINCT n) AS n_matches FROM h GROUP BY r),
m AS (SELECT h.r, min(name) AS license FROM h JOIN b ON h.r = b.r AND h.dice = b.dice GROUP BY h.r)
SELECT doc_id, license, dice, coalesce(n_matches, 0)::BIGINT AS n_matches FROM d LEFT JOIN b USING (r) LEFT JOIN m USING (r)
"""
