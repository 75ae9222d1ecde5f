"""License scan: Dice coefficient over word bigrams between normalised text and templates.

Each line, sentence, paragraph and whole document is compared with the templates whose size
allows the threshold. Parts without any of the words that a match must have go first. Only
bigrams that a template has leave the scan; they meet the templates' bigrams (a fixed small
table) in a broadcast join. DataFrame operations only.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

THRESHOLD = 0.8

# Paragraphs of public licences.
_MIT = [
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
]
_BSD = [
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
]
_ISC = [
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
]
_APACHE = [
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
]
_UNLICENSE = [
    "This is free and unencumbered software released into the public domain.",
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "For more information, please refer to <http://unlicense.org/>",
]
# The notices of the GNU licences, of which each version has its own number.
_GNU_LATER = "This {what} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation{sep} either version {version} of the License, or (at your option) any later version."
_GNU_ONLY = "This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License version {version} as published by the Free Software Foundation."
_GNU = [
    ("GPL-2.0", "program", "", "2"), ("GPL-3.0", "program", "", "3"), ("LGPL-2.1", "library", "Lesser ", "2.1"),
    ("LGPL-3.0", "library", "Lesser ", "3"), ("AGPL-3.0", "program", "Affero ", "3"),
]
# How whole licence texts begin.
_OPENINGS = [
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "Apache License, Version 2.0, January 2004"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0", "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("CC0-1.0", 'The laws of most jurisdictions throughout the world automatically confer exclusive Copyright and Related Rights (defined below) upon the creator and subsequent owner(s) (each and all, an "owner") of an original work of authorship and/or a database (each, a "Work").'),
]
# SPDX identifiers of tags, by the name they are reported as.
_TAGS = {
    "Apache-2.0": ["Apache-2.0"], "MIT": ["MIT"], "ISC": ["ISC"], "GPL-2.0": ["GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later"],
    "GPL-3.0": ["GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"], "LGPL-2.1": ["LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later"],
    "LGPL-3.0": ["LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"], "AGPL-3.0": ["AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"],
    "BSD-2-Clause": ["BSD-2-Clause"], "BSD-3-Clause": ["BSD-3-Clause"], "MPL-2.0": ["MPL-2.0"], "CC-BY-4.0": ["CC-BY-4.0"],
    "CC-BY-SA-4.0": ["CC-BY-SA-4.0"], "CC-BY-NC-4.0": ["CC-BY-NC-4.0"], "CC0-1.0": ["CC0-1.0"], "Unlicense": ["Unlicense"],
}

# Public license notices, by SPDX name.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", " ".join(_APACHE)),
    *[("Apache-2.0", x) for x in _APACHE],
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", " ".join(_MIT)),
    *[("MIT", x) for x in _MIT],
    ("ISC", " ".join(_ISC)),
    *[("ISC", x) for x in _ISC],
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-2-Clause", " ".join(_BSD[:3] + _BSD[4:])),
    ("BSD-3-Clause", " ".join(_BSD)),
    ("BSD-2-Clause", " ".join(_BSD[:3])),
    ("BSD-3-Clause", " ".join(_BSD[:4])),
    ("BSD-3-Clause", _BSD[3]),
    *[("BSD-2-Clause OR BSD-3-Clause", x) for x in (_BSD[0], _BSD[1], _BSD[2], _BSD[4])],
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", " ".join(_UNLICENSE)),
    *[("Unlicense", x) for x in (*_UNLICENSE[:3], _UNLICENSE[4])],
    *[(name, _GNU_LATER.format(what=what, kind=kind, version=version, mark=":" if version == "3" else ";", sep="," if version == "3" else ";")) for name, what, kind, version in _GNU],
    *[(name, _GNU_ONLY.format(what=what, kind=kind, version=version)) for name, what, kind, version in _GNU],
    *_OPENINGS,
    *[(name, f"SPDX-License-Identifier: {tag}") for name, tags in _TAGS.items() for tag in tags],
]
#: Bigrams that tell a version: a template that has such is matched only by what has one of its own.
VERSION = re.compile(r"(?:version|v) [0-9]+")


def _bigrams(text: str) -> Counter:
    words = re.sub(r"[^\w]|_", " ", text.lower()).split()
    return Counter(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))


def template_bigrams(templates: list[tuple[str, str]] = TEMPLATES) -> list[tuple[int, str, str, int, int, int]]:
    """(number, license, bigram, times, bigrams in all, mark) of every template.

    mark is 1 for a bigram that tells the version and for all of a template without such, else 0.
    """
    out = []
    for no, (name, text) in enumerate(templates):
        grams = _bigrams(text)
        marks = {gram for gram in grams if VERSION.fullmatch(gram)} or grams
        out += [(no, name, gram, n, sum(grams.values()), int(gram in marks)) for gram, n in grams.items()]
    return out


#: Letters from which on a word is looked for as it stands; shorter ones are too frequent inside others.
LONG_WORD = 5


def required_words(templates: list[tuple[str, str]], threshold: float = THRESHOLD) -> list[str]:
    """Words of which every part that reaches the threshold with some template holds one at least.

    A match shares t / (2 - t) of the template's bigrams or more, so a template needs words that
    all but fewer of its bigrams hold. Words are taken that serve most templates, short ones only
    where long ones do not suffice.
    """
    grams = [dict(_bigrams(text)) for _, text in templates]
    lack = [sum(g.values()) - math.ceil(sum(g.values()) * threshold / (2 - threshold) - 1e-9) + 1 for g in grams]
    chosen: list[str] = []
    for least in (LONG_WORD, 1):
        while True:
            gain: Counter = Counter()
            for g, open_ in zip(grams, lack, strict=True):
                held: Counter = Counter()
                for gram, n in g.items():
                    held.update({w: n for w in set(gram.split()) if len(w) >= least})
                gain.update({w: min(n, open_) / open_ for w, n in held.items()} if open_ > 0 else {})
            if not gain:
                break
            best = max(gain, key=lambda w: (gain[w], len(w), w))
            chosen.append(best)
            for i, g in enumerate(grams):
                lack[i] -= sum(g.pop(gram) for gram in [x for x in g if best in x.split()])
    return chosen


def _holds_any(text: Column, words: list[str]) -> Column:
    """Whether lower-cased text holds one of the words: long ones anywhere, short ones as words."""
    tests = [F.contains(text, F.lit(w)) for w in words if len(w) >= LONG_WORD]
    short = [re.escape(w) for w in words if len(w) < LONG_WORD]
    if short:
        tests.append(text.rlike(f"(?<![\\p{{L}}\\p{{N}}])(?:{'|'.join(short)})(?![\\p{{L}}\\p{{N}}])"))
    return reduce(Column.__or__, tests)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Matches (row, id_col, unit, license, template, dice, shared): the best template of each matching unit.

    unit is `line N`, `paragraph N` (from 0, parted by blank lines; of two or more lines),
    `sentence N.M` (of paragraph N) or `document` (of several paragraphs).
    Text is lower-cased and everything but letters and digits parts words. Dice is
    2 * shared / (bigrams here + bigrams there), with repeats; a unit is compared only with
    templates of between t / (2 - t) and (2 - t) / t times its bigrams. Of a template that names
    a version ("version 2") that version must be shared, as versions often differ in nothing else.
    Ties go to the first template. `row` numbers the rows of `docs`, so each is judged by itself, repeated rows and
    repeated or null ids too. Null and empty texts match nothing.
    """
    spark: SparkSession = docs.sparkSession
    known = spark.createDataFrame(template_bigrams(templates), "template int, license string, gram string, times int, whole int, mark int")
    ratio = (2 - threshold) / threshold
    sizes = [sum(_bigrams(t).values()) for _, t in templates]
    low, high = min(sizes) / ratio, max(sizes) * ratio
    needed = required_words(templates, threshold)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.lower(text_col).alias("text")).where(_holds_any(F.col("text"), needed))

    def named(parts: Column, kind: str) -> Column:
        return F.transform(parts, lambda x, i: F.struct(F.concat(F.lit(kind), i.cast("string")).alias("unit"), x.alias("part")))

    paragraphs = named(F.split("text", "\n[ \t\r]*\n"), "paragraph ")
    sentences = F.flatten(F.transform(paragraphs, lambda p: F.transform(
        F.split(p["part"], "[.!?][ \t\r\n]+"),
        lambda x, i: F.struct(F.concat(F.replace(p["unit"], F.lit("paragraph"), F.lit("sentence")), F.lit("."), i.cast("string")).alias("unit"), x.alias("part")),
    )))
    several = F.filter(paragraphs, lambda p: F.contains(p["part"], F.lit("\n")))
    parted = F.filter(sentences, lambda p: F.length(p["part"]) > 0)
    whole = F.when(F.size(paragraphs) > 1, F.array(F.struct(F.lit("document").alias("unit"), F.col("text").alias("part")))).otherwise(F.array().cast("array<struct<unit:string,part:string>>"))
    units = rows.select("row", "id", F.inline(F.concat(named(F.split("text", "\n"), "line "), several, parted, whole))).where(_holds_any(F.col("part"), needed))
    words = F.filter(F.split(F.regexp_replace("part", "[^\\p{L}\\p{N}]+", " "), " "), lambda w: w != "")
    sized = units.select("row", "id", "unit", words.alias("words")).withColumn("n", F.size("words") - 1).where((F.col("n") >= low) & (F.col("n") <= high))
    grams = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.concat_ws(" ", F.get("words", i), F.get("words", i + 1)))
    each = sized.select("row", "id", "unit", "n", F.explode(grams).alias("gram"))
    # the templates are a fixed list of some thousand bigrams
    close = (F.col("n") * ratio >= F.col("whole")) & (F.col("n") <= F.col("whole") * ratio)
    met = each.join(F.broadcast(known), "gram").where(close)
    counted = met.groupBy("row", "id", "unit", "n", "template", "license", "gram", "times", "whole", "mark").agg(F.count(F.lit(1)).alias("here"))
    shared = counted.groupBy("row", "id", "unit", "n", "template", "license", "whole").agg(F.sum(F.least("here", "times")).alias("shared"), F.max("mark").alias("mark"))
    dice = 2.0 * F.col("shared") / (F.col("n") + F.col("whole"))
    passed = shared.withColumn("dice", dice).where((F.col("dice") >= threshold) & (F.col("mark") == 1))
    best = passed.groupBy("row", "id", "unit").agg(F.max_by(F.struct("license", "template", "dice", "shared"), F.struct("dice", -F.col("template"))).alias("best"))
    return best.select("row", F.col("id").alias(id_col), "unit", "best.*")


def op8(docs: DataFrame) -> DataFrame:
    """One row per document: its best license, that match's dice, and how many units matched.

    The best match is the one that shares most bigrams, then of greatest dice, then of the first
    template: a whole licence tells more than one of its lines. A document without a match has
    null, 0 and 0. Repeated rows are counted each by itself; rows that share an id share the
    result of the best of them.
    """
    best = F.struct("shared", "dice", -F.col("template"))
    by_row = scan_licenses(docs).groupBy("row", "doc_id").agg(F.max(best).alias("best"), F.max_by("license", best).alias("license"), F.count(F.lit(1)).alias("units"))
    found = by_row.groupBy(F.col("doc_id").alias("of")).agg(
        F.max_by("license", "best").alias("license"), F.max("best").getField("dice").alias("dice"), F.max("units").alias("n_units"),
    )
    rows = docs.select("doc_id")
    return rows.join(found, rows["doc_id"].eqNullSafe(found["of"]), "left").select(
        "doc_id", "license", F.round(F.coalesce("dice", F.lit(0.0)), 6).alias("dice"), F.coalesce("n_units", F.lit(0)).cast("long").alias("n_units"),
    )


def _quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def oracle_op8() -> str:
    """DuckDB SQL for op8."""
    values = ", ".join(f"({no}, {_quote(name)}, {_quote(gram)}, {n}, {whole}, {mark})" for no, name, gram, n, whole, mark in template_bigrams())
    ratio = (2 - THRESHOLD) / THRESHOLD
    return f"""
WITH known(template, license, gram, times, whole, mark) AS (VALUES {values}),
rows AS (SELECT row_number() OVER () AS row, doc_id, lower(text) AS text FROM documents),
paragraphs AS (SELECT row, doc_id, parts[i + 1] AS part, 'paragraph ' || i AS unit, len(parts) AS several
  FROM (SELECT *, unnest(range(len(parts))) AS i FROM (SELECT *, string_split_regex(text, '\\n[ \\t\\r]*\\n') AS parts FROM rows))),
sentences AS (SELECT row, doc_id, parts[i + 1] AS part, replace(unit, 'paragraph', 'sentence') || '.' || i AS unit
  FROM (SELECT *, unnest(range(len(parts))) AS i FROM (SELECT *, string_split_regex(part, '[.!?][ \\t\\r\\n]+') AS parts FROM paragraphs))),
lines AS (SELECT row, doc_id, parts[i + 1] AS part, 'line ' || i AS unit
  FROM (SELECT *, unnest(range(len(parts))) AS i FROM (SELECT *, string_split(text, chr(10)) AS parts FROM rows))),
units AS (SELECT row, doc_id, part, unit FROM lines
  UNION ALL SELECT row, doc_id, part, unit FROM paragraphs WHERE contains(part, chr(10))
  UNION ALL SELECT row, doc_id, part, unit FROM sentences
  UNION ALL SELECT row, doc_id, text, 'document' FROM rows WHERE len(string_split_regex(text, '\\n[ \\t\\r]*\\n')) > 1),
worded AS (SELECT row, doc_id, unit, list_filter(string_split(regexp_replace(part, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '') AS words FROM units),
sized AS (SELECT *, len(words) - 1 AS n FROM worded WHERE len(words) > 1),
grams AS (SELECT row, doc_id, unit, n, words[i] || ' ' || words[i + 1] AS gram FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM sized)),
counted AS (SELECT row, doc_id, unit, n, gram, count(*) AS here FROM grams GROUP BY ALL),
shared AS (SELECT row, doc_id, unit, n, template, license, whole, sum(least(here, times)) AS shared, max(mark) AS mark
  FROM counted JOIN known USING (gram) WHERE n * {ratio}::DOUBLE >= whole AND n <= whole * {ratio}::DOUBLE GROUP BY ALL),
passed AS (SELECT *, 2.0::DOUBLE * shared / (n + whole) AS dice FROM shared WHERE 2.0::DOUBLE * shared / (n + whole) >= {THRESHOLD} AND mark = 1),
best AS (SELECT * FROM passed QUALIFY row_number() OVER (PARTITION BY row, unit ORDER BY dice DESC, template) = 1),
by_row AS (SELECT *, count(*) OVER (PARTITION BY row) AS units FROM best QUALIFY row_number() OVER (PARTITION BY row ORDER BY shared DESC, dice DESC, template) = 1),
docs AS (SELECT *, max(units) OVER (PARTITION BY doc_id) AS n_units FROM by_row QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY shared DESC, dice DESC, template) = 1)
SELECT d.doc_id, license, round(coalesce(dice, 0.0::DOUBLE), 6) AS dice, coalesce(n_units, 0)::BIGINT AS n_units
FROM documents d LEFT JOIN docs ON d.doc_id IS NOT DISTINCT FROM docs.doc_id
"""
