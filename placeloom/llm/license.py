"""Licence scan: Dice coefficient over word bigrams against licence templates.

Texts are normalised (lower case, runs of anything but a-z and 0-9 become one
space) and compared to each template by the Dice coefficient of their sets of
word bigrams.  Four kinds of units are compared: sentences of lines,
paragraphs, whole texts, and windows of consecutive lines.  Lines without a
letter or digit separate nothing inside a window, so a licence of several
paragraphs is found in a larger file.  A window begins and ends at a line with
an anchor word of a template of ``WINDOW_LEAST`` bigrams or more, and has at
most as many words as the size bounds leave for the longest of these templates.

Size bounds prune templates: with a Dice of t the sizes differ by at most a
factor t / (2 - t).  A unit must also hold enough bigrams of a template, so a
template's anchor words (chosen so that what lacks them can't reach t) skip
texts early without loss.  Built-in functions only.

The templates hold the whole text of short licences, the standard headers of
long ones and one-line notices; ``templates`` takes others, and templates of
more than ``WINDOW_MOST`` bigrams are compared with paragraphs and whole texts only.

Defined cases: null, empty and one-word texts have no bigram and match
nothing; ties go to the first template id; repeated rows give repeated counts
only through ``n_units`` of their shared id; an empty table gives no row; very
long texts are cut into units like any other; other columns are not read.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without
restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE
AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission
notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES
OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL3 = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3
of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must
retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution. {}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE
LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. """
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is
granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this
software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated
but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any
source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code
form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
#: (template id, licence, text): whole short licences, standard file headers and one-line notices.
TEMPLATES = [
    ("bsd-2-text", "BSD-2-Clause", _BSD.format("")), ("bsd-3-text", "BSD-3-Clause", _BSD.format(_BSD3)), ("zlib-text", "Zlib", _ZLIB), ("unlicense-text", "Unlicense", _UNLICENSE),
    ("mit-text", "MIT", _MIT), ("isc-text", "ISC", _ISC), ("apache-2.0-header", "Apache-2.0", _APACHE), ("gpl-3.0-header", "GPL-3.0", _GPL3),
    ("gpl-2.0-header", "GPL-2.0", _GPL3.replace("version 3", "version 2")),
    ("lgpl-3.0-header", "LGPL-3.0", _GPL3.replace("General Public", "Lesser General Public")),
    ("agpl-3.0-header", "AGPL-3.0", _GPL3.replace("General Public", "Affero General Public")),
    ("mpl-2.0-header", "MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("mit-notice", "MIT", "Released under the MIT License."), ("mit-notice-2", "MIT", "Licensed under the MIT License."),
    ("apache-2.0-notice", "Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("gpl-3.0-notice", "GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-2.0-notice", "GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("lgpl-notice", "LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("bsd-3-notice", "BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("mpl-2.0-notice", "MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("cc-by-nc-4.0-notice", "CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("cc-by-sa-4.0-notice", "CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-4.0-notice", "CC-BY-4.0", "Licensed under CC BY 4.0."), ("cc0-notice", "CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("cc-by-nc-4.0-long", "CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa-4.0-long", "CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-4.0-long", "CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
]
THRESHOLD = 0.85
#: Bigrams of the templates that windows of lines are made for.
WINDOW_LEAST, WINDOW_MOST = 30, 1000
_PLAIN = frozenset("the of and to in a an is be or any this that for by with on you it not as at if may can was one from all no".split())


def words_of(text: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w]


def bigrams_of(text: str) -> list[str]:
    w = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})


def anchors(templates=TEMPLATES, threshold: float = THRESHOLD) -> list[str]:
    """Words of which every text that reaches the threshold with some template holds one.

    A match shares at least t / (2 - t) of a template's bigrams; words are added,
    the widest-used first, until the bigrams without any of them are fewer than that.
    """
    need = {}
    for name, _, text in templates:
        b = bigrams_of(text)
        need[name] = (b, math.ceil(round(threshold / (2 - threshold) * len(b), 9)))
    chosen: list[str] = []
    while True:
        left = {k: [g for g in b if not set(g.split()) & set(chosen)] for k, (b, n) in need.items()}
        left = {k: g for k, g in left.items() if len(g) >= need[k][1]}
        if not left:
            return sorted(chosen)
        score: dict[str, float] = {}
        for k, gs in left.items():
            for g in gs:
                for w in set(g.split()) - _PLAIN:
                    score[w] = score.get(w, 0) + 1 / len(need[k][0])
        chosen.append(max(sorted(score), key=lambda w: (score[w], len(w))) if score else max(gs[0].split()))


def _bigrams(text: Column) -> Column:
    """Distinct word bigrams; the word array is bound to a lambda variable so that it is made once."""
    words = F.array_remove(F.split(F.lower(text), r"[^a-z0-9]+"), "")
    pairs = F.transform(F.array(words), lambda w: F.slice(F.transform(w, lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1))), 1, F.greatest(F.size(w) - 1, F.lit(0))))
    return F.array_distinct(F.element_at(pairs, 1))


def _pattern(words: list[str], before: str, after: str) -> str:
    return before + "(?:" + "|".join(map(re.escape, words)) + ")" + after


def _spanned(templates, threshold: float) -> tuple[list[str], int]:
    """Anchor words of the templates that windows are made for, and the words that a window has at most."""
    long = [t for t in templates if WINDOW_LEAST <= len(bigrams_of(t[2])) <= WINDOW_MOST]
    if not long:
        return [], 0
    return anchors(long, threshold), math.floor(max(len(bigrams_of(t)) for *_, t in long) * (2 - threshold) / threshold) + 1


def _windows(text: Column, words: list[str], most: int) -> Column:
    """Array of (lines, ends): for each line with an anchor word the lines from there on, at most ``most``, and the places behind the later anchored ones."""
    lines = F.filter(F.split(text, r"\n"), lambda x: x.rlike("[A-Za-z0-9]"))
    pattern = _pattern(words, r"(?<![a-z0-9])", r"(?![a-z0-9])")

    def of(x):
        anchored = F.filter(F.transform(x, lambda v, i: F.when(F.lower(v).rlike(pattern), i)), lambda i: i.isNotNull())

        def spans(at):
            return F.transform(at, lambda i, p: F.struct(F.slice(x, i + 1, most).alias("lines"), F.filter(F.transform(F.slice(at, p + 2, most), lambda j: j - i + 1), lambda n: n <= most).alias("ends")))

        return F.element_at(F.transform(F.array(anchored), spans), 1)

    return F.element_at(F.transform(F.array(lines), of), 1)


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, unit, spans, template, licence, dice): the best template of every unit that reaches the threshold.

    ``unit`` is the unit's own text; ``spans`` tells windows of lines, which overlap, from the others.
    """
    spark = docs.sparkSession
    rows = [(name, lic, len(b), b) for name, lic, t in templates if (b := bigrams_of(t))]
    tpl = spark.createDataFrame(rows, "template string, licence string, size int, grams array<string>")
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    least, most = min(r[2] for r in rows) * low, max(r[2] for r in rows) * high
    pattern = _pattern(anchors(templates, threshold), r"(?<![a-z0-9])", r"(?![a-z0-9])")
    d = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("t")).where(F.lower("t").rlike(pattern))
    units = F.array_distinct(F.concat(F.split("t", r"\n|(?<=[.!?])\s+"), F.split("t", r"\n\s*\n"), F.array("t")))
    u = d.select("doc_id", F.explode(units).alias("unit"), F.lit(False).alias("spans")).where(F.lower("unit").rlike(pattern))
    words, longest = _spanned(templates, threshold)
    if words:
        some = d.where(F.lower("t").rlike(_pattern(words, r"(?<![a-z0-9])", r"(?![a-z0-9])")))
        w = some.select("doc_id", F.explode(_windows(F.col("t"), words, longest)).alias("w")).select("doc_id", "w.lines", F.explode("w.ends").alias("end"))
        w = w.select("doc_id", F.array_join(F.slice("lines", F.lit(1), F.col("end")), " ").alias("unit")).where(F.regexp_count(F.lower("unit"), F.lit("[a-z0-9]+")) <= longest)
        u = u.unionByName(w.withColumn("spans", F.lit(True)))
    u = u.select("doc_id", "unit", "spans", _bigrams(F.col("unit")).alias("grams")).where((F.size("grams") >= least) & (F.size("grams") <= most))
    # one row for each template that the size bounds leave; a constant number of templates
    fits = u.join(F.broadcast(tpl.withColumnRenamed("grams", "theirs")), (F.size("grams") >= F.col("size") * low) & (F.size("grams") <= F.col("size") * high))
    dice = 2 * F.size(F.array_intersect("grams", "theirs")) / (F.size("grams") + F.col("size"))
    hit = fits.select("doc_id", "unit", "spans", "template", "licence", dice.alias("dice")).where(F.col("dice") >= threshold)
    best = F.min(F.struct((-F.col("dice")).alias("d"), "template", "licence")).alias("b")
    return hit.groupBy("doc_id", "unit", "spans").agg(best).select("doc_id", "unit", "spans", "b.template", "b.licence", (-F.col("b.d")).alias("dice"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and licence found in it; all windows of lines together count as one unit."""
    s = scan(read(spark, sf_dir, "documents"))
    n = F.count_if(~F.col("spans")) + F.max(F.col("spans").cast("long"))
    return s.groupBy("doc_id", "licence").agg(F.round(F.max("dice"), 6).alias("dice"), n.alias("n_units"))


def op3_sql() -> str:
    """Every unit of every text against every template, without anchors (but for the windows, which they delimit) or size bounds."""
    values = ",\n  ".join("('{}', '{}', '{}')".format(n, lic, t.replace("'", "''").replace("\n", " ")) for n, lic, t in TEMPLATES)
    grams = "list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))"
    words = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda x: x <> '')"
    anchored, most = _spanned(TEMPLATES, THRESHOLD)
    pattern = _pattern(anchored, "(^|[^a-z0-9])", "([^a-z0-9]|$)")
    return rf"""
WITH t(template, licence, body) AS (VALUES {values}
), tw AS (SELECT template, licence, {words.format("body")} AS ws FROM t
), tg AS (SELECT template, licence, {grams} AS g FROM tw
), l AS (
  SELECT doc_id, text, unnest(regexp_split_to_array(text, '\n')) AS line FROM documents
), x AS (
  SELECT doc_id, list_filter(regexp_split_to_array(text, '\n'), lambda v: regexp_matches(v, '[A-Za-z0-9]')) AS ls FROM documents
), y AS (
  SELECT doc_id, ls, list_filter(range(1, len(ls) + 1), lambda i: regexp_matches(lower(ls[i]), '{pattern}')) AS hits FROM x
), z AS (
  SELECT doc_id, ls, i, unnest(list_filter(hits, lambda j: j > i AND j - i < {most})) AS j FROM (SELECT doc_id, ls, hits, unnest(hits) AS i FROM y)
), u AS (
  SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(line, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS unit, false AS spans FROM l
  UNION SELECT doc_id, unnest(regexp_split_to_array(text, '\n\s*\n')), false FROM documents
  UNION SELECT doc_id, text, false FROM documents
  UNION SELECT doc_id, array_to_string(ls[i:j], ' '), true FROM z
), uw AS (SELECT doc_id, unit, spans, {words.format("unit")} AS ws FROM u
), ug AS (SELECT doc_id, unit, spans, {grams} AS g FROM uw WHERE len(ws) > 1 AND (NOT spans OR len(ws) <= {most})
), m AS (
  SELECT doc_id, unit, spans, template, licence, 2.0::DOUBLE * len(list_intersect(ug.g, tg.g)) / (len(ug.g) + len(tg.g)) AS dice FROM ug, tg
), b AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, unit, spans ORDER BY dice DESC, template) AS rn FROM m WHERE dice >= {THRESHOLD}
)
SELECT doc_id, licence, round(max(dice), 6) AS dice, count(*) FILTER (WHERE NOT spans) + max(CASE WHEN spans THEN 1 ELSE 0 END) AS n_units FROM b WHERE rn = 1 GROUP BY doc_id, licence
"""
