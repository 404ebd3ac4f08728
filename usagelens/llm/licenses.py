"""Licence scans: Dice coefficient over word bigrams against templates. DataFrame functions only.

Text is normalised (lower case, runs of other characters than letters and digits become one
space). Units of a document are the whole text, its paragraphs and its lines; a unit that
equals a larger unit of the document in its words is judged once. A unit with b bigrams can
reach a Dice coefficient of t with a template of n bigrams only if t/(2-t) <= b/n <= (2-t)/t, so
these bounds choose the templates with which it is compared at all. It must also hold at least
t/(2-t) of the template's bigrams, so of any set of them larger than the rest at least one: texts
and units without any of the words that touch such a set (`anchors`) are passed over. Both
bounds are exact; nothing that can reach the threshold is left out.

One row per unit and licence at or over the threshold: doc_id, unit (document, paragraph,
line), unit_no (from 0), license, n_bigrams, dice. Of several templates of one licence the best
counts; where a unit reaches several licences (two- and three-clause texts are much alike), each
has its row. Defined results: a null or empty text has
no rows, neither has a unit with fewer than two words; repeated rows each give their rows; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
#: Characters of a unit that are looked at before the whole of it.
HEAD = 6000
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_REDISTRIBUTION = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_ENDORSE = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_HOLDERS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_REST = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'
_GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
#: Short notices, opening terms, paragraphs and whole texts of common licences.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", _APACHE + ' You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", _GRANT),
    ("MIT", " ".join(["MIT License Copyright (c)", _GRANT, _NOTICE, _AS_IS])),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License v3.0."),
    ("GPL-3.0", _GPL),
    ("GPL-3.0", _GPL + " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause OR BSD-3-Clause", _REDISTRIBUTION),
    ("BSD-2-Clause", " ".join(["Copyright (c) All rights reserved.", _REDISTRIBUTION, _SOURCE, _BINARY, _HOLDERS])),
    ("BSD-3-Clause", _ENDORSE),
    ("BSD-3-Clause", " ".join(["Copyright (c) All rights reserved.", _REDISTRIBUTION, _SOURCE, _BINARY, _ENDORSE, _HOLDERS])),
    ("ISC", _ISC),
    ("ISC", " ".join(["ISC License Copyright (c)", _ISC, _ISC_REST])),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def normalised(text: str) -> list[str]:
    return re.sub(r"[^\w]+|_", " ", text.lower()).split()


def grams(words: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def bigrams(words: Column) -> Column:
    pairs = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words)), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(pairs)


def whole(threshold: float) -> tuple[int, int]:
    """The threshold as p of q: bounds in whole numbers keep exact ties."""
    exact = Fraction(str(threshold))
    return exact.numerator, exact.denominator


def anchors(templates: list[list[str]], threshold: float) -> list[str]:
    """Words of which a unit holds at least one if it reaches the threshold with a template."""
    p, q = whole(threshold)
    chosen: set[str] = set()
    for known in templates:
        left = list(known)
        while left and len(left) * (2 * q - p) >= len(known) * p:
            touched = {w: sum(w in g.split() for g in left) for g in left for w in g.split()}
            # long words first: they are rare in other texts
            word = max(touched, key=lambda w: (w in chosen, len(w) >= 5, len(w) * touched[w], w))
            chosen.add(word)
            left = [g for g in left if word not in g.split()]
    return sorted(chosen)


def any_of(text: Column, words: list[str]) -> Column:
    # the lambda lets the lower-cased text be made once
    return F.exists(F.array(F.lower(text)), lambda low: reduce(lambda a, b: a | b, [low.contains(w) for w in words]))


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    p, q = whole(threshold)
    known = [(name, grams(normalised(text))) for name, text in templates]
    sizes = [len(g) for _, g in known]
    literal = F.array(
        *[F.struct(F.lit(k).alias("name"), F.lit(len(g)).alias("n"), F.array(*map(F.lit, g)).alias("g")) for k, g in known]
    )
    most = max(sizes) * (2 * q - p) // p
    part = lambda kind, texts: F.transform(
        texts, lambda x, i: F.struct(F.lit(kind).alias("unit"), i.cast("long").alias("unit_no"), x.alias("t"))
    )
    lines, paragraphs = F.split("text", "\n"), F.split("text", "\n[ \t\r]*\n\\s*")
    words = anchors([g for _, g in known], threshold)
    d = docs.where("text <> ''").where(any_of(F.col("text"), words)).select("doc_id", "text", lines.alias("ls"), paragraphs.alias("ps"))
    d = d.select(
        "doc_id",
        F.explode(
            F.concat(
                # a whole text or paragraph of one line is that line
                F.when(F.size("ls") > 1, part("document", F.array("text"))).otherwise(F.array()),
                F.when(F.size("ps") > 1, F.filter(part("paragraph", F.col("ps")), lambda x: x["t"].contains("\n"))).otherwise(F.array()),
                part("line", F.col("ls")),
            )
        ).alias("u"),
    ).select("doc_id", "u.*").where(any_of(F.col("u.t"), words))
    # n bigrams hold n + 1 words at most, however often these are repeated; a long unit's beginning, all but
    # the word that it may cut, shows most of those that hold more
    few = lambda words, n: F.size(F.array_distinct(words)) <= n
    d = d.where(F.when(F.length("t") > HEAD, few(words_of(F.substring("t", 1, HEAD)), most + 2)).otherwise(True))
    # the transform over a one-element array lets the words be made once
    made = F.transform(F.array(words_of(F.col("t"))), lambda w: F.when((F.size(w) >= 2) & few(w, most + 1), bigrams(w)))
    d = d.select("doc_id", "unit", "unit_no", F.explode(made).alias("b")).where("b is not null").withColumn("n", F.size("b"))
    d = d.where((F.col("n") * (2 * q - p) >= p * min(sizes)) & (F.col("n") <= most))
    fits = F.filter(literal, lambda t: p * (F.col("n") + t["n"]) <= 2 * q * F.least(F.col("n"), t["n"]))
    scored = F.transform(
        fits,
        lambda t: F.struct(
            t["name"].alias("license"),
            (2.0 * F.size(F.array_intersect(F.col("b"), t["g"])) / (F.col("n") + t["n"])).alias("dice"),
        ),
    )
    # of the templates of one licence the best one counts; within the row, so equal rows keep their own results
    reached = F.filter(scored, lambda x: x["dice"] >= threshold)
    ranked = F.array_sort(F.transform(reached, lambda x: F.struct(x["license"].alias("license"), (-x["dice"]).alias("dice"))))
    best = lambda all_: F.filter(all_, lambda x, i: ~F.coalesce(F.get(all_, i - 1)["license"] == x["license"], F.lit(False)))
    d = d.select("doc_id", "unit", "unit_no", "n", F.explode(F.flatten(F.transform(F.array(ranked), best))).alias("m"))
    return d.select("doc_id", "unit", "unit_no", F.col("m.license").alias("license"), F.col("n").cast("long").alias("n_bigrams"), (-F.col("m.dice")).alias("dice"))


def op9(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


_VALUES = ", ".join(f"({i}, '{k}', '{g.replace(chr(39), chr(39) * 2)}')" for i, (k, t) in enumerate(TEMPLATES) for g in grams(normalised(t)))

#: Here every unit meets every template, without size bounds.
ORACLE = rf"""
WITH t(id, license, g) AS (VALUES {_VALUES}), tn AS (SELECT id, any_value(license) AS license, count(*) AS n FROM t GROUP BY id),
d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls, regexp_split_to_array(text, '\n[ \t\r]*\n\s*') AS ps FROM documents WHERE text <> ''),
u AS (SELECT doc_id, 'document' AS unit, 0 AS unit_no, text AS t FROM d WHERE len(ls) > 1
  UNION ALL SELECT doc_id, 'paragraph', i - 1, ps[i] FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM d WHERE len(ps) > 1) WHERE contains(ps[i], chr(10))
  UNION ALL SELECT doc_id, 'line', i - 1, ls[i] FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
w AS (SELECT doc_id, unit, unit_no, list_filter(regexp_split_to_array(lower(t), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM u),
b AS (SELECT DISTINCT doc_id, unit, unit_no, w[i] || ' ' || w[i + 1] AS g FROM (SELECT *, unnest(range(1, len(w))) AS i FROM w)),
bn AS (SELECT doc_id, unit, unit_no, count(*) AS n FROM b GROUP BY ALL),
hit AS (SELECT b.doc_id, b.unit, b.unit_no, t.id, count(*) AS c FROM b JOIN t USING (g) GROUP BY ALL)
SELECT doc_id, unit, unit_no::BIGINT AS unit_no, license, bn.n::BIGINT AS n_bigrams, max(2.0::DOUBLE * c / (bn.n + tn.n)) AS dice
FROM hit JOIN bn USING (doc_id, unit, unit_no) JOIN tn USING (id) WHERE 2.0::DOUBLE * c / (bn.n + tn.n) >= 0.8
GROUP BY ALL
"""
