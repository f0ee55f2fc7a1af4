"""Licence scans, in DataFrame functions only.

The units of a file are its lines, its blocks (lines up to one without a letter or digit,
so also the paragraphs of a comment header) and the whole file.  Each is compared with
licence templates by the cosine of sparse TF-IDF vectors; document frequencies are those
of the whole corpus.  SPDX tags name their licence themselves.  A file whose licence units
make up enough of its words is a licence file and governs its directory; files without a
licence of their own inherit that of the nearest directory above.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window, functions as F

from reqsift.llm.common import LOWER, UPPER, let, whole_text
from reqsift.workspace import materialize

#: Usual notices, headers and texts by SPDX identifier.
_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
    "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS "
    "OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
    "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so, subject to the following conditions:"
)
_MIT_NOTICE = (
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met:"
)
_BSD_TWO = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
    "disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
    "following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_THIRD = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission."
)
_BSD_AS_IS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
    "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
    "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies."
)
_APACHE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
    "License. You may obtain a copy of the License at"
)
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published "
    "by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
)
_MPL = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
    "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
)
_UNLICENSE = "This is free and unencumbered software released into the public domain."
TEMPLATES = (
    ("AGPL-3.0", _GNU.format(name="Affero General Public License", version=3)),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", _APACHE),
    ("BSD-2-Clause", " ".join((_BSD, _BSD_TWO, _BSD_AS_IS))),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("BSD-3-Clause", _BSD_THIRD),
    ("BSD-3-Clause", " ".join((_BSD, _BSD_TWO, _BSD_THIRD, _BSD_AS_IS))),
    ("CC-BY-4.0", "Licensed under the Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-2.0", _GNU.format(name="General Public License", version=2)),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _GNU.format(name="General Public License", version=3)),
    ("ISC", _ISC),
    ("LGPL-3.0", _GNU.format(name="Lesser General Public License", version=3)),
    ("MIT", "Released under the MIT License."),
    ("MIT", _MIT),
    ("MIT", " ".join((_MIT, _MIT_NOTICE, _AS_IS))),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", _MPL),
    ("Proprietary", "All rights reserved."),
    ("Unlicense", _UNLICENSE),
)
#: An SPDX tag with its expression, and what parts the blocks of a text.
TAG = r"SPDX-License-Identifier:[ \t]*\(?([A-Za-z0-9.+-]+(?: (?:AND|OR|WITH) [A-Za-z0-9.+-]+)*)"
BETWEEN = r"\n[^A-Za-z0-9]*\n"
#: Sorts of units.
LINE_UNIT, BLOCK_UNIT, FILE_UNIT, TAG_UNIT = range(4)
#: Least cosine of a licence unit, and least share of licence units' words in a licence file.
#: Terms in a larger share of documents than COMMON tell no licence's units apart cheaply.
LINE, FILE, COMMON = 0.75, 0.5, 0.01


def terms(text: Column) -> Column:
    """Runs of ASCII letters and digits, lower-cased, in order."""
    return F.filter(F.split(F.translate(text, UPPER, LOWER), "[^a-z0-9]+"), lambda t: t != "")


def _terms(text: str) -> list[str]:
    import re

    return re.findall("[a-z0-9]+", text.lower())


def weights(docs: DataFrame, templates=TEMPLATES) -> tuple[dict[str, float], float]:
    """Inverse document frequency of each template term over all of ``docs``, and of a term met nowhere.

    The vocabulary is the templates', so only as many counts come to the driver.
    """
    vocabulary = sorted({t for _, body in templates for t in _terms(body)})
    known = F.array(*map(F.lit, vocabulary))
    met = docs.select(F.explode(F.array_intersect(terms(whole_text(F.col("text"))), known)).alias("term"))
    counted = {r.term: r.n for r in met.groupBy("term").agg(F.count("*").alias("n")).collect()}
    n = docs.count()
    return {t: math.log((n + 1) / (counted.get(t, 0) + 1)) + 1 for t in vocabulary}, math.log(n + 1) + 1


def _vectors(templates, idf: dict[str, float]) -> list[tuple[str, dict[str, float]]]:
    """Unit vectors of the templates."""
    out = []
    for name, body in templates:
        vector = {t: k * idf[t] for t, k in Counter(_terms(body)).items()}
        norm = math.sqrt(sum(w * w for w in vector.values()))
        out.append((name, {t: w / norm for t, w in vector.items()}))
    return out


def _anchors(vectors, idf: dict[str, float], least: float) -> set[str]:
    """Terms of which a unit must hold one to reach ``least`` with any template.

    Without the anchors, what is left of a template's unit vector is shorter than
    ``least``, and so is every cosine with it.  Rare terms are taken first.
    """
    anchors = set()
    for _, vector in vectors:
        left = 1.0
        for term, w in sorted(vector.items(), key=lambda x: (idf[x[0]] < 1 - math.log(COMMON), -x[1])):
            if left < (0.99 * least) ** 2:
                break
            anchors.add(term)
            left -= w * w
    return anchors


UNITS = "array<struct<sort:int,score:double,licence:string,words:int>>"


def _table(values: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for pair in sorted(values.items()) for x in pair])


def units(text: Column) -> Column:
    """``array<struct<sort, body>>``: the lines, the blocks of two lines and more, and the file if of several blocks."""

    def of(sort: int, bodies: Column) -> Column:
        return F.transform(bodies, lambda body: F.struct(F.lit(sort).alias("sort"), body.alias("body")))

    blocks = F.split(text, BETWEEN, -1)
    whole = F.when(text.rlike(BETWEEN), F.array(text)).otherwise(F.array().cast("array<string>"))
    return F.concat(
        of(LINE_UNIT, F.split(text, "\n", -1)),
        of(BLOCK_UNIT, F.filter(blocks, lambda block: F.instr(block, "\n") > 0)),
        of(FILE_UNIT, whole),
    )


def tags(text: Column) -> Column:
    """The SPDX tags of a text in the form of :func:`unit_licences`, with a score of 1."""

    def unit(licence: Column) -> Column:
        words = F.size(terms(licence)) + 3
        return F.struct(F.lit(TAG_UNIT).alias("sort"), F.lit(1.0).alias("score"), licence.alias("licence"), words.alias("words"))

    named = F.regexp_extract_all(text, F.lit(TAG), F.lit(1))
    return F.when(F.instr(text, "SPDX-License-Identifier:") > 0, F.transform(named, unit)).otherwise(F.array().cast(UNITS))


def unit_licences(text: Column, idf: dict[str, float], unseen: float, templates=TEMPLATES, least: float = LINE) -> Column:
    """``array<struct<sort, score, licence, words>>`` of the licence units of a text, in order.

    Each takes its best template, of equal scores the last by name; ``words`` counts terms.
    """
    vectors = _vectors(templates, idf)
    some = r"(?i)(?<![A-Za-z0-9])(" + "|".join(sorted(_anchors(vectors, idf, least))) + r")(?![A-Za-z0-9])"
    table = _table(idf)

    def weight(term: Column) -> Column:
        return F.coalesce(F.element_at(table, term), F.lit(unseen))

    def square(in_order: Column) -> Column:
        """Squared length of the line's vector, from its terms in sorted order."""
        start = F.struct(F.lit("").alias("term"), F.lit(0).alias("run"), F.lit(0.0).alias("sum"))

        def step(a: Column, t: Column) -> Column:
            run = F.when(a["term"] == t, a["run"] + 1).otherwise(F.lit(1))
            more = (2 * run - 1) * weight(t) * weight(t)
            return F.struct(t.alias("term"), run.alias("run"), (a["sum"] + more).alias("sum"))

        return F.aggregate(in_order, start, step)["sum"]

    def best(sort: Column, ts: Column) -> Column:
        norm = F.sqrt(square(F.sort_array(ts)))
        known = F.filter(ts, lambda t: F.element_at(table, t).isNotNull())

        def product(known: Column, own: Column) -> Column:
            return F.aggregate(
                known, F.lit(0.0), lambda s, t: s + weight(t) * F.coalesce(F.element_at(own, t), F.lit(0.0))
            )

        def scored(line: Column) -> Column:
            each = []
            for name, vector in vectors:
                score = F.round(product(line["known"], _table(vector)) / line["norm"], 6)
                each.append(F.struct(score.alias("score"), F.lit(name).alias("licence")))
            return F.array_max(F.array(*each))

        found = let(F.struct(norm.alias("norm"), known.alias("known")), scored)
        return let(
            found,
            lambda b: F.struct(
                sort.alias("sort"), b["score"].alias("score"), b["licence"].alias("licence"), F.size(ts).alias("words")
            ),
        )

    likely = F.filter(units(text), lambda u: u["body"].rlike(some))
    scored = F.transform(likely, lambda u: let(terms(u["body"]), lambda ts: best(u["sort"], ts)))
    return F.when(text.rlike(some), F.filter(scored, lambda s: s["score"] >= least)).otherwise(F.array().cast(UNITS))


def scan(files: DataFrame, templates=TEMPLATES, line: float = LINE, file: float = FILE) -> DataFrame:
    """``(doc_id, path, licence, origin, score, governed_by)`` for every row of ``files(doc_id, path, text, …)``.

    ``origin`` is ``own`` (a licence unit or tag of the file itself, the best by score and
    name), ``inherited`` (of the nearest directory with a licence file, named in
    ``governed_by``; of several files there the best by score, share of words, then
    smallest path) or ``none`` with a null licence.

    ``templates`` are pairs or a table ``(licence, body)``; it is a table of fixed texts, so
    it comes to the driver and must not hold more than a thousand.  The share of a file's
    words is the largest of those of its licence lines, blocks, the file itself and its tags.

    A null text has no units; a null path lies in no directory, so it inherits nothing;
    repeated rows are scanned each for itself; other columns are ignored; empty tables
    give no rows.
    """
    if isinstance(templates, DataFrame):
        rows = templates.select("licence", "body").dropna().distinct().limit(1001).collect()
        if len(rows) > 1000:
            raise ValueError("more than a thousand templates")
        templates = sorted(map(tuple, rows))
    idf, unseen = weights(files, templates)
    text = whole_text(F.col("text"))
    found = files.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("path").cast("string").alias("path"),
        F.concat(unit_licences(text, idf, unseen, templates, line), tags(text)).alias("units"),
        F.when(text.rlike("[A-Za-z0-9]"), text).alias("text"),
    )

    def covered(sort: int) -> Column:
        of_sort = F.filter("units", lambda x: x["sort"] == sort)
        return F.aggregate(of_sort, F.lit(0), lambda n, x: n + x["words"])

    most = F.greatest(*map(covered, (LINE_UNIT, BLOCK_UNIT, FILE_UNIT, TAG_UNIT)))
    share = F.when(F.size("units") > 0, most / F.size(terms(F.col("text"))))
    folder = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).when(F.col("path").isNotNull(), "")
    own = F.array_max(F.transform("units", lambda x: F.struct(x["score"].alias("score"), x["licence"].alias("licence"))))
    # Read three times below, and much dearer to make than to write.
    rows = materialize(found.select("doc_id", "path", folder.alias("folder"), own.alias("own"), share.alias("share")))

    order = F.struct((-F.col("own.score")).alias("s"), (-F.col("share")).alias("w"), "path", F.col("own.licence").alias("licence"))
    governing = (
        rows.filter((F.col("share") >= file) & F.col("folder").isNotNull())
        .groupBy("folder").agg(F.min(order).alias("best"))
        .select("folder", (-F.col("best.s")).alias("folder_score"), F.col("best.licence").alias("folder_licence"))
    )
    parts = F.split("folder", "/", -1)
    above = rows.filter("folder is not null").select("folder").distinct().select(
        "folder",
        F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("up"),
    )
    nearest = Window.partitionBy("folder").orderBy(F.length("up").desc())
    inherited = (
        above.join(governing.withColumnRenamed("folder", "up"), "up")
        .withColumn("turn", F.row_number().over(nearest)).filter("turn = 1").drop("turn")
    )
    out = rows.join(inherited, "folder", "left")
    has = F.col("own").isNotNull()
    return out.select(
        "doc_id",
        "path",
        F.coalesce("own.licence", "folder_licence").alias("licence"),
        F.when(has, "own").when(F.col("up").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.coalesce("own.score", "folder_score").alias("score"),
        F.when(~has, F.col("up")).alias("governed_by"),
    )
