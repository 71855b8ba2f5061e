"""Licence scan: a trained paragraph classifier, confirmed by template comparison, in DataFrame operations.

Paragraphs are runs of lines up to a line without words; comment marks are no words and line breaks count as
spaces, so word pairs and triples reach across them. Within a paragraph a notice is a run of lines that hold
features of licences, at most BRIDGED lines without any between them, that the classifier doesn't put into
different families: prose around a notice is no part of it, and a paragraph with two notices has two rows.

Features are a notice's distinct word pairs and triples, with a mark where a paragraph begins, that occur in a
template of a licence, a declaration (``License: MIT``), a notice of some other licence or a sample of prose.
A multinomial logistic regression over them has a class for each family, one for licences that are none of
them, and one for prose; a family whose probability stays below a bound, calibrated on held-out notices and
prose, becomes ``unknown``. Prose has no row. A prediction counts as confirmed when enough of one of the
family's templates stands in the notice. The regression is fitted on the texts below and their variants; the
scan itself is built-in functions, broadcasts of the fixed vocabulary and windows within a text.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheetlore.llm.common import stored

UNKNOWN, PROSE = "unknown", "prose"
#: Lines without features that may lie between two lines of a notice.
BRIDGED = 2
#: Marks the beginning of a paragraph.
BEGIN = "^"
#: Share of a template's features that confirms a prediction.
CONFIRMING_SHARE = 0.5
EPOCHS, VARIANTS = 200, 16

#: Notices by which the licences name themselves.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "MIT License",
        "The MIT License (MIT)",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "Apache License Version 2.0, January 2004",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License.",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "GNU LESSER GENERAL PUBLIC LICENSE",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "BSD": (
        "Released under the BSD License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "BSD 3-Clause License",
        "BSD 2-Clause License",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "Mozilla Public License Version 2.0",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC0": (
        "Released under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law.",
    ),
    "ISC": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "ISC License",
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "Zlib": (
        "Released under the zlib License.",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
        "This notice may not be removed or altered from any source distribution.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Released under the Unlicense.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "Proprietary": (
        "Copyright. All rights reserved.",
        "This software is proprietary and confidential. Unauthorized copying of this file is strictly prohibited.",
    ),
}
#: Identifiers by which a family is declared, as in ``SPDX-License-Identifier: MIT``.
IDENTIFIERS: dict[str, tuple[str, ...]] = {
    "MIT": ("MIT", "Expat"),
    "Apache-2.0": ("Apache-2.0", "Apache 2.0", "ASL-2.0"),
    "GPL-3.0": ("GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "GPLv3", "GPL-3"),
    "GPL-2.0": ("GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPLv2", "GPL-2"),
    "LGPL": ("LGPL", "LGPL-2.0", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "LGPLv2.1", "LGPLv3"),
    "AGPL-3.0": ("AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "AGPLv3"),
    "BSD": ("BSD", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause"),
    "MPL-2.0": ("MPL-2.0", "MPLv2", "MPL 2.0"),
    "CC-BY": ("CC-BY", "CC-BY-4.0", "CC-BY-3.0", "CC BY 4.0"),
    "CC-BY-SA": ("CC-BY-SA", "CC-BY-SA-4.0", "CC-BY-SA-3.0", "CC BY-SA 4.0"),
    "CC-BY-NC": ("CC-BY-NC", "CC-BY-NC-4.0", "CC-BY-NC-3.0", "CC BY-NC 4.0"),
    "CC0": ("CC0", "CC0-1.0"),
    "ISC": ("ISC",),
    "Zlib": ("Zlib",),
    "Unlicense": ("Unlicense",),
    "Proprietary": ("Proprietary",),
}
for _family, _names in IDENTIFIERS.items():
    TEMPLATES[_family] += tuple(form + name for name in _names for form in ("SPDX-License-Identifier: ", "License: ", "Licence: "))
#: Notices of licences that are none of the families, or that do not say which.
OTHER_LICENCES = (
    "Licensed under the Eclipse Public License 2.0.", "Distributed under the Boost Software License, Version 1.0.", "Released under the Artistic License 2.0.",
    "This font software is licensed under the SIL Open Font License, Version 1.1.", "Licensed under the European Union Public Licence.",
    "License: see the file COPYING for details", "License: custom", "Licence: none given", "License: WTFPL", "SPDX-License-Identifier: EPL-2.0",
    "SPDX-License-Identifier: LicenseRef-custom", "See the LICENSE file for license terms.", "This file is licensed under the terms given in the LICENSE file.",
    "Licensed under the Example Community License Agreement.", "Released under a permissive license.", "Use of this software is subject to the license agreement.",
    "This work is licensed under a license that permits sharing.", "may be used under the GNU General", "under the GNU General Public License",
    "Public License, version", "General Public License", "Common Public License, version 1", "Eclipse Public License, version 2", "Public License, version 2", "Licensed to the foundation under one or more contributor license agreements.",
    "Distributed under the terms of the Academic Free License.", "This document is released under the GNU Free Documentation License.",
    "License information can be found in the accompanying file.", "Copyright (c) the authors. Licensed under the Common Development and Distribution License.",
)
#: Sentences with words of licences that grant nothing, and other prose.
OTHERS = (
    "The driver must show a valid licence and the permission of the owner.",
    "He asked for permission to use the room and to copy the list.",
    "The museum reserved all rights to the photographs shown in the software fair.",
    "Copyright law protects authors for many years.",
    "A fishing license is required, version 2 of the form is at the office.",
    "The general public may visit the free software museum under the old bridge.",
    "The terms of the contract were published by the foundation.",
    "The bank offered a warranty and a licence to trade.",
    "Under the terms of the treaty the public domain was sold.",
    "Commercial use of the land needs a license from the town.",
    "The history of the town is described in the first part of the book, and the map of the river at the end of it.",
    "It is one of the most common birds in the region and can be found in all kinds of woods or on the shore.",
    "The above list is not complete, as is shown in the following part, and any person may add to it.",
    "The software is used by many people in the office and is provided by the company for the purpose of planning.",
    "You can use the program to copy files from one computer to another without a network.",
    "The work of the author was published in the same year, and copies of the book were sold to the public.",
    "Anyone can modify the source code of the program and publish the changes as they like.",
    "Subject to the conditions of the contract the goods are distributed in the form of parts.",
    "This is free of charge for any person with or without a ticket, including but not limited to children.",
    "The law of the land is applied in writing, express or implied, unless agreed otherwise.",
    "He lost his driving licence and had to walk.", "She got her licence last year and drives to work.", "The pub lost its licence to sell beer.",
    "His license was taken by the court because he drove too fast.", "A television licence is paid once a year.", "They were licensed to sell books near the market.",
    "The company licensed the pattern to a mill in the north.", "A hunting licence costs more in the winter.", "Poetic licence lets a writer bend the truth.",
    "The general told the public that the war was over.", "Permission to land was granted to the pilot.", "The copyright of the song belongs to her brother.",
)
#: Words that say nothing of licences; a notice must have a feature beyond them.
FREQUENT = frozenset(
    "a above all an and any are as at be but by can do for free from has have in is it its many may must no not of on one or other part should such that the their "
    "them they this to under was were what with within without you".split()
)
#: Words that mark a comment line.
MARKS = r"(?m)^\s*@?(?:rem|dnl)\s"
_WORD = r"[a-z0-9]+(?:[.+-][a-z0-9]+)*"


def words_of(text: str) -> list[str]:
    """The words of a paragraph, after the mark of its beginning."""
    return [BEGIN, *re.findall(_WORD, text.lower())]


def features_of(words: list[str]) -> set[str]:
    return {" ".join(words[k : k + n]) for n in (2, 3) for k in range(len(words) - n + 1)}


@cache
def vocabulary() -> list[str]:
    return sorted({g for texts in (*TEMPLATES.values(), OTHER_LICENCES, OTHERS) for t in texts for g in features_of(words_of(t))})


def licence_grams() -> set[str]:
    """Features of licences that prose has not, and that hold a word that says something."""
    own = {g for texts in (*TEMPLATES.values(), OTHER_LICENCES) for t in texts for g in features_of(words_of(t))}
    prose = {g for t in OTHERS for g in features_of(words_of(t))}
    return {g for g in own - prose if not set(g.split()) <= FREQUENT | {BEGIN}}


def declarations() -> set[str]:
    return {g for family, own in IDENTIFIERS.items() for t in TEMPLATES[family][-3 * len(own) :] for g in features_of(words_of(t))}


@cache
def trained() -> tuple[list[str], np.ndarray, np.ndarray, float]:
    """Classes (prose, unknown, families), weights (feature x class), biases and the calibrated probability bound."""
    rng = np.random.default_rng(17)
    classes = [PROSE, UNKNOWN, *TEMPLATES]
    names, at = vocabulary(), {g: k for k, g in enumerate(vocabulary())}

    def row(words: list[str]) -> np.ndarray:
        x = np.zeros(len(names), np.float32)
        x[[at[g] for g in features_of(words) if g in at]] = 1
        return x

    def variant(words: list[str]) -> list[str]:
        """A part of the words, some left out, among others; a part may begin a line or not."""
        keep = max(5, int(len(words) * rng.uniform(0.6, 1)))
        begin = rng.integers(0, max(1, len(words) - keep + 1))
        cut = [w for w in words[begin : begin + keep] if w == BEGIN or rng.random() > 0.04]
        noise = [f"w{k}" for k in rng.integers(0, 99, rng.integers(0, 4))]
        return [w for w in noise + cut + noise if w != BEGIN or rng.random() < 0.7]

    x, y, short_ = [], [], []
    for k, name in enumerate(classes):
        for text in OTHERS if name == PROSE else OTHER_LICENCES if name == UNKNOWN else TEMPLATES[name]:
            words = words_of(text)
            own = [row(words)] * 5 if len(words) <= 6 else [row(words), *(row(variant(words)) for _ in range(VARIANTS))]
            x += own
            y += [k] * len(own)
            short_ += [len(words) <= 6 and k > 0] * len(own)  # a heading has few features
    telling = licence_grams()
    dull = [k for k, g in enumerate(names) if g not in telling]
    for _ in range(VARIANTS * 20):  # prose has some features by chance, at most one that says something
        stray = np.zeros(len(names), np.float32)
        stray[rng.choice(len(names), rng.integers(0, 2))] = 1
        stray[rng.choice(dull, rng.integers(0, 9))] = 1
        x.append(stray)
        y.append(0)
        short_.append(False)
    apart = declarations()
    x_, y_ = np.array(x), np.array(y)
    short = np.array(short_)
    weight = np.where(x_[:, [k for k, g in enumerate(names) if g in apart]].any(axis=1) | short, 8.0, 1.0).astype(np.float32)[:, None]
    held = np.arange(len(y_)) % 5 == 4
    weights, bias = np.zeros((len(names), len(classes)), np.float32), np.zeros(len(classes), np.float32)
    one_hot = np.eye(len(classes), dtype=np.float32)[y_]
    for _ in range(EPOCHS):
        p = _softmax(x_[~held] @ weights + bias)
        error = weight[~held] * (p - one_hot[~held]) / weight[~held].sum()
        weights -= 8.0 * (x_[~held].T @ error + 1e-5 * weights)
        bias -= 8.0 * error.sum(axis=0)
    bias[0] = max(bias[0], bias[1:].max() + 1)  # without features a text is prose
    p = _softmax(x_[held] @ weights + bias)
    top, sure = p.argmax(axis=1), p.max(axis=1)
    right, wrong = sure[(top == y_[held]) & (top > 1)], sure[(y_[held] <= 1) & (top > 1)]
    bound = max(np.quantile(right, 0.03), np.quantile(wrong, 0.95) if len(wrong) else 0)
    return classes, weights, bias, float(np.clip(bound, 0.35, 0.8))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _among(grams) -> str:
    """A list for SQL; words have none of its signs."""
    return "(" + ", ".join(f"'{g}'" for g in sorted(grams)) + ")"


def _lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Lines with features: rid, doc_id, line, grams (the line's features), linked (some go on in the next line), open (lines with words that follow at once, three at most)."""
    names = vocabulary()
    first, second = {g.split()[0] for g in names}, {g.split()[1] for g in names}
    bare = F.regexp_replace(F.lower(F.col(text)), MARKS, " ")
    words = F.transform(F.split(bare, "\n"), lambda line: F.regexp_extract_all(line, F.lit(_WORD), F.lit(0)))
    texts = docs.select(F.col(doc_id).alias("doc_id"), words.alias("words")).withColumn("rid", F.monotonically_increasing_id())
    # a gram that starts in a line ends in the two lines after it, as none of a paragraph's lines lacks words
    follow = f"""transform(words, (own, k) -> struct(own, CASE WHEN size(get(words, k + 1)) > 1 THEN slice(get(words, k + 1), 1, 2)
        WHEN size(get(words, k + 1)) = 1 THEN concat(get(words, k + 1), coalesce(slice(get(words, k + 2), 1, 1), array())) ELSE array() END AS next,
        CASE WHEN coalesce(size(get(words, k + 1)), 0) < 1 THEN 0 WHEN coalesce(size(get(words, k + 2)), 0) < 1 THEN 1
             WHEN coalesce(size(get(words, k + 3)), 0) < 1 THEN 2 ELSE 3 END AS open,
        CASE WHEN coalesce(size(get(words, k - 1)), 0) < 1 THEN array('{BEGIN}') ELSE array() END AS begin))"""
    # all that the filters below use is made before the rows are dealt out, so that no filter makes it again for each word
    whole = "struct(size(x.own) AS words, size(x.begin) + size(x.own) AS n, concat(x.begin, x.own, x.next) AS run, x.open AS open)"
    lines = texts.select("rid", "doc_id", F.posexplode(F.expr(f"transform({follow}, x -> {whole})")).alias("line", "at"))
    lines = lines.select("rid", "doc_id", "line", "at.*").filter("words > 0")
    starts = f"filter(sequence(0, n - 1), k -> get(run, k) IN {_among(first)} AND get(run, k + 1) IN {_among(second)})"
    lines = lines.select("rid", "doc_id", "line", "open", "n", "run", F.expr(starts).alias("starts")).filter("size(starts) > 0")
    grams = """flatten(transform(starts, k -> array(struct(get(run, k) || ' ' || get(run, k + 1) AS gram, k + 1 >= n AS over),
        struct(get(run, k) || ' ' || get(run, k + 1) || ' ' || get(run, k + 2) AS gram, k + 2 >= n AS over))))"""
    lines = lines.select("rid", "doc_id", "line", "open", F.expr(grams).alias("all"))
    lines = lines.select("rid", "doc_id", "line", "open", F.expr(f"filter(all, g -> g.gram IN {_among(names)})").alias("found"))
    linked = F.exists("found", lambda g: g["over"] & g["gram"].isNotNull())
    return lines.filter("size(found) > 0").select("rid", "doc_id", "line", "open", linked.alias("linked"), F.array_distinct("found.gram").alias("grams"))


def _runs(lines: DataFrame) -> DataFrame:
    """Lines joined where a feature goes on in the next, if one says something of a licence: rid, doc_id, paragraph (the first line), last, open, grams."""
    order = Window.partitionBy("rid").orderBy("line")
    joined = F.lag("linked").over(order) & (F.lag("line").over(order) == F.col("line") - 1)
    begins = lines.withColumn("begin", F.when(F.coalesce(joined, F.lit(False)), None).otherwise(F.col("line")))
    runs = begins.withColumn("paragraph", F.last("begin", ignorenulls=True).over(order))
    grams = F.array_distinct(F.flatten(F.collect_list("grams")))
    end = F.max(F.struct("line", "open"))
    return runs.groupBy("rid", "doc_id", "paragraph").agg(end.alias("end"), grams.alias("grams")).select(
        "rid", "doc_id", "paragraph", F.col("end.line").alias("last"), F.col("end.open").alias("open"), "grams"
    ).filter(f"exists(grams, g -> g IN {_among(licence_grams())})")


def _classified(notices: DataFrame) -> DataFrame:
    """``notices`` with class and probability; a family below the bound is unknown."""
    classes, weights, bias, bound = trained()
    spark = notices.sparkSession
    rows = [(g, [float(x) for x in weights[k]]) for k, g in enumerate(vocabulary())]
    table = spark.createDataFrame(rows, "gram string, weights array<double>")
    hits = notices.select("rid", "paragraph", F.explode("grams").alias("gram")).join(F.broadcast(table), "gram")  # the vocabulary is fixed
    logits = hits.groupBy("rid", "paragraph").agg(*[F.sum(F.col("weights")[k]).alias(f"z{k}") for k in range(len(classes))])
    shifted = F.array(*[F.col(f"z{k}") + F.lit(float(b)) for k, b in enumerate(bias)])
    scored = logits.select("rid", "paragraph", shifted.alias("z")).withColumn("top", F.array_max("z"))
    total = F.aggregate("z", F.lit(0.0), lambda acc, z: acc + F.exp(z - F.col("top")))
    best = F.element_at(F.array(*[F.lit(c) for c in classes]), F.array_position("z", F.col("top")).cast("int"))
    predicted = scored.select("rid", "paragraph", best.alias("best"), (1 / total).alias("probability"))
    sure = (F.col("best") == PROSE) | (F.col("probability") >= bound)
    predicted = predicted.select("rid", "paragraph", F.when(sure, F.col("best")).otherwise(UNKNOWN).alias("family"), "probability")
    return notices.join(predicted, ["rid", "paragraph"])


def _notices(runs: DataFrame) -> DataFrame:
    """Classified runs of a paragraph joined, unless they name different families: rid, doc_id, paragraph, grams."""
    order = Window.partitionBy("rid").orderBy("paragraph")
    near = F.col("paragraph") - F.lag("last").over(order) <= F.least(F.lag("open").over(order), F.lit(BRIDGED + 1))
    chained = runs.withColumn("chain", F.sum(F.when(F.coalesce(near, F.lit(False)), 0).otherwise(1)).over(order))
    named = F.when(~F.col("family").isin(UNKNOWN, PROSE), F.col("family"))
    within = Window.partitionBy("rid", "chain").orderBy("paragraph")
    before = F.last(named, ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, -1))
    new = F.lag("paragraph").over(within).isNull() | F.coalesce(named != before, F.lit(False))
    cut = chained.withColumn("new", new).withColumn("notice", F.sum(F.when(F.col("new"), 1).otherwise(0)).over(within))
    return cut.groupBy("rid", "doc_id", "chain", "notice").agg(
        F.min("paragraph").alias("paragraph"), F.array_distinct(F.flatten(F.collect_list("grams"))).alias("grams")
    ).drop("chain", "notice")


def license_paragraphs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each notice that matches a family or grants something as another licence would.

    Returns doc_id, paragraph (number of the notice's first line, from 0), family (or ``unknown``),
    probability, template (number within the family, of the one that fits best), template_share,
    confirmed. Every line of every text is looked at; null and empty texts have none. Rows that repeat
    an id are taken as they come; other columns are not read.
    """
    spark = docs.sparkSession
    parts = [
        (g, family, number, len(features_of(words_of(t)[1:])))  # a template may stand anywhere in a paragraph
        for family, texts in TEMPLATES.items() for number, t in enumerate(texts) for g in features_of(words_of(t)[1:])
    ]
    templates = spark.createDataFrame(parts, "gram string, family string, template int, size int")
    runs = stored(_runs(_lines(docs, doc_id, text)), "licence-runs")
    predicted = stored(_classified(_notices(_classified(runs))).filter(F.col("family") != PROSE), "licence-notices")
    key = ["rid", "paragraph", "family"]
    hits = predicted.select(*key, F.explode("grams").alias("gram"))
    shares = hits.join(F.broadcast(templates), ["gram", "family"]).groupBy(*key, "template").agg((F.count("*") / F.first("size")).alias("template_share"))
    fitting = shares.groupBy(*key).agg(F.max(F.struct("template_share", (-F.col("template")).alias("t"))).alias("fit"))
    out = predicted.join(fitting, key, "left")
    share = F.coalesce(F.col("fit.template_share"), F.lit(0.0))
    return out.select(
        "doc_id", "paragraph", "family", "probability", (-F.col("fit.t")).alias("template"), share.alias("template_share"),
        (share >= CONFIRMING_SHARE).alias("confirmed"),
    )
