"""Licence scan: a trained paragraph classifier, in DataFrame operations only.

A paragraph is a line, with the lines that go on in lower case behind it (a notice that is
wrapped at a column is one paragraph). Its word bigrams and trigrams meet the sparse weights of a
multinomial logistic regression over licence families and an unknown class. The weights
are trained on the driver from the notices below, alone and inside longer sentences, against
look-alikes made by a rule: the notices' own words in other orders, in pieces of one to three
words, and their pieces inside sentences that use the same words for other things. The temperature of the softmax is
fitted on notices (whole names and sentences) and sentences that weights trained without them have not seen, and a paragraph is of a family only if
that family's probability reaches ``least_probability``. A second step compares such
paragraphs with the notices of the family: the share of a notice's n-grams that the paragraph
holds, or of the paragraph's that the notice holds, confirms the prediction from
``least_overlap`` on.

Weights are whole thousandths, so sums are exact in any order. Weights and notices are a
few thousand rows whatever the corpus, and go to every task.

Defined cases: null text counts as empty; paragraphs without a known n-gram are of the
unknown class and give no row; of families alike in weight the first by FAMILIES is told; repeated rows give their paragraphs each; null ids are ids like others; extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import is_scan, saved, table

#: Names of licences, and sentences of their usual notices.
NAMES = {
    "mit": ["MIT License", "MIT licence", "X11 License", "Expat License"],
    "apache": ["Apache License, Version 2.0", "Apache License", "Apache 2.0 license", "Apache Software License"],
    "bsd": ["BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "New BSD License", "BSD-style license"],
    "gpl": ["GNU General Public License, version 3", "GNU General Public License", "GNU GPL version 2", "GPLv3 license", "GNU Affero General Public License", "GNU Lesser General Public License"],
    "mpl": ["Mozilla Public License, version 2.0", "Mozilla Public License", "MPL 2.0 license"],
    "isc": ["ISC License", "ISC licence"],
    "cc_by": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License", "CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike License"],
    "cc_by_nc": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC-SA 4.0", "CC BY-NC-ND 4.0"],
    "public_domain": ["CC0 1.0 Universal public domain dedication", "Unlicense", "CC0 1.0"],
    "proprietary": ["End User License Agreement", "proprietary license agreement"],
}
NOTICES = {
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "apache": [
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "cc_by": ["To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/", "You are free to share and adapt the material for any purpose, even commercially, as long as you give appropriate credit."],
    "cc_by_nc": ["To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/", "You may not use the material for commercial purposes."],
    "public_domain": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
        "the author has waived all copyright and related rights and dedicated the work to the public domain",
    ],
    "proprietary": [
        "All rights reserved.", "Copyright the authors. All rights reserved.", "This document is confidential and proprietary.",
        "No part of this publication may be reproduced, distributed, or transmitted in any form without the prior written permission of the publisher.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited.",
    ],
}
#: Ways to name a licence in a notice.
PATTERNS = (
    "Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "This work is licensed under the {}.", "This work is licensed under a {}.", "Distributed under the {}.", "This project is available under the {}.", "{}",
    "The source code is licensed under the {}, see the file LICENSE for details.", "SPDX license: {}", "This software is released under the terms of the {}.", "Published under the {}.",
)
#: Sentences with the words of licences that license nothing.
OTHER = (
    "You need a driving licence to drive this car on a public road.", "The general public was free to use the park without restriction.", "The committee may obtain a copy of the report on request.",
    "Permission to build was granted by the city last year.", "She used the software to modify a copy of the picture.", "The university licensed the patent to a new company.", "His fishing license was renewed under the new rules.",
    "The above notice was put up in all of the halls.", "All rights of way are marked on the map.", "The rights of the author were discussed at length.", "It was released under the name of his brother.", "The work is published in two volumes.",
    "This version of the story is distributed in schools.", "The following conditions are common in winter.", "The names of its members may be used in the list.", "There is no warranty of good weather in the mountains.",
    "He was free to share the prize with his friends.", "The commons is open to the public in summer.", "A creative use of colour and attribution to the old masters.", "The apache helicopter landed on the field.",
    "The public domain of the village lies by the river.", "Reserved seats are sold at the door, all others are free.", "Terms of the agreement between the two states were published.", "Version 2.0 of the paper and version 3 of the reply differ.",
    "The file is in the same form as the source.", "Tables are reserved for all guests under the terms of the club.", "The library will distribute copies of the book free of charge to any person.", "A term of the contract was subject to the approval of the board.",
)

FAMILIES = tuple(NAMES)
CLASSES = (*FAMILIES, "unknown")
LEAST_PROBABILITY, LEAST_OVERLAP = 0.6, 0.5
#: A line end within a paragraph: no sentence ends before it, and a small letter follows.
WRAPPED = "([^.!?:;\\n])\\n(\\p{Ll})"
#: Weights under this size are left out of the model.
SPARSE = 0.05


def words(text: str) -> list[str]:
    return [w for w in re.split(r"[^\w]+|_", text.lower()) if w]


def grams(text: str) -> list[str]:
    w = words(text)
    return [" ".join(w[i : i + n]) for n in (2, 3) for i in range(len(w) - n + 1)]


def templates() -> list[tuple[str, str]]:
    """(family, notice): the sentences that predictions are compared with."""
    named = [(f, p.format(n)) for f in FAMILIES for n in NAMES[f] for p in PATTERNS]
    return named + [(f, s) for f in FAMILIES for s in NOTICES[f]]


def look_alikes(text: str, seed: int) -> list[str]:
    """The words of a notice in other orders, cut into pieces of one, two and three words: what its single n-grams look like elsewhere."""
    w = words(text)
    out = []
    for n in (1, 2, 3):
        pieces = [w[i : i + n] for i in range(0, len(w), n)]
        order = np.random.default_rng((seed, n)).permutation(len(pieces))
        out.append(" ".join(x for i in order for x in pieces[i]))
    return out


def examples() -> list[tuple[int, str, bool]]:
    """(class, paragraph, held out): notices alone, behind and before other words, and paragraphs of no licence.

    A fifth of the names, sentences and other sentences is held out, in whatever form.
    """
    unknown = len(FAMILIES)
    names = [n for f in FAMILIES for n in NAMES[f]]
    # a family's only name or sentence stays in the training
    held_name = {n for f in FAMILIES for k, n in enumerate(NAMES[f]) if k and names.index(n) % 5 == 3}
    held_notice = {s for f in FAMILIES for k, s in enumerate(NOTICES[f]) if k and k % 5 == 2}
    held_other = {s for k, s in enumerate(OTHER) if k % 5 == 3}
    kept_other = [s for s in OTHER if s not in held_other]
    out = []
    for k, (family, text) in enumerate(templates()):
        y = FAMILIES.index(family)
        hold = text in held_notice or any(n in text for n in held_name)
        beside = sorted(held_other)[k % len(held_other)] if hold else kept_other[k % len(kept_other)]
        out += [(y, text, hold), (y, f"{beside} {text}", hold), (y, f"{text} {beside}", hold)]
        w = text.split()
        if len(w) > 12:
            out += [(y, " ".join(w[: len(w) // 2]), hold), (y, " ".join(w[len(w) // 2 :]), hold)]
        if text in NOTICES[family] or text in NAMES[family]:
            # a name alone is told by its words, so only longer ones are put in other orders
            out += [(unknown, t, hold) for t in (look_alikes(text, k) if len(w) > 6 else ())]
            out += [(unknown, f"{beside} {' '.join(words(text)[:2])}.", hold)] * (len(w) > 6)
    for k, s in enumerate(OTHER):
        hold = s in held_other
        own = sorted(held_other) if hold else kept_other
        out += [(unknown, s, hold)] * 4 + [(unknown, f"{s} {own[(k + step) % len(own)]}", hold) for step in (1, 7)]
        out += [(unknown, t, hold) for t in look_alikes(s, 1000 + k)]
    return out + [(unknown, "", False)] * 20


@cache
def model() -> tuple[dict[str, tuple[int, ...]], tuple[int, ...], float]:
    """n-gram -> weight of each class in thousandths; the classes' offsets; the temperature."""
    data = examples()
    hold = np.array([h for _, _, h in data])
    vocabulary = {g: i for i, g in enumerate(sorted({g for _, t, _ in data for g in grams(t)}))}
    x = np.zeros((len(data), len(vocabulary) + 1))
    x[:, -1] = 1
    for r, (_, t, _) in enumerate(data):
        for g in grams(t):
            x[r, vocabulary[g]] += 1
    y = np.eye(len(CLASSES))[[c for c, _, _ in data]]

    def soft(z):
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def trained(rows: np.ndarray) -> np.ndarray:
        w = np.zeros((x.shape[1], len(CLASSES)))
        speed = np.zeros_like(w)
        train_x, train_y = x[rows], y[rows]
        for _ in range(250):  # accelerated gradient steps; the ridge keeps rare n-grams small
            ahead = w + 0.9 * speed
            grad = train_x.T @ (soft(train_x @ ahead) - train_y) / len(train_x) + 2e-4 * ahead
            speed = 0.9 * speed - 0.25 * grad
            w = w + speed
        w[np.abs(w) < SPARSE] = 0
        return w

    # the temperature from weights that have not seen the held-out rows, the weights from all rows
    apart = trained(~hold)
    best = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0), key=lambda t: -np.log(np.maximum((soft(x[hold] @ apart / t) * y[hold]).sum(1), 1e-12)).mean())
    whole = np.rint(trained(np.ones(len(data), bool)) * 1000).astype(int)
    return {g: tuple(map(int, whole[i])) for g, i in vocabulary.items() if whole[i].any()}, tuple(map(int, whole[-1])), float(best)


def _values(rows: list[tuple], names: list[str]) -> str:
    def cell(v) -> str:
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return "(VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") AS t({', '.join(names)})"


def _weights_sql() -> str:
    return "SELECT * FROM " + _values([(g, *w) for g, w in model()[0].items()], ["gram", *(f"w_{c}" for c in CLASSES)])


def _templates_sql() -> str:
    rows = [(k, f, g) for k, (f, t) in enumerate(templates()) for g in sorted(set(grams(t)))]
    return "SELECT * FROM " + _values(rows, ["template", "family", "gram"])


def paragraphs(rows: DataFrame) -> DataFrame:
    """row_id, doc_id, paragraph (number from 0), words of every paragraph of rows (row_id, doc_id, text)."""
    joined = F.coalesce(F.col("text"), F.lit(""))
    for _ in range(2):  # a line of one letter ends a match and begins the next
        joined = F.regexp_replace(joined, WRAPPED, "$1 $2")
    lines = F.split(joined, "\n")
    rows = rows.select("row_id", "doc_id", F.posexplode(lines).alias("paragraph", "line"))
    return rows.select("row_id", "doc_id", "paragraph", F.array_remove(F.split(F.lower("line"), "[^\\p{L}\\p{N}]+"), "").alias("words"))


def _gram_rows(parts: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each bigram and trigram of words."""
    at = F.when(F.size("words") >= 2, F.sequence(F.lit(0), F.size("words") - 2))
    w = [F.get("words", F.col("p") + F.lit(k)) for k in range(3)]
    two, three = F.concat_ws(" ", w[0], w[1]), F.when(w[2].isNotNull(), F.concat_ws(" ", *w))
    return parts.select(*keep, "words", F.explode(at).alias("p")).select(*keep, F.explode(F.array(two, three)).alias("gram"))


def _probability(temperature: float) -> Column:
    total = sum((F.exp(F.col(f"m_{c}") / F.lit(1000 * temperature) - F.col("top") / F.lit(1000 * temperature)) for c in CLASSES), F.lit(0.0))
    return F.lit(1.0) / total


def scan(docs: DataFrame, least_probability: float = LEAST_PROBABILITY, least_overlap: float = LEAST_OVERLAP) -> DataFrame:
    """A row for each paragraph of a licence family: doc_id, paragraph, family, margin, probability, overlap, confirmed."""
    spark = docs.sparkSession
    _, offsets, temperature = model()
    weights = spark.sql(_weights_sql())
    keys = ["row_id", "doc_id", "paragraph"]
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "text")
    # rows are read twice, and have to have the same numbers again
    rows = rows if is_scan(docs) else saved(rows, "license-rows")
    known = _gram_rows(paragraphs(rows), keys).join(F.broadcast(weights), "gram")
    sums = known.groupBy(*keys).agg(*((F.sum(f"w_{c}") + o).alias(f"m_{c}") for c, o in zip(CLASSES, offsets, strict=True)))
    rest = F.greatest(*(F.col(f"m_{f}") for f in FAMILIES))
    family = F.coalesce(*(F.when(F.col(f"m_{f}") == F.col("best"), f) for f in FAMILIES))
    scored = sums.withColumn("best", rest).withColumn("top", F.greatest("best", "m_unknown"))
    found = saved(
        scored.withColumns({"family": family, "probability": F.round(_probability(temperature), 4), "margin": F.col("best") - F.col("m_unknown")})
        .where((F.col("margin") > 0) & (F.col("probability") >= least_probability)).select(*keys, "family", "margin", "probability"),
        "license-paragraphs",
    )
    # the texts that hold such paragraphs again (only those rows' texts pass the join), and the notices that share n-grams with them
    notices = spark.sql(_templates_sql())
    sizes = notices.groupBy("template").agg(F.count(F.lit(1)).alias("n_template"))
    again = paragraphs(rows.join(found.select("row_id").distinct(), "row_id", "left_semi")).join(found.drop("doc_id"), ["row_id", "paragraph"]).select(*keys, "family", "margin", "probability", "words")
    own = saved(_gram_rows(again, [*keys, "family", "margin", "probability"]).where(F.col("gram").isNotNull()).distinct(), "license-grams")
    n_own = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_own"))
    shared = own.join(F.broadcast(notices), ["family", "gram"]).groupBy(*keys, "family", "margin", "probability", "template").agg(F.count(F.lit(1)).alias("n_shared"))
    overlap = F.col("n_shared") / F.least("n_own", "n_template")
    best = shared.join(F.broadcast(sizes), "template").join(n_own.drop("doc_id"), ["row_id", "paragraph"]).groupBy(*keys, "family", "margin", "probability").agg(F.max(overlap).alias("overlap"))
    full = found.join(best.select("row_id", "paragraph", "overlap"), ["row_id", "paragraph"], "left")
    share = F.round(F.coalesce("overlap", F.lit(0.0)), 4)
    return full.select("doc_id", F.col("paragraph").cast("long").alias("paragraph"), "family", F.col("margin").cast("long").alias("margin"), "probability", share.alias("overlap"), (share >= least_overlap).alias("confirmed"))


def op6_license_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def oracle_sql() -> str:
    _, offsets, temperature = model()
    sums = ", ".join(f"sum(w_{c}) + {o} AS m_{c}" for c, o in zip(CLASSES, offsets, strict=True))
    best = "greatest(" + ", ".join(f"m_{f}" for f in FAMILIES) + ")"
    family = "CASE " + " ".join(f"WHEN m_{f} = best THEN '{f}'" for f in FAMILIES) + " END"
    t = 1000 * temperature
    total = " + ".join(f"exp(m_{c} / {t} - top / {t})" for c in CLASSES)
    return rf"""
WITH weights AS ({_weights_sql()}), notices AS ({_templates_sql()}),
lines AS (SELECT row_number() OVER () AS row_id, doc_id, string_split(regexp_replace(regexp_replace(coalesce(text, ''), '([^.!?:;\n])\n(\p{{Ll}})', '\1 \2', 'g'), '([^.!?:;\n])\n(\p{{Ll}})', '\1 \2', 'g'), chr(10)) AS ls FROM documents),
parts AS (SELECT row_id, doc_id, p AS paragraph, list_filter(regexp_split_to_array(lower(ls[p + 1]), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM lines, unnest(range(0, len(ls))) AS u(p)),
grams AS (
  SELECT row_id, doc_id, paragraph, concat_ws(' ', w[k + 1], w[k + 2]) AS gram FROM parts, unnest(range(0, len(w) - 1)) AS u(k)
  UNION ALL SELECT row_id, doc_id, paragraph, concat_ws(' ', w[k + 1], w[k + 2], w[k + 3]) FROM parts, unnest(range(0, len(w) - 2)) AS u(k)),
sums AS (SELECT row_id, doc_id, paragraph, {sums} FROM grams JOIN weights USING (gram) GROUP BY ALL),
scored AS (SELECT *, {best} AS best FROM sums),
topped AS (SELECT *, greatest(best, m_unknown) AS top, {family} AS family, best - m_unknown AS margin FROM scored),
found AS (SELECT row_id, doc_id, paragraph, family, margin, round(1.0 / ({total}), 4) AS probability FROM topped WHERE margin > 0),
kept AS (SELECT * FROM found WHERE probability >= {LEAST_PROBABILITY}),
own AS (SELECT DISTINCT row_id, paragraph, family, gram FROM kept JOIN grams USING (row_id, doc_id, paragraph)),
n_own AS (SELECT row_id, paragraph, count(*) AS n_own FROM own GROUP BY ALL),
sizes AS (SELECT template, count(*) AS n_template FROM notices GROUP BY ALL),
shared AS (SELECT row_id, paragraph, template, count(*) AS n_shared FROM own JOIN notices USING (family, gram) GROUP BY ALL),
best_of AS (SELECT row_id, paragraph, max(n_shared / least(n_own, n_template)) AS overlap FROM shared JOIN sizes USING (template) JOIN n_own USING (row_id, paragraph) GROUP BY ALL)
SELECT doc_id, CAST(paragraph AS BIGINT) AS paragraph, family, CAST(margin AS BIGINT) AS margin, probability,
       round(coalesce(overlap, 0), 4) AS overlap, round(coalesce(overlap, 0), 4) >= {LEAST_OVERLAP} AS confirmed
FROM kept LEFT JOIN best_of USING (row_id, paragraph)
"""
