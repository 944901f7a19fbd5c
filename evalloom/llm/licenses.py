"""Licence notices found by a trained paragraph classifier.

A paragraph is a line with the lines that it wraps onto. Paragraphs are scored
by a softmax regression over sparse word uni- and bigrams, trained on the
notices below, their rule-made variants and ordinary sentences that use the same
words. Which paragraphs are worth scoring follows from the trained weights: the
words that speak most for some family, as many as it takes for every notice and
every variant to have one. A softmax temperature and the least probability of a
family are calibrated on variants that the fit does not see; below it, or where
no template of the family agrees, the verdict is "unknown".
"""

from __future__ import annotations

import functools
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.llm.common import checkpointed, from_rows

# The usual notices of licence families, and ordinary sentences.
NOTICES = {
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT license. See LICENSE in the project root for license information.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "agpl": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "bsd": [
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "public-domain": [
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
        "Dedicated to the public domain under CC0 1.0 Universal.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "proprietary": [
        "Copyright 2020 Example Company. All rights reserved.",
        "All rights reserved. No part of this publication may be reproduced or distributed without prior written permission of the publisher.",
        "This software is proprietary and confidential; unauthorized copying of this file is strictly prohibited.",
    ],
}
ORDINARY = [
    "She lost her driving license on the way to the city.",
    "The fishing licence must be renewed every year at the town hall.",
    "The council may license a public house to sell beer after ten.",
    "He was a licensed pilot and a friend of the general.",
    "They asked for permission to enter the garden of the palace.",
    "The warranty on the car ended last spring.",
    "Public transport in the domain of the duke was free of charge.",
    "The redistribution of land was the first act of the new state.",
    "A gnu and a zebra stood at the water.",
    "The museum bought the copyright of the song for a large sum.",
    "Copies of the book were sold in every version of the shop.",
    "The software company opened an office in a mild climate.",
    "Creative people in common rooms wrote the plays of that time.",
    "Der Mann ging mit dem Hund und mit der Frau durch die Stadt.",
    "Wir fahren mit einem Rad, mit dir und mit ihm zu den Bergen.",
    "You may obtain a ticket at the gate in compliance with the rules.",
    "The notice was distributed to all workers without restriction of time.",
]

#: Words that say nothing by themselves: what is left of a notice without its other words is ordinary text to the fit.
FUNCTION_WORDS = frozenset("a all an and any are as at be been by can for form free from has have if in into is it may mit more no not of on one only or other part provided see should subject that the these they this to under use used v was which will with without work you".split())
TOKEN = r"[a-z0-9]+(?:\.[0-9]+)*"
NONE = "none"
TEMPLATE_SHARE = 0.6
#: A line wraps onto the next if it does not end a sentence and the next begins in lower case.
WRAP = r"(?<=[^\s.!?:;])[ \t]*\r?\n[ \t]*(?=[a-z])"


def grams(text: str) -> list[str]:
    """Distinct word uni- and bigrams in order of first use."""
    words = re.findall(TOKEN, text.lower())
    return list(dict.fromkeys(words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]))


def _variants(text: str) -> tuple[list[str], list[str]]:
    """What the fit sees of a text and what calibrates it: whole, inside other words, cut, and with words left out.

    The second kind always lacks or adds words, so that its n-grams are not those of the first.
    """
    words = text.split()
    seen, held = [text, f"Copyright 2019 A. Author. {text}", f"{text} See the file for details."], [f"This part of the work: {text} (see above)"]
    if len(words) > 3:
        held.append(" ".join(words[:-1]))
    if len(words) > 7:
        seen += [" ".join(w for i, w in enumerate(words) if i % 7 != k) for k in (2, 5)] + [" ".join(words[: 4 * len(words) // 5])]
        held += [" ".join(words[: 3 * len(words) // 4]), " ".join(words[len(words) // 4 :])] + [" ".join(w for i, w in enumerate(words) if i % 7 != k) for k in (1, 4, 6)]
    return seen, held


@functools.cache
def model() -> tuple[list[str], dict[str, list[float]], list[float], float, float]:
    """Classes, weights by n-gram, biases, temperature and least probability; the same on every machine."""
    classes = [NONE, *NOTICES]
    texts = [(t, classes.index(c)) for c, of in NOTICES.items() for t in of] + [(t, 0) for t in ORDINARY]
    fit_rows, held = ([(grams(v), label) for t, label in texts for v in _variants(t)[k] if label or "Copyright 2019" not in v] for k in (0, 1))
    fit_rows += [(gs, 0) for t, label in texts if label for gs in [grams(" ".join(w for w in re.findall(TOKEN, t.lower()) if w in FUNCTION_WORDS))] if gs]
    fit_rows += [([w], 0) for w in sorted(FUNCTION_WORDS)]
    weights: dict[str, list[float]] = {g: [0.0] * len(classes) for gs, _ in fit_rows for g in gs}
    bias = [0.0] * len(classes)
    bias[0] = 1.0  # a paragraph of unseen words is no licence

    def scores(gs: list[str], heat: float = 1.0) -> list[float]:
        norm = math.sqrt(len(gs) or 1)
        raw = [(b + sum(weights[g][c] for g in gs if g in weights) / norm) / heat for c, b in enumerate(bias)]
        top = max(raw)
        e = [math.exp(x - top) for x in raw]
        return [x / sum(e) for x in e]

    for step in range(60):
        rate = 2.0 / (1 + step / 20)
        for gs, label in fit_rows:
            norm = math.sqrt(len(gs))
            for c, p in enumerate(scores(gs)):
                delta = rate * ((c == label) - p) / norm
                if abs(delta) > 1e-5:
                    for g in gs:
                        weights[g][c] += delta - 1e-4 * weights[g][c]
    heats = [0.5, 0.7, 1.0, 1.4, 2.0, 2.8]
    heat = min(heats, key=lambda h: -sum(math.log(max(1e-12, scores(gs, h)[label])) for gs, label in held))
    right = sorted(scores(gs, heat)[label] for gs, label in held if label)
    return classes, weights, bias, heat, min(0.5, right[len(right) // 50])


def _tables(spark):
    classes, weights, bias, heat, least = model()
    known = from_rows(spark, [{"gram": g, "w": [round(x, 9) for x in w]} for g, w in sorted(weights.items())], "gram string, w array<double>")
    shapes = from_rows(spark, [{"family": c, "grams": grams(t)} for c, texts in NOTICES.items() for t in texts], "family string, grams array<string>")
    return known, shapes


@functools.cache
def anchors() -> list[str]:
    """The words with the largest margins of a family over ordinary text, so many that all notices and their variants have at least one."""
    _, weights, _, _, _ = model()
    margin = {g: max(w[1:]) - w[0] for g, w in weights.items() if " " not in g and not g.isdigit() and len(g) > 1}
    texts = [v for of in NOTICES.values() for t in of for some in _variants(t) for v in some]
    least = min(max(margin.get(w, -math.inf) for w in re.findall(TOKEN, v.lower())) for v in texts)
    return sorted(w for w, m in margin.items() if m >= least)


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, _row, paragraph and _g (distinct n-grams) of the paragraphs that have an anchor word."""
    has = r"(?i)(?<![a-z0-9])(?:" + "|".join(map(re.escape, anchors())) + r")(?![a-z0-9])"
    texts = docs.filter(F.col("text").rlike(has)).select("doc_id", F.xxhash64("text").alias("_row"), F.posexplode(F.split(F.regexp_replace("text", WRAP, " "), "\n", -1)).alias("paragraph", "_line"))
    lines = texts.filter(F.col("_line").rlike(has)).select("doc_id", "_row", "paragraph", F.regexp_extract_all(F.lower("_line"), F.lit(f"({TOKEN})"), F.lit(1)).alias("_w"))
    lines = lines.filter(F.arrays_overlap("_w", F.array(*map(F.lit, anchors()))))
    pairs = F.zip_with(F.slice("_w", F.lit(1), F.size("_w") - 1), F.slice("_w", F.lit(2), F.size("_w") - 1), lambda a, b: F.concat_ws(" ", a, b))
    return lines.select("doc_id", "_row", "paragraph", F.array_distinct(F.concat("_w", pairs)).alias("_g"))


def found(docs: DataFrame) -> DataFrame:
    """One row for each paragraph with licence text: doc_id, paragraph (number from 0, wrapped lines counted as one), family, verdict, probability, template_share.

    verdict is the family where the probability is high enough and a template
    agrees (the share of the shorter side's n-grams that both have is at least
    ``TEMPLATE_SHARE``), else "unknown". Null and empty texts have no rows;
    equal rows are found once; the weights and templates are fixed tables of a
    few thousand short rows, which is why they can be broadcast.
    """
    spark = docs.sparkSession
    classes, weights, bias, heat, least = model()
    known, shapes = _tables(spark)
    # written once: full scores and templates read the same few paragraphs
    lines = checkpointed(paragraphs(docs).distinct())
    hits = lines.select("doc_id", "_row", "paragraph", F.size("_g").alias("_n"), F.explode("_g").alias("gram")).join(F.broadcast(known), "gram")
    key = ["doc_id", "_row", "paragraph"]
    sums = hits.groupBy(*key, "_n").agg(*[F.sum(F.get("w", F.lit(c))).alias(f"s{c}") for c in range(len(classes))])
    raw = F.array(*[(F.lit(bias[c]) + F.col(f"s{c}") / F.sqrt(F.greatest("_n", F.lit(1)))) / heat for c in range(len(classes))])
    sums = sums.withColumn("_raw", raw)
    powers = F.transform("_raw", lambda x: F.exp(x - F.array_max("_raw")))
    sums = sums.withColumn("_e", powers)
    total = F.aggregate("_e", F.lit(0.0), lambda a, x: a + x)
    best = F.array_position("_raw", F.array_max("_raw")).cast("int")
    named = sums.select(*key, F.get(F.array(*map(F.lit, classes)), best - 1).alias("family"), (F.lit(1.0) / total).alias("probability"))
    named = named.filter(F.col("family") != NONE)
    side = lines.select(F.col("doc_id").alias("_id"), F.col("_row").alias("_r"), F.col("paragraph").alias("_p"), "_g")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_row") == F.col("_r")) & (F.col("paragraph") == F.col("_p"))
    shared = named.join(side, same).select(*key, "family", "probability", "_g")
    share = F.size(F.array_intersect("_g", "grams")) / F.least(F.size("_g"), F.size("grams"))
    confirmed = shared.join(F.broadcast(shapes), "family").groupBy(*key, "family", "probability").agg(F.max(share).alias("template_share"))
    sure = (F.col("probability") >= least) & (F.col("template_share") >= TEMPLATE_SHARE)
    return confirmed.select(
        "doc_id", "paragraph", "family", F.when(sure, F.col("family")).otherwise("unknown").alias("verdict"),
        F.round("probability", 6).alias("probability"), F.round("template_share", 6).alias("template_share"),
    )
