"""License scans, in DataFrame and SQL functions only.

A paragraph is a run of lines that are not blank, without the comment markers
at their starts, so that wrapped notices are whole; its sentences are the units
that are classified.  A unit's word n-grams (one to three words, lower case)
are the features of a multinomial logistic regression over licence families, a
class for licences that are none of them, and one for text that is no licence.
It is trained here, on notices of each family and shortened and extended forms
of them, on the same notices with other versions and on notices of no family
(unknown), and on sentences that share words with them (none).  A temperature
calibrates the probabilities on templates that the regression has not seen in
any form.  A family is reported where it is the likeliest class, its calibrated
probability passes the threshold and its closest template shares enough n-grams
with the unit; a unit whose likeliest class is a licence without that is
unknown, the rest have no row.

Only units that hold a word of some licence text are scored: this is a property
of the model, not a limit on the search.  Null and empty texts have no
paragraph.  Repeated rows are scanned each, rows with equal ids are apart.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ecotone.llm.shared import literal_rows

#: Notices by family: fixed wording of the public licences' own notices and of common short forms, a sentence each.
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "This project is released under the Apache 2.0 license.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "SPDX-License-Identifier: Apache-2.0"),
    "MIT": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", "Distributed under the MIT license, see the LICENSE file.", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "SPDX-License-Identifier: MIT", "Licensed under the MIT license."),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "Released under the GPLv3 license.", "SPDX-License-Identifier: GPL-3.0-or-later", "This file is part of a program under the GNU GPL v3 or later."),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "Released under the GPLv2 license.", "SPDX-License-Identifier: GPL-2.0-only", "This file is part of a program under the GNU GPL v2 or later."),
    "LGPL-3.0": ("This library is licensed under the GNU Lesser General Public License, version 3.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License", "Released under the LGPL license.", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    "AGPL-3.0": ("This program is licensed under the GNU Affero General Public License, version 3.", "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "Released under the AGPL license.", "SPDX-License-Identifier: AGPL-3.0-only"),
    "BSD-3-Clause": ("Released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "Licensed under the 3-clause BSD license.", "SPDX-License-Identifier: BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "Licensed under the Mozilla Public License, version 2.0.", "Released under the MPL 2.0 license.", "SPDX-License-Identifier: MPL-2.0"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Content is available under the Creative Commons BY-NC 4.0 license.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Content is available under the Creative Commons Attribution license.", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0.", "Released under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "Released under the Unlicense.", "SPDX-License-Identifier: Unlicense"),
    "ISC": ("Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Licensed under the ISC license.", "SPDX-License-Identifier: ISC"),
}

#: Sentences of licences that are none of the families.
UNKNOWN = (
    "All rights reserved.", "Copyright by the authors.", "Copyright 2019 by the company, all rights reserved.", "Licensed under the terms of the vendor agreement.", "This software is released under a proprietary license.",
    "See the license for details.", "See the LICENSE file for the license terms.", "Released under the terms agreed with the publisher.", "Use of this file is subject to the terms of service.",
    "Commercial use is not permitted without written permission.", "Licensed under an unknown license, version 9.", "Released under the license of the project.", "This work is licensed.", "This work is licensed under its own license.",
    "Distributed under the Artistic License.", "Licensed under the Eclipse Public License, version 1.0.", "Released under the Boost Software License.", "SPDX-License-Identifier: Proprietary", "SPDX-License-Identifier: Zlib",
    "Distributed under a copyleft license.", "You must not redistribute this software without a license.", "This software may be used under the license of the university.", "Licensed to the customer only.", "The license is granted for evaluation only.",
)

#: Sentences that share words with licences and are none.
NONE = (
    "A driver needs a license and a permit.", "The license plate was lost.", "The public was free to use the source of the river.", "Content is available on request.", "You may obtain a copy at the library.",
    "Permission was granted by the council.", "The version released in spring was modified.", "The foundation published a general work on software.", "This program was distributed in the theatre.", "The terms of the contract were read aloud.",
    "Please bring a fishing licence to the office.", "The names of its members are known.", "The author of the work was born in the domain of the king.", "The library is open to the public, free of charge.", "A notice about the conditions of the road appeared in the paper.",
    "She can use the form in the file.", "The code of the building has changed.", "The following holds for either version of the text.", "Anyone may be permitted to enter.", "The company has a commercial purpose.",
    "He had to sell copies of the paper at any means.", "The source and the binary star are far away.", "The international union published its work.", "To the person with the file on the table.", "This is the place to compile a list of names.",
    "Derived products are sold by the holder of the shop.", "The project began in version 2 of the plan.", "Apache is the name of a people.", "Boston is home to a university, MIT.", "The Creative Arts centre opened 4 years ago.",
)

#: Function words: an n-gram of these alone is no feature.
FUNCTION_WORDS = frozenset("a an the of to in on at by for from with and or is are was be it this that these which you as not all any can may has have had under no if but so we they he she i its their his her your our do does did will would there been were being than then also into out up us".split())

#: A family is reported from this calibrated probability and this share of a template's n-grams.
PROBABLE, CONFIRMED = 0.6, 0.5
GRAMS = 3


def _words(text: str) -> list:
    return re.findall(r"[^\W_]+", text.lower())


def _grams(words: list) -> list:
    out = [" ".join(words[i : i + n]) for n in range(1, GRAMS + 1) for i in range(len(words) - n + 1)]
    return sorted({g for g in out if any(w not in FUNCTION_WORDS for w in g.split())})


def _forms(text: str) -> list:
    """A text's forms for training: whole, without its first or last word, between other words, and its halves if long."""
    w = _words(text)
    out = [w, w[1:], w[:-1], ["it", "is", *w], [*w, "and", "so", "on"], ["copyright", "by", "us", *w]]
    if len(w) > 12:
        out += [w[: len(w) // 2], w[len(w) // 2 :]]
    return [f for f in out if len(f) > 1]


class Model:
    """Features and their coefficients, a row for each feature with a number for each class; fixed size."""

    def __init__(self, classes: list, features: list, weights: list, intercepts: list, temperature: float):
        self.classes, self.features, self.weights, self.intercepts, self.temperature = classes, features, weights, intercepts, temperature


def _other_version(words: list) -> list:
    """The words with each number changed."""
    return [str(int(w) + 5) if w.isdigit() else re.sub(r"\d+", lambda m: str(int(m[0]) + 5), w) for w in words]


def examples() -> list:
    """(class, n-grams, template number): the forms of every template."""
    out = []
    for family, texts in TEMPLATES.items():
        for k, t in enumerate(texts):
            out += [(family, _grams(form), k) for form in _forms(t)]
            w = _words(t)
            if _other_version(w) != w:
                out += [("unknown", _grams(form), k) for form in _forms(" ".join(_other_version(w)))[:4]]
    for name, texts in (("unknown", UNKNOWN), ("none", NONE)):
        out += [(name, _grams(form), k) for k, t in enumerate(texts) for form in _forms(t)]
    return out


def train(spark: SparkSession) -> Model:
    """Fit on the forms of all templates; the temperature comes from a fit without every third template, on those."""
    from math import exp, log

    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    classes = [*sorted(TEMPLATES), "unknown", "none"]
    rows = [(classes.index(c), grams, k % 3 == 2) for c, grams, k in examples()]
    features = sorted({g for _, grams, _ in rows for g in grams})
    at = {g: i for i, g in enumerate(features)}
    table = literal_rows(spark, [{"label": y, "held": held, "at": [at[g] for g in grams]} for y, grams, held in rows], "label double, held boolean, at array<int>")
    dense = F.transform(F.sequence(F.lit(0), F.lit(len(features) - 1)), lambda i: F.array_contains("at", i.cast("int")).cast("double"))
    table = table.select("label", "held", array_to_vector(dense).alias("features"))

    def fitted(part):
        got = LogisticRegression(family="multinomial", regParam=0.001, elasticNetParam=0.0, maxIter=60, standardization=False).fit(part)
        return got.coefficientMatrix.toArray().T.tolist(), list(got.interceptVector.toArray())

    def loss(temperature: float) -> float:
        total = 0.0
        for y, grams, held in rows:
            if held:
                z = [(intercepts[c] + sum(weights[at[g]][c] for g in grams)) / temperature for c in range(len(classes))]
                top = max(z)
                total -= z[y] - top - log(sum(exp(v - top) for v in z))
        return total

    weights, intercepts = fitted(table.where("NOT held"))
    temperature = min((0.25 * 1.15**i for i in range(25)), key=loss)
    return Model(classes, features, *fitted(table), temperature)


#: Comment markers at the start of a line, and where a paragraph is cut into sentences.
MARKERS = r"(?m)^[ \t\r]*(?:(?://+|/\*+|\*+/?|#+|;+|--+|%+|>+|<!--)[ \t]*)*"
BLANK = r"\n[ \t\r]*(?:\n[ \t\r]*)+"
SENTENCE = r"(?<=[.!?][\"')]{0,2})\s+(?=[\"'(]?\p{Lu})"


def sentences(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, _row, paragraph, sentence, words): the units, numbered, with their lower-case words; `_row` tells repeated ids apart."""
    rows = df.select(F.col(key), F.monotonically_increasing_id().alias("_row"), F.regexp_replace(F.col(text), MARKERS, "").alias("_text"))
    parts = rows.select(key, "_row", F.posexplode(F.split("_text", BLANK)).alias("paragraph", "_part"))
    units = parts.select(key, "_row", "paragraph", F.posexplode(F.split("_part", SENTENCE)).alias("sentence", "_unit")).where(F.length("_unit") > 0)
    return units.select(key, "_row", "paragraph", "sentence", F.array_remove(F.split(F.lower("_unit"), r"[^\p{L}\p{N}]+"), "").alias("words"))


def word_grams(words) -> object:
    """The distinct n-grams of a word array column."""
    of = lambda n: F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.array_join(F.slice(words, i + 1, n), " "))
    empty = F.array().cast("array<string>")
    return F.array_distinct(reduce(F.concat, [F.when(F.size(words) >= n, of(n)).otherwise(empty) for n in range(1, GRAMS + 1)]))


def scan(df: DataFrame, model: Model | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, paragraph, sentence, family, probability, template, similarity): a row for each unit with licence terms."""
    spark = df.sparkSession
    model = model or train(spark)
    classes = model.classes
    licence = [t for texts in TEMPLATES.values() for t in texts] + list(UNKNOWN)
    terms = sorted({w for t in licence for w in _words(t)} - FUNCTION_WORDS - {w for t in NONE for w in _words(t)}) + ["license", "licence", "public", "terms", "permission"]
    units = ["_row", "paragraph", "sentence"]
    hit = sentences(df, key, text).where(F.arrays_overlap("words", F.lit(terms)))
    grams = hit.select(key, *units, F.explode(word_grams(F.col("words"))).alias("g"))
    # fixed tables of the model: a row for each feature and each template n-gram
    weights = literal_rows(spark, [{"g": g, "w": w} for g, w in zip(model.features, model.weights, strict=True)], "g string, w array<double>")
    found = grams.join(F.broadcast(weights), "g")
    templates = [(f, i, _grams(_words(t))) for f, texts in sorted(TEMPLATES.items()) for i, t in enumerate(texts)]
    of = literal_rows(spark, [{"g": g, "at": [k for k, (_, _, gs) in enumerate(templates) if g in gs]} for g in sorted({g for _, _, gs in templates for g in gs})], "g string, at array<int>")
    found = found.join(F.broadcast(of), "g", "left")
    sums = [F.sum(F.col("w")[c]).alias(f"z{c}") for c in range(len(classes))]
    shares = [F.sum(F.coalesce(F.array_contains("at", k), F.lit(False)).cast("int")).alias(f"t{k}") for k in range(len(templates))]
    got = found.groupBy(*units).agg(F.any_value(key).alias(key), *sums, *shares)
    z = F.array(*((F.col(f"z{c}") + F.lit(model.intercepts[c])) / F.lit(model.temperature) for c in range(len(classes))))
    got = got.withColumn("z", z).withColumn("top", F.array_max("z"))
    got = got.withColumn("p", F.transform("z", lambda v: F.exp(v - F.col("top")))).withColumn("probability", 1 / F.aggregate("p", F.lit(0.0), lambda a, v: a + v))
    got = got.withColumn("best", F.get(F.lit(classes), F.array_position("z", F.col("top")).cast("int") - 1)).where("best <> 'none'")
    score = [F.struct((F.col(f"t{k}") / len(gs)).alias("similarity"), F.lit(f"{f}/{i}").alias("template"), F.lit(f).alias("family")) for k, (f, i, gs) in enumerate(templates)]
    got = got.withColumn("_t", F.array_max(F.filter(F.array(*score), lambda s: s["family"] == F.col("best"))))
    sure = (F.col("best") != "unknown") & (F.col("probability") >= PROBABLE) & (F.col("_t.similarity") >= CONFIRMED)
    return got.select(key, "paragraph", "sentence", F.when(sure, F.col("best")).otherwise("unknown").alias("family"), "probability", F.when(sure, F.col("_t.template")).alias("template"), F.when(sure, F.col("_t.similarity")).alias("similarity"))
