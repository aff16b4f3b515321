"""Licence scans: a trained paragraph classifier confirmed by comparison with templates.

Every line of a text is a paragraph. Its words and pairs of neighbouring words (ASCII letters and digits,
lower-cased) are hashed into ``BUCKETS`` binary features, of which those that occur in template passages count, and a
sparse multinomial logistic regression gives the probability of each licence family and of none. A paragraph of more than ``WINDOW`` words is scored
in overlapping windows, one beginning every ``STEP`` words, so that the features of a long one do not fill all
buckets; its window with the most probable family speaks for it. The classifier is trained on passages cut from the
templates and on paragraphs of a bounded sample of documents. A family must reach a probability that only
one in a thousand unknown paragraphs of the calibration part reaches.

Versions and variants of a licence are families of their own. The template comparison confirms a prediction
only if, of all templates whose deciding words agree with the paragraph's, one of the predicted family is the
most similar, with at least ``SIMILARITY`` of the word pairs of the shorter of the two. Deciding words agree
if every name and version of the template (``REQUIRED``, ``VERSIONS``) is in the paragraph and both have the same variants
(``VARIANTS``). A paragraph that denies the licence (``DENIAL``) agrees with no template.

Scanning uses DataFrame functions only: the model's weights are constants in the plan, and nothing is shuffled. A
window whose features could not give any family a probability of one half is not scored further; the bound is exact.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm.common import let
from holdfast.session import durable

BUCKETS = 1 << 14
SAMPLE_DOCS = 500
SIMILARITY = 0.6
LEAST_PROBABILITY = 0.5
PASSAGE = 6
WINDOW = 64
STEP = 32
SENTENCE_WEIGHT = 50.0
CALIBRATION = 0.999
UNKNOWN = "unknown"

#: Sentences of public licence texts and notices, by family (fixed values).
TEMPLATES = {
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: AGPL-3.0",
    ),
    "Apache-1.1": (
        "Licensed under the Apache License, Version 1.1.",
        "The Apache Software License, Version 1.1",
        "SPDX-License-Identifier: Apache-1.1",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ),
    "BSD-2-Clause": (
        "Licensed under the BSD 2-Clause License.",
        "This project is released under the Simplified BSD 2-Clause License.",
        "SPDX-License-Identifier: BSD-2-Clause",
    ),
    "BSD-3-Clause": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "BSL-1.0": (
        "Distributed under the Boost Software License, Version 1.0.",
        "Use, modification and distribution are subject to the Boost Software License, Version 1.0.",
        "SPDX-License-Identifier: BSL-1.0",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "CC-BY-NC-ND-4.0": (
        "Licensed under CC BY-NC-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-ND-4.0",
    ),
    "CC-BY-NC-SA-4.0": (
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-SA-4.0",
    ),
    "CC-BY-ND-4.0": (
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-ND-4.0",
    ),
    "CC-BY-SA-3.0": (
        "Licensed under CC BY-SA 3.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.",
        "SPDX-License-Identifier: CC-BY-SA-3.0",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "CC0-1.0": (
        "Licensed under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0.",
        "This work is dedicated to the public domain under the Creative Commons CC0 1.0 Universal Public Domain Dedication.",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "EPL-2.0": (
        "Licensed under the Eclipse Public License, version 2.0.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-2.0",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0",
    ),
    "GPL": (
        "You should have received a copy of the GNU General Public License along with this program.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    ),
    "ISC": (
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ),
    "LGPL-2.1": (
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: LGPL-2.1",
    ),
    "LGPL-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: LGPL-3.0",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "The MIT License (MIT)",
        "SPDX-License-Identifier: MIT",
    ),
    "MPL-2.0": (
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Released into the public domain under the Unlicense.",
        "SPDX-License-Identifier: Unlicense",
    ),
}

#: Deciding words, as patterns on the lower-cased words joined by single spaces (fixed values). A name or version
#: of a template must be in the paragraph; variants must be the same in both; denials are in no template.
REQUIRED = (
    r"\bapache\b", r"\bbsd\b", r"\b(boost|bsl)\b", r"\b(cc|creative commons)\b", r"\bcc0\b", r"\b(eclipse|epl)\b",
    r"\b(gnu|[al]?gpl)", r"\bisc\b", r"\bmit\b", r"\b(mozilla|mpl)\b", r"\bunlicense\b", r"\bpublic domain\b", r"\b3 clause\b",
)
VARIANTS = (
    r"\b(by nc|non ?commercial)\b", r"\b(by( nc)? sa|share ?alike)\b", r"\b(by( nc)? nd|no ?deriv(ative)?s?)\b",
    r"\b(lgpl|lesser general public|library general public)", r"\b(agpl|affero general public)", r"\b2 clause\b", r"\b[014] clause\b",
)
VERSIONS = ("1.0", "1.1", "2.0", "2.1", "2.5", "3.0", "4.0")
BEFORE_VERSION = (
    "version", "v", "licen[cs]es?", "by", "nc", "sa", "nd", "attribution", "noncommercial", "sharealike", "noderivatives",
    "[al]?gpl", "mpl", "epl", "bsl", "cc0", "apache",
)
DENIAL = r"\b(no|not|never|no longer|isn t|aren t|cannot|neither|nor)( [a-z0-9]+){0,2} (licen[cs]ed|released|covered|governed|available|redistributed|granted|dedicated)\b"


def _version(number: str) -> str:
    major, minor = number.split(".")
    end = f"( {minor})?" if minor == "0" else f" {minor}"
    return rf"\b({'|'.join(BEFORE_VERSION)}) ?v?{major}{end}(?![0-9])(?! [0-9]\b)"


_MARKS = [*REQUIRED, *map(_version, VERSIONS), *VARIANTS, DENIAL]
_SAME = sum(1 << i for i in range(len(REQUIRED) + len(VERSIONS), len(_MARKS)))


@dataclass
class Model:
    """The weighted buckets, weights by family over them, intercepts, and the probability that counts as a detection."""

    families: list[str]
    buckets: list[int]
    weights: list[list[float]]
    intercepts: list[float]
    least: float


def _plain(paragraph: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(paragraph), "[^a-z0-9]+", " "))


def _terms(paragraph: Column) -> Column:
    inner = _plain(paragraph)
    return F.when(F.length(inner) > 0, F.split(inner, " ")).otherwise(F.array().cast("array<string>"))


def _hashes(paragraph: Column) -> Column:
    return F.transform(_terms(paragraph), lambda w: F.xxhash64(w))


def _pairs(hashes: Column) -> Column:
    firsts = F.slice(hashes, 1, F.greatest(F.size(hashes) - 1, F.lit(0)))
    return F.transform(firsts, lambda h, i: F.xxhash64(h, F.get(hashes, i + 1)))


def _buckets(hashes: Column) -> Column:
    return F.transform(F.concat(hashes, _pairs(hashes)), lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int"))


def _windows(hashes: Column) -> Column:
    """The word hashes cut into windows that cover every word: one of all up to ``WINDOW`` words, else one
    at every ``STEP`` words until the last word is reached."""
    last = F.ceil(F.greatest(F.size(hashes) - WINDOW, F.lit(0)) / STEP).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(hashes, k * STEP + 1, F.lit(WINDOW)))


def _constant(values: list, kind: str) -> Column:
    """An array that the optimizer folds into one constant."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def passages(spark: SparkSession) -> DataFrame:
    """Training paragraphs of every family: its sentences and all their passages of ``PASSAGE`` or more words."""
    rows = [(family, sentence) for family, sentences in TEMPLATES.items() for sentence in sentences]
    listed = spark.createDataFrame(rows, "family string, sentence string").withColumn("w", F.split("sentence", " "))
    size = F.size("w")
    starts = F.explode(F.sequence(F.lit(1), F.greatest(size - (PASSAGE - 1), F.lit(1))))
    cut = listed.withColumn("size", size).withColumn("start", starts).withColumn(
        "n", F.explode(F.sequence(F.least(F.lit(PASSAGE), F.col("size")), F.col("size") - F.col("start") + 1)))
    cut = cut.select("family", "sentence", F.array_join(F.slice("w", F.col("start"), F.col("n")), " ").alias("paragraph")).distinct()
    of = cut.groupBy("sentence").agg(F.count(F.lit(1)).alias("n"))
    # A sentence as a whole counts as much as all its passages together, and every sentence the same.
    weight = SENTENCE_WEIGHT * F.when(F.col("paragraph") == F.col("sentence"), 1.0).otherwise(1.0 / F.col("n"))
    return cut.join(of, "sentence").select("family", "paragraph", weight.alias("weight"))


def unknown_paragraphs(docs: DataFrame, id_col: str, text_col: str, sample_docs: int) -> DataFrame:
    """Different paragraphs of the ``sample_docs`` documents of smallest id hash; of those, the ones that
    are similar to a template, whatever their deciding words, are left out."""
    ids = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id")).distinct().orderBy(F.xxhash64("_id"), "_id").limit(sample_docs)
    # At most ``sample_docs`` ids.
    chosen = docs.join(F.broadcast(durable(ids)), F.col(f"`{id_col}`") == F.col("_id"), "left_semi")
    lines = chosen.select(F.explode(F.split(F.col(text_col), "\n")).alias("paragraph")).where("paragraph is not null").distinct()
    alike = F.array_max(_similarities(F.col("paragraph"), templates(docs.sparkSession)))
    return lines.where(alike < SIMILARITY).select(F.lit(UNKNOWN).alias("family"), "paragraph", F.lit(1.0).alias("weight"))


@dataclass
class Template:
    """A sentence's family, the different hashes of its word pairs, and its deciding words as bits."""

    family: str
    pairs: list[int]
    marks: int


def _marks(paragraph: Column) -> Column:
    """One bit for each deciding pattern that the paragraph has, as a long."""
    return let(_plain(paragraph), lambda p: reduce(
        Column.bitwiseOR, [F.when(F.regexp_like(p, F.lit(x)), F.lit(1 << i)).otherwise(0).cast("long") for i, x in enumerate(_MARKS)]))


def templates(spark: SparkSession) -> list[Template]:
    """Every template sentence, in the order of ``TEMPLATES``."""
    rows = [(i, family, sentence) for i, (family, sentence) in enumerate((f, x) for f, listed in TEMPLATES.items() for x in listed)]
    listed = spark.createDataFrame(rows, "i int, family string, sentence string").select(
        "i", "family", let(_hashes(F.col("sentence")), lambda h: F.array_distinct(_pairs(h))).alias("pairs"),
        _marks(F.col("sentence")).alias("marks"))
    return [Template(r["family"], r["pairs"], r["marks"]) for r in sorted(listed.collect(), key=lambda r: r["i"])]


def _similarities(paragraph: Column, listed: list[Template]) -> Column:
    """For every template the share of the word pairs of the shorter text that both have; zero for
    paragraphs of fewer than two pairs."""
    def share(p: Column, template: Template) -> Column:
        both = F.size(F.array_intersect(p, _constant(template.pairs, "long")))
        return F.when(F.size(p) >= 2, both / F.least(F.size(p), F.lit(len(template.pairs)))).otherwise(0.0)

    return let(let(_hashes(paragraph), lambda h: F.array_distinct(_pairs(h))), lambda p: F.array(*[share(p, t) for t in listed]))


def _agreeing(marks: Column, template: Template) -> Column:
    needed = marks.bitwiseAND(F.lit(template.marks)) == F.lit(template.marks)
    return needed & (marks.bitwiseAND(F.lit(_SAME)) == F.lit(template.marks & _SAME))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fit on template passages and sampled paragraphs; every fifth sampled paragraph calibrates instead.

    Documents with NULL ids are not sampled; NULL and empty texts give no paragraph; equal paragraphs count once,
    also in rows of equal ids; other columns are not read. Without documents the templates alone are fitted.
    """
    spark = docs.sparkSession
    families = [UNKNOWN, *TEMPLATES]
    labels = F.create_map(*[x for i, f in enumerate(families) for x in (F.lit(f), F.lit(float(i)))])
    rows = passages(spark).unionByName(unknown_paragraphs(docs, id_col, text_col, sample_docs))
    rows = durable(rows.select(labels[F.col("family")].alias("label"), "paragraph", "weight", F.explode(let(_hashes(F.col("paragraph")), _windows)).alias("window"),
                               (F.pmod(F.xxhash64("paragraph"), F.lit(5)) == 0).alias("holds"))
                   .withColumn("terms", _buckets(F.col("window")).cast("array<string>")))
    # At most ``BUCKETS`` numbers.
    vocabulary = sorted(int(r[0]) for r in rows.where("label > 0").select(F.explode("terms")).distinct().collect())
    sparse = CountVectorizerModel.from_vocabulary([str(b) for b in vocabulary], "terms", "features").setBinary(True)
    fitted = LogisticRegression(regParam=0.001, elasticNetParam=0.5, maxIter=60, family="multinomial", weightCol="weight").fit(
        sparse.transform(rows.where("label > 0 or not holds")))
    matrix, n = fitted.coefficientMatrix.toArray().round(6), fitted.numClasses
    used = [i for i in range(len(vocabulary)) if matrix[:, i].any()]
    weights = [[float(matrix[c, i]) for i in used] if c < n else [0.0] * len(used) for c in range(len(families))]
    intercepts = [float(fitted.interceptVector[c]) if c < n else -50.0 for c in range(len(families))]
    model = Model(families, [vocabulary[i] for i in used], weights, intercepts, LEAST_PROBABILITY)
    held = rows.where("label = 0 and holds").select("paragraph").distinct().select(_best(F.col("paragraph"), model)["probability"].alias("p"))
    highest = held.agg(F.expr(f"percentile(p, {CALIBRATION})")).first()[0]
    model.least = max(LEAST_PROBABILITY, min(highest or 0.0, 0.99))
    return model


def _best(paragraph: Column, model: Model) -> Column:
    """The most probable family of the paragraph's windows as struct of ``best`` (its place in
    ``model.families``) and ``probability``; of equal ones the first. Place and probability are 0 where no
    family can reach ``LEAST_PROBABILITY``."""
    n = len(model.families)
    place = {b: i + 1 for i, b in enumerate(model.buckets)}
    slot = _constant([place.get(b, 0) for b in range(BUCKETS)], "int")
    weights = [[0.0, *w] for w in model.weights]
    # How far a feature lifts, at most, any family above none; a family of probability one half lies above none.
    lifts = [max(w[i] for w in weights[1:]) - weights[0][i] for i in range(len(place) + 1)]
    start = max(model.intercepts[1:]) - model.intercepts[0]

    def total(found: Column, values: list[float], first: float) -> Column:
        return let(_constant(values, "double"), lambda t: F.aggregate(found, F.lit(first), lambda s, b: s + F.get(t, b)))

    def softmax(z: Column) -> Column:
        return let(F.array_max(z), lambda top: let(F.transform(z, lambda x: F.exp(x - top)), lambda e: F.transform(
            e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))))

    def verdict(p: Column) -> Column:
        return let(F.slice(p, 2, n - 1), lambda q: let(F.array_max(q), lambda top: F.struct(
            F.array_position(q, top).cast("int").alias("best"), top.alias("probability"))))

    def logits(found: Column) -> Column:
        return F.array(*[total(found, w, c) for w, c in zip(weights, model.intercepts)])

    def scored(found: Column) -> Column:
        none = F.struct(F.lit(0).alias("best"), F.lit(0.0).alias("probability"))
        return F.when(total(found, lifts, start) >= -1e-6, let(let(logits(found), softmax), verdict)).otherwise(none)

    def window(hashes: Column) -> Column:
        return let(slot, lambda on: let(F.filter(F.transform(F.array_distinct(_buckets(hashes)), lambda b: F.get(on, b)), lambda x: x > 0), scored))

    return let(F.transform(let(_hashes(paragraph), _windows), window), lambda all: F.aggregate(
        all, F.get(all, F.lit(0)), lambda a, b: F.when(b["probability"] > a["probability"], b).otherwise(a)))


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per detected paragraph: ``doc_id``, ``paragraph`` (its line number from 0), ``family``,
    ``probability`` (rounded to six digits), ``similarity`` (to the family's templates) and ``confirmed``.

    NULL and empty texts and paragraphs of no family give no rows; a line is read whole, however long. Rows
    with equal or NULL ids are scanned one by one; other columns are not read. An empty table gives no rows.
    """
    listed = templates(docs.sparkSession)
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("paragraph", "line"))
    # Made by a generator, a verdict is reached once a line; a condition on a column would repeat its whole expression.
    found = F.filter(F.array(_best(F.col("line"), model)), lambda v: (v["best"] > 0) & (v["probability"] >= model.least))
    scored = lines.select("*", F.explode(found).alias("v"))
    named = scored.withColumn("family", F.get(F.array(*map(F.lit, model.families)), F.col("v.best")))

    def judged(like: Column, marks: Column) -> Column:
        rows = F.array(*[F.struct(F.lit(t.family).alias("family"), F.get(like, F.lit(i)).alias("like"), _agreeing(marks, t).alias("agrees"))
                         for i, t in enumerate(listed)])
        return let(rows, lambda r: F.struct(
            F.array_max(F.transform(F.filter(r, lambda t: t["family"] == F.col("family")), lambda t: t["like"])).alias("similarity"),
            F.array_max(F.transform(F.filter(r, lambda t: t["agrees"]), lambda t: t["like"])).alias("most"),
            F.array_max(F.transform(F.filter(r, lambda t: t["agrees"] & (t["family"] == F.col("family"))), lambda t: t["like"])).alias("own")))

    compared = named.select("*", F.explode(F.array(let(_similarities(F.col("line"), listed), lambda like: let(_marks(F.col("line")), lambda m: judged(like, m))))).alias("c"))
    return compared.select(
        "doc_id", F.col("paragraph").cast("long").alias("paragraph"), "family", F.round("v.probability", 6).alias("probability"),
        "c.similarity", F.coalesce((F.col("c.own") >= SIMILARITY) & (F.col("c.own") == F.col("c.most")), F.lit(False)).alias("confirmed"))
