r"""Licence scan by a trained paragraph classifier (operator 8, native).

Every paragraph of every text is classified into licence families by multinomial logistic regression over hashed word one- and
two-grams; no list of words decides what the classifier sees. A paragraph is a line, with the lines that it is wrapped to: a line
of ``WRAPPED`` code points that doesn't end a sentence goes on in the next one. The classifier is trained here, once a run, on the
fixed notices of ``NOTICES``, on variants of each (a word left out, the halves, with other words before and after) and on an
``unknown`` class: fixed sentences that speak of licences without granting one, their variants, and ``NEGATIVES`` paragraphs of the
corpus, those with the smallest hash (a bounded, documented sample of training rows, which leaves out lines with ``STEMS``, so
that no notice is taught as unknown; predictions cover all paragraphs). The probability is calibrated by temperature on the
held-out variants. Given back are the paragraphs whose probability of any licence is ``MIN_LICENCE`` or more: with the family if
that has ``MIN_PROBABILITY``, else as ``unknown``. A family counts as confirmed only if a template of the same family covers the
paragraph: the share of the template's word two-grams that the paragraph holds, or the reverse for long templates, reaches ``COVER``.

Training and scoring use Spark ML and SQL functions on the JVM; nothing runs in Python on the executors. The model
has ``2 ** BITS`` weights a class at any size of the corpus, and templates are a fixed list, so what is broadcast
doesn't grow. Nothing is shuffled but the training rows.

Edge cases: null and empty texts and lines without a letter or digit have no paragraphs; repeated rows give repeated results; a
paragraph of any length is classified whole; an empty table gives an empty result; other columns than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, materialize, text_of

STEMS = r"(?i)licen[sc]|copyright|permission|warrant|redistribut|public domain|spdx|creative commons|all rights reserved"
#: Code points of a line that may go on in the next one (hard-wrapped prose).
WRAPPED = (40, 120)
#: Lines whose starts are counted together.
BLOCK = 256
BITS = 14
NEGATIVES = 3000
COVER = 0.6
MIN_PROBABILITY = 0.5
MIN_LICENCE = 0.5
UNKNOWN = "unknown"
#: Well-known licence notices, by family.
NOTICES = (
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("apache", "SPDX-License-Identifier: Apache-2.0"),
    ("apache", "Apache-2.0"),
    ("apache", "License: Apache 2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, without warranties or conditions of any kind, either express or implied."),
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the terms of the MIT license."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement."),
    ("mit", "Dual licensed under MIT and GPL."),
    ("mit", "Dual MIT/GPL"),
    ("mit", "Lizenz: MIT"),
    ("mit", "License: MIT"),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc", "Released under the ISC License."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."),
    ("gpl", "Distributed under the GNU GPL v2."),
    ("gpl", "License: GPL-3.0"),
    ("gpl", "This program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose. See the GNU General Public License for more details."),
    ("gpl", "Dieses Programm ist freie Software. Sie können es unter den Bedingungen der GNU General Public License, wie von der Free Software Foundation veröffentlicht, weitergeben und/oder modifizieren."),
    ("gpl", "Veröffentlicht unter der GNU GPL Version 3."),
    ("gpl", "Ce programme est un logiciel libre ; vous pouvez le redistribuer ou le modifier suivant les termes de la GNU General Public License."),
    ("gpl", "Este programa es software libre: puede redistribuirlo y/o modificarlo bajo los términos de la GNU General Public License."),
    ("gpl", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("lgpl", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("agpl", "Licensed under the GNU Affero General Public License, version 3."),
    ("bsd", "Licensed under the BSD 3-Clause License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd", "License: BSD-2-Clause"),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
    ("busl", "Licensed under the Business Source License 1.1."),
    ("busl", "Use of this software is governed by the Business Source License included in the LICENSE file."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "CC BY 4.0"),
    ("cc-by-sa", "CC BY-SA 4.0"),
    ("cc-by-nc", "CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("public-domain", "This work has been released into the public domain."),
    ("public-domain", "This is free and unencumbered software released into the public domain."),
    ("public-domain", "To the extent possible under law, the author has waived all copyright; CC0 1.0 Universal public domain dedication."),
    ("proprietary", "Copyright. All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher."),
    ("proprietary", "Copyright (c) the author. All rights reserved."),
    ("proprietary", "This software is proprietary and confidential; unauthorised copying is strictly prohibited under the license agreement."),
    (UNKNOWN, "Er fuhr mit dem Zug nach Hause, und sie kam mit einem Freund."),
    (UNKNOWN, "Mit freundlichen Grüßen"),
    (UNKNOWN, "Ein Haus mit Garten und einem kleinen Teich."),
    (UNKNOWN, "He lost his driving licence after the accident and had to take the bus."),
    (UNKNOWN, "The city issues a fishing license to every resident who asks for one."),
    (UNKNOWN, "She asked for permission to leave the room before the lesson ended."),
    (UNKNOWN, "Police searched the house with a warrant on Tuesday morning."),
    (UNKNOWN, "The court heard a dispute about copyright in the film and its music."),
    (UNKNOWN, "The government plans to redistribute land among the farmers."),
    (UNKNOWN, "Licensed restaurants may sell wine under the new rules of the council."),
    (UNKNOWN, "The warranty of the machine ended last year."),
)


def grams(paragraph: Column) -> Column:
    """Words (letters, digits, dots and hyphens inside)."""
    return F.regexp_extract_all(paragraph, F.lit(r"([\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*)"), F.lit(1))


def _two(w: Column) -> Column:
    return F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1)))).otherwise(F.array().cast("array<string>"))


def _terms(rows: DataFrame, keep: list[str]) -> DataFrame:
    """``two``, the lower-case two-grams, and ``terms``: besides them the lower-case words, and those in capitals once more, marked."""
    a = rows.select(*keep, grams(F.col("paragraph")).alias("_w"))
    capitals = F.filter("_w", lambda x: (F.length(x) > 1) & (x == F.upper(x)) & (x != F.lower(x)))
    a = a.select(*keep, F.transform("_w", F.lower).alias("_w"), F.transform(capitals, lambda x: F.concat(F.lit("^"), x)).alias("_c"))
    return a.select(*keep, F.array_distinct(_two(F.col("_w"))).alias("two"), F.concat("_w", _two(F.col("_w")), "_c").alias("terms"))


def _vectors(rows: DataFrame, keep: list[str]) -> DataFrame:
    return HashingTF(inputCol="terms", outputCol="features", numFeatures=1 << BITS, binary=True).transform(_terms(rows, keep))


def paragraphs(docs: DataFrame) -> DataFrame:
    """``doc_id, paragraph_no, start, paragraph`` of every paragraph with a letter or digit; offsets in code points.

    The end of a wrapped line becomes a blank, so lengths stay. Starts are sums of the lengths before: of whole blocks of ``BLOCK``
    paragraphs, then of those before in its block, so a text of very many lines costs little more than it has lines."""
    least, most = WRAPPED
    body = F.regexp_replace(text_of(), rf"(?md)^([^\n]{{{least - 1},{most - 1}}}[^\n.!?:;\s])\n(?=[^\n])", "$1 ")
    lines = docs.select("doc_id", F.split(body, "\n").alias("_l"))
    lines = lines.withColumn("_n", F.transform("_l", lambda x: F.length(x).cast("long") + 1))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda acc, x: acc + x)
    lines = lines.withColumn("_b", F.transform(F.sequence(F.lit(0), F.floor((F.size("_l") - 1) / BLOCK).cast("int")), lambda b: total(F.slice("_n", b * BLOCK + 1, F.lit(BLOCK)))))

    def row(x: Column, i: Column) -> Column:
        block = F.floor(i / BLOCK).cast("int")
        start = total(F.slice("_b", F.lit(1), block)) + total(F.slice("_n", block * BLOCK + 1, i - block * BLOCK))
        return F.struct(i.alias("paragraph_no"), start.alias("start"), x.alias("paragraph"))

    return lines.select("doc_id", F.inline(F.transform("_l", row))).filter(F.col("paragraph").rlike(r"[\p{L}\p{N}]"))


def training_rows(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``family, paragraph, held_out``: notices, their variants, and corpus paragraphs of the unknown class."""
    fixed = spark.createDataFrame(list(NOTICES), "family string, notice string")
    w = fixed.select("family", "notice", F.split("notice", " ").alias("w"))
    drop = F.transform(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.array_join(F.filter(F.col("w"), lambda x, j: j != i), " "))
    half = F.array(F.array_join(F.slice("w", F.lit(1), F.ceil(F.size("w") * 0.75).cast("int")), " "),
                   F.concat(F.lit("Note: "), F.col("notice")), F.concat(F.col("notice"), F.lit(" See the file for details.")))
    variants = (w.select("family", F.posexplode(F.concat(F.array("notice"), half, drop)).alias("n", "paragraph"))
                .select("family", "paragraph", (F.col("n") % 4 == 2).alias("held_out")))
    plain = (docs.select(F.explode(F.split(text_of(), "\n")).alias("paragraph")).filter(F.length("paragraph").between(20, 400) & ~F.col("paragraph").rlike(STEMS))
             .withColumn("h", F.xxhash64("paragraph")))
    # only hashes are sorted; then the paragraphs at or below the last of them are read
    last = plain.select("h").distinct().orderBy("h").limit(NEGATIVES).agg(F.max("h")).first()[0]
    plain = plain.filter(F.col("h") <= (last if last is not None else 0)).distinct()
    return variants.unionByName(plain.select(F.lit(UNKNOWN).alias("family"), "paragraph", (F.pmod("h", F.lit(4)) == 2).alias("held_out")))


class Model:
    def __init__(self, families: list[str], regression: LogisticRegressionModel, temperature: float):
        self.families, self.regression, self.temperature = families, regression, temperature


def train(spark: SparkSession, docs: DataFrame) -> Model:
    families = sorted({f for f, _ in NOTICES})
    code = F.create_map(*[x for i, f in enumerate(families) for x in (F.lit(f), F.lit(float(i)))])
    rows = training_rows(spark, docs).withColumn("label", code[F.col("family")])
    # each family weighs the same
    data = materialize(_vectors(rows, ["family", "label", "held_out"]).select("label", "held_out", "features").repartition(1), "licence-train")
    share = data.groupBy("label").agg((F.lit(1.0) / F.count("*")).alias("weight"))
    data = data.join(share, "label")
    fit = LogisticRegression(regParam=0.0002, maxIter=60, weightCol="weight", family="multinomial", standardization=False).fit(data.filter(~F.col("held_out")))
    raw = fit.transform(data.filter("held_out")).select("label", "weight", vector_to_array("rawPrediction").alias("raw"))

    def loss(t: float) -> Column:
        top = F.array_max("raw") / t
        return F.sum(F.col("weight") * (F.log(F.aggregate("raw", F.lit(0.0), lambda a, x: a + F.exp(x / t - top))) + top - F.get("raw", F.col("label").cast("int")) / t))

    grid = [0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0]
    losses = raw.agg(*[loss(t).alias(str(i)) for i, t in enumerate(grid)]).first()
    best = min(range(len(grid)), key=lambda i: (losses[i] if losses[i] is not None else 0.0, i))
    return Model(families, fit, grid[best])


def _templates(spark: SparkSession) -> dict[str, list[str]]:
    """Two-grams of each notice (a fixed list)."""
    fixed = spark.createDataFrame([n for f, n in NOTICES if f != UNKNOWN], "string").toDF("paragraph")
    return {r["paragraph"]: r["two"] for r in _terms(fixed, ["paragraph"]).collect()}


def _cover(two: Column, known: list[str]) -> Column:
    shared = F.size(F.array_intersect(two, F.array(*[F.lit(x) for x in known])))
    return F.greatest(shared / F.lit(float(len(known))), F.when(F.size(two) >= 6, shared / F.size(two)).otherwise(F.lit(0.0)))


def _once(rows: DataFrame, keep: list[str], name: str, value: Column) -> DataFrame:
    """``keep`` and ``value``, computed once a row: a filter isn't pushed through a generator, which would compute it again."""
    return rows.select(*keep, F.explode(F.array(value)).alias(name))


def classify(found: DataFrame, model: Model) -> DataFrame:
    """The rows of ``found`` that are licences by ``MIN_LICENCE``, with ``family`` (unknown if none is probable enough),
    ``probability`` of it, ``licence_probability, template_cover, confirmed``."""
    templates = _templates(found.sparkSession)
    keep = list(found.columns)
    none = model.families.index(UNKNOWN)
    scored = _once(model.regression.transform(_vectors(found, keep)), keep, "_raw", vector_to_array("rawPrediction"))
    # the calibrated probabilities: temperature divides the margins
    scored = _once(scored, keep, "_e", F.transform("_raw", lambda x: F.exp((x - F.array_max("_raw")) / model.temperature)))
    scored = _once(scored, keep, "_p", F.transform("_e", lambda x: x / F.aggregate("_e", F.lit(0.0), lambda a, y: a + y)))
    likely = scored.filter(1 - F.get("_p", F.lit(none)) >= MIN_LICENCE)
    names = F.array(*[F.lit(f) for f in model.families])
    best = F.array_max(F.transform("_p", lambda p, i: F.struct(F.when(i == none, -1.0).otherwise(p).alias("p"), (-i).alias("i"))))
    likely = _terms(likely.select(*keep, "_p", best.alias("_best")), [*keep, "_p", "_best"])
    likely = likely.select(*keep, "two", F.get(names, -F.col("_best.i")).alias("_family"), F.col("_best.p").alias("probability"),
                           (1 - F.get("_p", F.lit(none))).alias("licence_probability"))
    cover = F.lit(0.0)
    for f in sorted({f for f, _ in NOTICES if f != UNKNOWN}):
        each = [_cover(F.col("two"), templates[n]) for g, n in NOTICES if g == f and templates[n]]
        cover = F.when(F.col("_family") == f, F.greatest(*each, F.lit(0.0))).otherwise(cover)
    out = likely.select(*keep, F.when(F.col("probability") >= MIN_PROBABILITY, F.col("_family")).otherwise(F.lit(UNKNOWN)).alias("family"),
                        F.round("probability", 6).alias("probability"), F.round("licence_probability", 6).alias("licence_probability"),
                        F.round(cover, 6).alias("template_cover"))
    return out.withColumn("confirmed", (F.col("family") != UNKNOWN) & (F.col("template_cover") >= COVER))


def op8_license_scan(spark, sf_dir) -> DataFrame:
    """Every licence paragraph of ``documents``: place, family, probabilities and confirmation."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    out = classify(paragraphs(docs), train(spark, docs))
    return out.select("doc_id", "paragraph_no", "start", F.length("paragraph").alias("n_chars"), "family", "probability", "licence_probability",
                      "template_cover", "confirmed")
