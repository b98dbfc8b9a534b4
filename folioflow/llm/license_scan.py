"""Licence scan: sparse word n-gram logistic regression over paragraphs (DataFrame functions and pyspark.ml only).

A paragraph is a line, and a run of neighbouring lines that may all belong to a licence is read as one paragraph besides, since
notices are often wrapped. The classifier learns licence families from templates, their parts and common wordings around the
licences' names; the class ``unknown`` from the same wordings around the names of other licences and from a bounded sample
of the corpus's own paragraphs. Probabilities are calibrated on wordings and sample paragraphs that training does not
see. A prediction is confirmed by comparing all of the paragraph with the family's templates.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, let, text_of

UNKNOWN = "unknown"
#: Bounds: paragraphs of the corpus in the training sample, n-grams in the vocabulary.
SAMPLE, VOCABULARY = 4000, 16384
#: A word in so large a share of the sample's paragraphs is no feature by itself.
COMMON_SHARE = 0.02
#: Least calibrated probability of a licence, and least share of all of a paragraph's n-grams that the family's templates hold.
LEAST, LEAST_SHARED = 0.5, 0.25

# Notices and key sentences of public licences, by family.
TEMPLATES = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "bsd": (
        "Released under the BSD License.",
        "Licensed under the 3-Clause BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "You are free to share and adapt the material for any purpose, even commercially, as long as you give appropriate credit.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "You may not use the material for commercial purposes under the Creative Commons NonCommercial License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "If you remix, transform, or build upon the material, you must distribute your contributions under the same license as the original.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": (
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED',
        "SPDX-License-Identifier: MIT",
    ),
    "mpl": (
        "Licensed under the Mozilla Public License, Version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "public-domain": (
        "Released into the public domain under CC0 1.0.",
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0 Universal.",
        "SPDX-License-Identifier: CC0-1.0",
    ),
}
# Names of licences, by family, with and without versions, as SPDX has them, and in the corpus's languages; those of
# no family here are examples of the class unknown.
NAMES = {
    "apache": (
        "Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license", "Apache-2.0", "Apache 2.0", "Apache-Lizenz", "Apache-Lizenz 2.0",
        "licence Apache", "licence Apache 2.0", "licencia Apache 2.0",
    ),
    "bsd": ("BSD License", "3-Clause BSD License", "BSD 2-Clause License", "New BSD License", "BSD-3-Clause", "BSD-2-Clause", "BSD-Lizenz", "licence BSD", "licencia BSD"),
    "cc-by": ("Creative Commons Attribution 4.0 International License", "CC BY 4.0 license", "CC BY 3.0", "CC BY 4.0", "CC-BY-3.0"),
    "cc-by-nc": ("Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0 license", "CC BY-NC 3.0", "CC BY-NC 4.0", "CC BY-NC"),
    "cc-by-sa": ("Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0 license", "CC BY-SA 3.0", "CC BY-SA 4.0", "CC BY-SA"),
    "gpl": (
        "GNU General Public License, version 3", "GNU General Public License v2", "GNU GPL", "GPL v3", "GPLv2", "GPLv3", "GPL", "GPL-3.0-or-later",
        "GPL-2.0-only", "GPLv2 or later", "GPL version 2 or any later version", "GNU GPL version 3",
    ),
    "lgpl": ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v3", "LGPL v2.1", "LGPL", "LGPLv3", "LGPL version 3", "LGPL-2.1-only"),
    "mit": ("MIT License", "MIT/Expat license", "MIT", "MIT-Lizenz", "licence MIT", "licencia MIT"),
    "mpl": ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL 2.0", "MPL-2.0", "MPL", "MPL, version 1.1"),
    "public-domain": ("CC0 1.0 Universal", "CC0 1.0 public domain dedication", "Unlicense", "CC0", "CC0-1.0", "Creative Commons Zero", "public domain"),
    UNKNOWN: (
        "Eclipse Public License v 2.0", "Common Development and Distribution License, Version 1.1", "ISC License", "zlib License",
        "GNU Affero General Public License, version 3", "Artistic License 2.0", "Boost Software License 1.0", "SIL Open Font License 1.1",
        "Microsoft Public License", "European Union Public Licence v. 1.2", "PostgreSQL License", "Python Software Foundation License, version 2",
        "Creative Commons Attribution-NoDerivatives 4.0 International License", "commercial license", "driving license", "license of the city",
        "AGPLv3", "AGPL-3.0-or-later", "EPL-2.0", "EUPL", "GFDL 1.3", "CDDL", "CC BY-ND 4.0", "Boost-Lizenz", "ISC", "zlib", "license", "Lizenz",
        "licence de vente", "licencia de pesca", "general terms", "Stadt", "loi", "ley", "Academic Free License version 3.0", "Open Software License v. 3.0",
    ),
}
# Names of one word that no other licence or thing has, whatever stands around them.
OWN_NAMES = {
    "gpl": ("gpl", "gplv1", "gplv2", "gplv3"), "lgpl": ("lgpl", "lgplv2", "lgplv3"), "mpl": ("mpl", "mplv2"), "public-domain": ("cc0", "unlicense"),
    "bsd": ("bsd",),
}
# Wordings around a name in the corpus's languages; the second part is kept for the calibration.
WORDINGS = (
    "{}", "licensed under the {}", "This software is released under the {}.", "distributed under the terms of the {}, see COPYING",
    "Use of this source code is governed by the {}.", "License: {}", "licensed {}", "{} licensed", "This file is part of a library, licensed {}",
    "You may use and copy this under {}", "Copyright the authors, {}", "the code is under {}",
    "Lizenziert unter der {}", "Das Programm steht unter der {}", "veröffentlicht unter {}", "Texte und Bilder: {}",
    "sous licence {}", "Ce logiciel est sous {}", "distribué sous la {}",
    "bajo licencia {}", "Este programa está bajo la {}", "con {}",
)
KEPT_WORDINGS = (
    "This project is covered by the {}", "made available under the {}; see LICENSE for details", "It is subject to the {}", "Alles hier unter der {}",
    "un module sous {}", "publicado bajo {}",
)
FAMILIES = [UNKNOWN, *sorted(TEMPLATES)]


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits, ``licence`` in its other spelling."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), "licence", "license"), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def grams(ws: Column) -> Column:
    """Distinct words, pairs and triples of neighbouring words."""

    def few(w: Column, n: int) -> Column:
        starts = F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(n)]))

    return let(ws, lambda w: F.array_distinct(F.concat(w, few(w, 2), few(w, 3))))


def listed(texts: set[str]) -> Column:
    """Texts without line feeds as one literal array, whatever their number; no texts are one empty text."""
    return F.split(F.lit("\n".join(sorted(texts))), "\n")


def literal_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A bounded list of the driver's as a DataFrame, by way of one literal."""
    one = spark.range(1).select(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>").alias("rows"))
    return one.select(F.explode("rows").alias("r")).select("r.*")


def worded(spark: SparkSession, wordings: tuple[str, ...]) -> DataFrame:
    """(family, ws): names of licences in each of the wordings."""
    rows = [{"family": f, "text": w.format(n)} for f, names in NAMES.items() for n in names for w in wordings]
    return literal_table(spark, rows, "family string, text string").select("family", words(F.col("text")).alias("ws"))


def training_templates(spark: SparkSession) -> DataFrame:
    """(family, ws): the templates, their parts of 5 and 9 words around each word pair in fives, and worded names."""
    rows = [{"family": f, "text": t} for f, ts in TEMPLATES.items() for t in ts]
    whole = literal_table(spark, rows, "family string, text string").select("family", words(F.col("text")).alias("ws"))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("ws") - 5), F.lit(5))
    parts = whole.withColumn("a", F.explode(starts)).withColumn("n", F.explode(F.array(F.lit(5), F.lit(9))))
    parts = parts.select("family", F.slice("ws", F.col("a") + 1, F.col("n")).alias("ws")).where(F.size("ws") >= 3)
    return whole.union(parts).union(worded(spark, WORDINGS)).distinct()


@dataclass
class Classifier:
    """Weights of each n-gram by family, intercepts, slope and offset of the calibration, the words that any licence needs (none: no such words)."""

    weights: dict[str, list[float]]
    intercepts: list[float]
    slope: float
    offset: float
    keys: list[str]


def train(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> Classifier:
    """Fit on templates, worded names and about ``sample`` paragraphs of ``docs``, chosen by hash, of which a quarter is held out.

    The sample's paragraphs count as unknown but for those that share three words in a row with a template or name. ``docs``
    without any paragraph leave the rest to train on.
    """
    spark = docs.sparkSession
    templates = cut(training_templates(spark))
    split = F.split(text_of(text_col), "\n")
    n_lines = docs.agg(F.coalesce(F.sum(F.size(split)), F.lit(0))).first()[0]
    lines = docs.select(F.explode(split).alias("text")).where("trim(text) <> ''")
    one_in = F.lit(max(1, n_lines // sample))
    picked = lines.withColumn("h", F.xxhash64("text")).where(F.pmod("h", one_in) == 0).distinct()
    ranked = picked.orderBy(F.xxhash64("h"), "text").limit(2 * sample)  # few more than ``sample`` by chance
    stated = [{"text": t} for f in TEMPLATES for t in TEMPLATES[f] + NAMES[f]]
    stated_words = literal_table(spark, stated, "text string").select(words(F.col("text")).alias("ws")).collect()  # this module's own
    known = listed({" ".join(r.ws[i : i + 3]) for r in stated_words for i in range(len(r.ws) - 2)})
    background = ranked.select("text", "h", words(F.col("text")).alias("ws")).where(
        (F.size("ws") > 0) & ~F.arrays_overlap(grams(F.col("ws")), known)
    )
    background = cut(background.withColumn("held", F.pmod(F.xxhash64("h"), F.lit(4)) == 0))
    n = background.count()
    common = (
        background.select(F.explode(F.array_distinct("ws")).alias("w"))
        .groupBy("w")
        .agg((F.count(F.lit(1)) / F.lit(max(n, 1))).alias("share"))
    )
    shares = {r.w: r.share for r in common.where(F.col("share") >= COMMON_SHARE / 10).collect()}  # words of a bounded sample
    often = listed({w for w, s in shares.items() if s >= COMMON_SHARE})
    rare = F.filter(grams(F.col("ws")), lambda g: F.size(F.array_except(F.split(g, " "), often)) > 0)
    label = F.array_position(F.array([F.lit(f) for f in FAMILIES]), F.col("family")) - 1
    trained = templates.select("family", "ws").union(background.where("not held").select(F.lit(UNKNOWN), "ws"))
    labelled = trained.select(label.cast("double").alias("label"), rare.alias("grams"))
    balance = labelled.groupBy("label").agg((1000 / F.count(F.lit(1))).alias("weight"))  # families count alike
    rows = cut(labelled.join(balance, "label").coalesce(1))
    named = cut(templates.select(rare.alias("grams")).coalesce(1))
    vectorizer = CountVectorizer(inputCol="grams", outputCol="features", vocabSize=VOCABULARY, minDF=1, binary=True).fit(named)
    model = LogisticRegression(
        regParam=0.0005, maxIter=60, family="multinomial", standardization=False, weightCol="weight"
    ).fit(vectorizer.transform(rows).select("label", "features", "weight"))
    coefficients = model.coefficientMatrix.toArray()
    weights = {g: [*map(float, coefficients[:, i])] for i, g in enumerate(vectorizer.vocabulary)}
    rarest = lambda g: min(g.split(" "), key=lambda w: (shares.get(w, 0.0), w))
    keys = sorted({rarest(g) for g, w in weights.items() if max(w[1:]) > w[0]})
    found = Classifier(weights, [*map(float, model.interceptVector.toArray())], 1.0, 0.0, keys)
    # Platt's calibration: one slope and one offset for the margin between the best licence and unknown
    kept = worded(spark, KEPT_WORDINGS).select(F.array_join("ws", " ").alias("text"), (F.col("family") != UNKNOWN).cast("double").alias("label"))
    kept = kept.union(background.where("held").select("text", F.lit(0.0))).dropDuplicates(["text"])
    margins = classify(kept.select("text"), found).join(kept, "text").select("margin", "label")
    fitted = LogisticRegression(regParam=0.001, maxIter=60).fit(
        VectorAssembler(inputCols=["margin"], outputCol="features").transform(cut(margins.coalesce(1)))
    )
    found.slope, found.offset = float(fitted.coefficients[0]), float(fitted.intercept)
    # Without a key no n-gram lifts a licence over unknown, so the intercepts bound the probability; else all are scored.
    bound = 1 / (1 + math.exp(-(found.slope * (max(found.intercepts[1:]) - found.intercepts[0]) + found.offset)))
    if found.slope < 0 or bound > LEAST:
        found.keys = []
    return found


def classify(paragraphs: DataFrame, by: Classifier) -> DataFrame:
    """(text, family, margin, p, shared, named) for distinct paragraphs (text).

    ``family`` is the best licence family, ``margin`` its logit over that of unknown, ``p`` the calibrated probability.
    ``shared`` is the share of all of the paragraph's n-grams of two and three words that the family's templates hold, and
    ``named`` says whether one of them is that of no other family and of no other licence's name, or one of its words such a name.
    """
    spark = paragraphs.sparkSession
    own: dict[str, set[str]] = {f: set() for f in FAMILIES}
    for r in training_templates(spark).select("family", grams(F.col("ws")).alias("g")).collect():  # this module's own
        own[r.family].update(r.g)
    among = {g: [f for f in FAMILIES if g in own[f]] for g in set().union(*own.values())}
    alone = {w: f for f, ws in OWN_NAMES.items() for w in ws}
    among |= {w: [f] for w, f in alone.items()}
    none = [0.0] * len(FAMILIES)

    def entry(g: str, fs: list[str]) -> str:
        says = g in alone or " " in g and len(fs) == 1 and fs[0] != UNKNOWN
        held = "".join("01"[f in fs] for f in FAMILIES)
        return "|".join((g, "01"[says], held, ",".join(f"{w:.4g}" for w in by.weights.get(g, none))))

    # An n-gram of unknown things alone without a weight changes nothing.
    table = [entry(g, fs) for g, fs in sorted(among.items()) if fs != [UNKNOWN] or any(by.weights.get(g, none))]
    split = spark.range(1).select(F.explode(listed(set(table))).alias("r")).select(F.split("r", r"\|").alias("x"))
    bits = F.transform(F.sequence(F.lit(1), F.lit(len(FAMILIES))), lambda i: F.substring(F.col("x")[2], i, F.lit(1)) == "1")
    weights = cut(  # so that no later plan has the text in it
        split.select(
            F.col("x")[0].alias("g"), (F.col("x")[1] == "1").alias("o"), bits.alias("f"),
            F.transform(F.split(F.col("x")[3], ","), lambda w: w.cast("double")).alias("w"),
        )
    )
    exploded = paragraphs.select("text", F.explode_outer(grams(words(F.col("text")))).alias("g"))
    met = exploded.join(F.broadcast(weights), "g", "left").withColumn("k", F.contains("g", F.lit(" ")))  # this module's own n-grams
    n = len(FAMILIES)
    sums = met.groupBy("text").agg(
        F.array([F.coalesce(F.sum(F.col("w")[i]), F.lit(0.0)) for i in range(n)]).alias("sums"),
        F.array([F.count_if(F.col("k") & F.col("f")[i]) for i in range(n)]).alias("shared"),
        F.array([F.count_if(F.col("o") & F.col("f")[i]) > 0 for i in range(n)]).alias("named"),
        F.count_if("k").alias("grams"),
    )
    start = F.array([F.lit(x) for x in by.intercepts])
    logits = sums.withColumn("z", F.zip_with("sums", start, lambda a, b: a + b))
    best = F.array_max(F.transform(F.slice("z", 2, n - 1), lambda x, i: F.struct(x.alias("z"), (i + 1).alias("i"))))
    margin = F.col("best.z") - F.col("z")[0]
    return logits.withColumn("best", best).select(
        "text",
        F.array([F.lit(f) for f in FAMILIES])[F.col("best.i")].alias("family"),
        margin.alias("margin"),
        (1 / (1 + F.exp(-(by.slope * margin + by.offset)))).alias("p"),
        F.coalesce(F.col("shared")[F.col("best.i")] / F.nullif("grams", F.lit(0)), F.lit(0.0)).alias("shared"),
        F.col("named")[F.col("best.i")].alias("named"),
    )


def license_scan(
    docs: DataFrame, by: Classifier | None = None, id_col: str = "doc_id", text_col: str = "text",
    least: float = LEAST, least_shared: float = LEAST_SHARED,
) -> DataFrame:
    """(id, n_paragraphs, licences, families): one row per input row, repeated rows and null ids included, over whole texts.

    ``n_paragraphs`` counts the lines that are not blank. ``licences`` lists the paragraphs of a licence in page order: first line
    (i), number of lines (n), text, family, probability, template overlap and whether the comparison confirms it; a line
    is left out where a confirmed run has it. ``families`` has the confirmed families, sorted. A null text counts as empty and
    has no paragraph; an empty table gives an empty result. ``by`` None trains on ``docs``. Other columns are not carried,
    whatever their names.

    Only a paragraph with a word that some licence's feature needs can leave the class unknown by the classifier, so others
    are not scored. Equal paragraphs are scored once and joined back by their text; Spark splits a
    paragraph that very many documents have.
    """
    by = by or train(docs, text_col)
    key = listed(set(by.keys))
    said = lambda x: F.trim(x) != ""
    every = F.split(text_of(text_col), "\n")
    candidates = F.filter(
        F.transform(F.col("ls"), lambda x, i: F.struct(i.alias("i"), x.alias("text"))),
        lambda x: said(x["text"]) if not by.keys else said(x["text"]) & F.arrays_overlap(F.split(F.regexp_replace(F.lower(x["text"]), "licence", "license"), r"[^\p{L}\p{N}]+"), key),
    )
    rows = cut(
        docs.select(F.col(id_col).alias("id"), every.alias("ls")).select(
            F.monotonically_increasing_id().alias("row"), "id", F.size(F.filter("ls", said)).cast("long").alias("n_paragraphs"), candidates.alias("cs")
        )
    )
    lines = rows.select("row", F.posexplode("cs").alias("at", "c")).select("row", (F.col("c.i") - F.col("at")).alias("run"), "c.i", "c.text")
    runs = lines.groupBy("row", "run").agg(F.array_sort(F.collect_list(F.struct("i", "text"))).alias("ps")).where(F.size("ps") > 1)
    runs = runs.select("row", F.col("ps")[0]["i"].alias("i"), F.size("ps").alias("n"), F.array_join(F.transform("ps", lambda p: p["text"]), "\n").alias("text"))
    paragraphs = lines.select("row", "i", F.lit(1).alias("n"), "text").union(runs)
    scored = classify(paragraphs.select("text").distinct(), by).where(F.col("p") > least)
    confirmed = (F.col("shared") >= least_shared) & F.col("named")
    hits = paragraphs.join(scored, "text").groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("i", "n", "text", "family", "p", "shared", confirmed.alias("confirmed")))).alias("licences"),
        F.array_sort(F.collect_set(F.when(confirmed, F.col("family")))).alias("families"),
    )
    within = lambda x: F.exists(
        "licences", lambda y: y["confirmed"] & (y["n"] > x["n"]) & (y["i"] <= x["i"]) & (x["i"] < y["i"] + y["n"])
    )
    found = hits.withColumn("licences", F.filter("licences", lambda x: ~within(x)))
    kind = "array<struct<i:int,n:int,text:string,family:string,p:double,shared:double,confirmed:boolean>>"
    return rows.join(found, "row", "left").select(
        F.col("id").alias(id_col),
        "n_paragraphs",
        F.coalesce("licences", F.array().cast(kind)).alias("licences"),
        F.coalesce("families", F.array().cast("array<string>")).alias("families"),
    )
