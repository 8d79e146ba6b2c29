"""Operator 1: licence scan (DataFrame functions only).

Paragraphs (lines) are classified by a multinomial logistic regression over
word 2- and 3-grams. It is trained here: examples of each family are runs of
words of its public notices, examples of the unknown class are a bounded
sample of the corpus's own paragraphs and the short runs that several
families share. An L1 share in the penalty keeps the weights sparse. A
held-out quarter sets the temperature of the probabilities and the least
probability at which a family is accepted, so that at most a stated share of
unknown paragraphs passes; a paragraph that holds a notice whole needs no
least probability. A prediction counts only if the paragraph also holds
enough of one notice (template) of that family. ``All rights reserved.``
alone is a notice, but stands beside granting licences too, so any other
confirmed notice of the document goes before it.

Notices are often wrapped. Besides the lines, runs of words that start at an
n-gram of the notices and go on over the following lines are classified, as
many words as the longest notice has; a notice's coverage counts only as many
words as it has itself. A run only confirms: it counts where its coverage is
enough, and where no line and no other run that overlaps it covers more.

Besides the long notices there are short ones made of public identifiers and
names (``SPDX-License-Identifier: MIT``). A reservation of rights that goes on
as a sentence is not taken for one.

The vocabulary is the n-grams of the notices. A paragraph without any of them
has the intercepts alone, which is the unknown class, so scoring joins the
corpus's n-grams with that small table and only what matches goes on.

Result per document: license (the family of the best confirmed line or run;
``unknown`` where some paragraph looked like a licence but no family was
confirmed; ``none``), paragraph (the number from 0 of its first line, least of
equals), probability, coverage, n_paragraphs (lines) and n_license_paragraphs
(confirmed lines and runs).

Defined results: null and empty texts have no paragraph and ``none``;
paragraphs of fewer than two words are unknown; ties go to the first family
by name and the first paragraph; repeated rows each get their row; an empty
table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mandisight.llm.common import table, written

#: Corpus paragraphs that the unknown class is trained on.
SAMPLE_PARAGRAPHS = 4000
#: Documents are sampled as if each had this many paragraphs; longer ones only make the choice wider.
PARAGRAPHS_PER_DOCUMENT = 4
MAX_ITERATIONS = 60
#: Share of held-out unknown paragraphs that may pass as a family.
FALSE_SHARE = 0.002
MIN_PROBABILITY = 0.5
#: Share of a template's n-grams that a paragraph must hold, at least.
MIN_COVERAGE = 0.5
UNKNOWN = "unknown"
#: A notice that also stands beside granting licences.
RESERVATION = "All rights reserved."

# Public licence notices by family.
NOTICES: dict[str, list[str]] = {
    "agpl-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU Affero General Public License, version 3.",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "Released under the Apache 2.0 License.",
    ],
    "bsd": [
        "Released under the BSD License.",
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
    ],
    "cc0": [
        "Licensed under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
    ],
    "gpl-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "lgpl": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "proprietary": [
        RESERVATION,
        "All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
    ],
}


# Public identifiers and short names of the families.
IDENTIFIERS = {
    "agpl-3.0": ["AGPL-3.0", "AGPL-3.0-or-later"], "apache-2.0": ["Apache-2.0"], "bsd": ["BSD-3-Clause", "BSD-2-Clause"],
    "cc-by": ["CC-BY-4.0"], "cc-by-nc": ["CC-BY-NC-4.0"], "cc-by-sa": ["CC-BY-SA-4.0"], "cc0": ["CC0-1.0"],
    "gpl-2.0": ["GPL-2.0-only", "GPL-2.0-or-later"], "gpl-3.0": ["GPL-3.0-only", "GPL-3.0-or-later"],
    "lgpl": ["LGPL-2.1-or-later", "LGPL-3.0-or-later"], "mit": ["MIT"], "mpl-2.0": ["MPL-2.0"],
}
SHORT_NAMES = {
    "agpl-3.0": ["GNU AGPL v3"], "apache-2.0": ["Apache 2.0 licence"], "bsd": ["BSD licence"],
    "gpl-2.0": ["GNU GPL v2"], "gpl-3.0": ["GNU GPL v3"], "lgpl": ["GNU LGPL v3"], "mit": ["MIT licence"],
    "mpl-2.0": ["MPL 2.0"],
}


def all_notices() -> dict[str, list[str]]:
    """The notices, and the short forms made of identifiers and names."""
    return {family: [*texts, *[f"SPDX-License-Identifier: {x}" for x in IDENTIFIERS.get(family, ())],
                     *[f"Licensed under the {x}." for x in SHORT_NAMES.get(family, ())]] for family, texts in NOTICES.items()}


#: A reservation that goes on as a sentence ("all rights reserved for the band") is no notice, unless it says by
#: whom, under what or where.
_GOES_ON = r"(?i:\b(all\s+rights)\s+reserved)(?=[ \t]+(?!(?:by|under|in|worldwide|throughout)\b)\p{Ll})"


def sentences(line: Column) -> Column:
    """The line, in which reservations that are no notices are broken up."""
    return F.regexp_replace(line, _GOES_ON, "$1 not reserved")


def words_of(paragraph: Column) -> Column:
    """Lower-case words: letters, digits and inner dots (as in 2.0)."""
    plain = F.regexp_replace(F.lower(paragraph), r"[^\p{L}\p{N}.]+|\.(?![\p{L}\p{N}])|(?<![\p{L}\p{N}])\.", " ")
    return F.array_remove(F.split(plain, " "), "")


def grams_of(words: Column) -> Column:
    """Distinct word 2- and 3-grams."""
    n = F.size(words)

    def runs(k: int) -> Column:
        ends = [F.slice(words, i + 1, F.greatest(n - (k - 1), F.lit(0))) for i in range(k)]
        return F.transform(F.arrays_zip(*[e.alias(f"w{i}") for i, e in enumerate(ends)]),
                           lambda x: F.concat_ws(" ", *[x[f"w{i}"] for i in range(k)]))

    none = F.array().cast("array<string>")
    return F.when(n >= 3, F.array_distinct(F.concat(runs(2), runs(3)))).when(n == 2, runs(2)).otherwise(none)


def literal_rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table from driver values, as a literal."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>"))).select("col.*")


class Templates:
    """The notices as word lists and n-gram sets. A fixed, small set of texts: one job reads their words, the rest
    is made on the driver."""

    def __init__(self, spark: SparkSession, notices: dict[str, list[str]]):
        texts = [{"template": t, "family": f, "text": x} for t, (f, x) in enumerate(
            (f, x) for f in sorted(notices) for x in notices[f])]
        rows = literal_rows(spark, texts, "template:int,family:string,text:string").select(
            "template", "family", words_of(F.col("text")).alias("words")).collect()
        self.families = sorted(notices)
        self.words = {r["template"]: (r["family"], r["words"]) for r in rows}
        self.grams = {t: self.grams_of(w) for t, (_, w) in self.words.items()}
        self.vocabulary = sorted({g for gs in self.grams.values() for g in gs})

    @staticmethod
    def grams_of(words: list[str]) -> list[str]:
        """As ``grams_of`` of a column, for one list of words."""
        return list(dict.fromkeys(" ".join(words[i:i + k]) for k in (2, 3) for i in range(len(words) - k + 1)))

    def examples(self) -> list[dict]:
        """Runs of words that start anywhere and are at least four words long. What several families share is no
        evidence for either: it belongs to the unknown class."""
        seen: dict[tuple[str, ...], tuple[set[str], bool]] = {}
        for family, words in self.words.values():
            for start in range(max(1, len(words) - 3)):
                for k in (4, 6, 8, 12, 16, 24, 64):
                    part = tuple(words[start:start + k])
                    families, whole = seen.get(part, (set(), False))
                    seen[part] = families | {family}, whole or len(part) == len(words)
        return [{"label": f.pop() if len(f) == 1 else UNKNOWN, "grams": self.grams_of(list(part)), "whole": whole}
                for part, (f, whole) in sorted((p, (set(f), w)) for p, (f, w) in seen.items())]


def known_grams(docs: DataFrame, lookup: DataFrame, first_words: list[str]) -> DataFrame:
    """doc_id, row (hash of the row's text), paragraph, at (the place of the first word in the text), last (the line
    of the last word), end (the place after it), gram: the n-grams of every whole text that the notices hold.

    Every place of a text gives a row of its word and the next two. Only places whose first word starts an n-gram of
    the notices make n-grams, and only n-grams of the notices go on.
    """
    lines = docs.select("doc_id", F.xxhash64("text").alias("row"),
                        F.transform(F.split(sentences(F.col("text")), "\n"), words_of).alias("lines"))
    flat = lines.select("doc_id", "row", F.flatten("lines").alias("words"), F.flatten(F.transform(
        "lines", lambda ws, i: F.array_repeat(i, F.size(ws)))).alias("line"))
    n = F.size("words")
    places = flat.where(n >= 2).select("doc_id", "row", F.posexplode(F.arrays_zip(
        F.col("words").alias("a"), F.slice("words", 2, n).alias("b"), F.slice("words", 3, n).alias("c"),
        F.col("line").alias("la"), F.slice("line", 2, n).alias("lb"), F.slice("line", 3, n).alias("lc"))))
    places = places.select("doc_id", "row", F.col("pos").alias("at"), "col.*").where(
        F.col("a").isin(first_words) & F.col("b").isNotNull())
    grams = places.select("doc_id", "row", F.col("la").alias("paragraph"), "at", F.explode(F.array(
        F.struct(F.concat_ws(" ", "a", "b").alias("gram"), F.col("lb").alias("last"), (F.col("at") + 2).alias("end")),
        F.when(F.col("c").isNotNull(), F.struct(F.concat_ws(" ", "a", "b", "c").alias("gram"),
                                                F.col("lc").alias("last"), (F.col("at") + 3).alias("end"))))).alias("g"))
    grams = grams.select("doc_id", "row", "paragraph", "at", "g.*")
    return grams.join(F.broadcast(lookup.select("gram")), "gram", "left_semi")


#: What tells lines and runs apart: first line, first place, last place (of lines), whether it is one line.
UNIT = ["doc_id", "row", "paragraph", "at", "until", "alone"]


def units(hits: DataFrame, words: int, least: int) -> DataFrame:
    """(UNIT, gram, off): the distinct n-grams of every line, and of ``words`` words from every place of ``hits`` where
    these go over a line's end and hold ``least`` n-grams. ``off`` is the number of words of a run up to the n-gram's
    end, 0 in lines."""
    lines = (hits.where(F.col("last") == F.col("paragraph")).groupBy("doc_id", "row", "paragraph")
             .agg(F.min("at").alias("at"), F.max("at").alias("until"), F.collect_set("gram").alias("grams"))
             .select("doc_id", "row", "paragraph", "at", "until", F.lit(True).alias("alone"),
                     F.explode("grams").alias("gram"), F.lit(0).alias("off")))
    starts = hits.groupBy("doc_id", "row", "paragraph", "at").agg(
        F.collect_set(F.struct("gram", "last", "end")).alias("here"))
    ahead = Window.partitionBy("doc_id", "row").orderBy("at").rangeBetween(0, words - 2)
    near = F.filter("near", lambda x: x["end"] <= F.col("at") + words)
    runs = (starts.withColumn("near", F.flatten(F.collect_list("here").over(ahead))).withColumn("near", near)
            .where((F.size("near") >= least) & F.exists("near", lambda x: x["last"] > F.col("paragraph")))
            .select("doc_id", "row", "paragraph", "at", F.explode("near").alias("g"))
            .groupBy("doc_id", "row", "paragraph", "at", F.col("g.gram").alias("gram"))
            .agg((F.min("g.end") - F.col("at")).alias("off")))
    return lines.unionByName(runs.select("doc_id", "row", "paragraph", "at", F.col("at").alias("until"),
                                         F.lit(False).alias("alone"), "gram", "off"))


def without_overlaps(confirmed: DataFrame, words: int) -> DataFrame:
    """The ``confirmed`` units that no better unit overlaps. Lines do not stand back for lines."""
    rank = F.struct("b.terms", "b.coverage", "alone", (-F.col("at")).alias("first"))
    near = Window.partitionBy("doc_id", "row").orderBy("at").rangeBetween(-words, words)
    others = confirmed.withColumn("rank", rank).withColumn(
        "near", F.collect_list(F.struct("at", "until", "alone", "rank")).over(near))
    beaten = F.exists("near", lambda x: (x["rank"] > F.col("rank")) & ~(x["alone"] & F.col("alone"))
                      & (x["at"] <= F.col("until")) & (x["until"] >= F.col("at")))
    return others.where(~beaten).drop("rank", "near")


def examples(docs: DataFrame, known: Templates, sample: int) -> DataFrame:
    """Training rows (label, grams, weight, held)."""
    spark = docs.sparkSession
    # The unknown class: paragraphs of a bounded number of documents, in an order given by hashes. Those that share
    # three or more n-grams with the notices are left out, since they may be licences.
    n_docs = docs.count()
    spot = F.pmod(F.xxhash64("doc_id", F.lit(21)), F.lit(1 << 30))
    near = docs.where(spot < int(min(1.0, sample / PARAGRAPHS_PER_DOCUMENT / max(1, n_docs)) * (1 << 30)))
    lines = near.select("doc_id", F.posexplode(F.split(F.col("text"), "\n")).alias("paragraph", "line"))
    some = (lines.orderBy(F.xxhash64("doc_id", "paragraph", "line"), "line").limit(sample)
            .select(words_of(sentences(F.col("line"))).alias("words")).select(grams_of(F.col("words")).alias("grams")))
    shared = F.size(F.array_intersect("grams", F.array(*[F.lit(g) for g in known.vocabulary])))
    background = some.where(shared < 3).select(F.lit(UNKNOWN).alias("label"), "grams", F.lit(False).alias("whole"))
    # Known examples are few: each stands for several rows of the corpus sample.
    notices = literal_rows(spark, known.examples(), "label:string,grams:array<string>,whole:boolean")
    rows = notices.withColumn("weight", F.lit(5.0)).unionByName(background.withColumn("weight", F.lit(1.0)))
    # Whole notices are always trained on.
    held = (F.pmod(F.xxhash64("grams"), F.lit(4)) == 0) & ~F.col("whole")
    return rows.withColumn("held", held).drop("whole")


class Model:
    """Sparse weights of the families, and the calibration."""

    def __init__(self, classes: list[str], known: Templates, weights: list[list[float]], intercepts: list[float],
                 temperature: float, least: float):
        self.classes, self.known, self.weights = classes, known, weights
        self.intercepts, self.temperature, self.least = intercepts, temperature, least


def train(docs: DataFrame, notices: dict[str, list[str]] | None = None, sample: int = SAMPLE_PARAGRAPHS,
          false_share: float = FALSE_SHARE) -> Model:
    """A model of ``notices`` by family (``all_notices`` where none are given)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizerModel

    known = Templates(docs.sparkSession, notices or all_notices())
    # A few thousand rows, whatever the corpus holds: one partition, so that an iteration is one task.
    rows = written(examples(docs.select("doc_id", "text"), known, sample).coalesce(1), "license-examples").coalesce(1)
    classes = [UNKNOWN, *known.families]
    number = F.create_map(*[F.lit(x) for i, c in enumerate(classes) for x in (c, float(i))])
    vectors = CountVectorizerModel.from_vocabulary(known.vocabulary, "grams", "features")
    vectors.setBinary(True)
    ready = vectors.transform(rows.withColumn("label", number[F.col("label")]))
    learner = LogisticRegression(family="multinomial", elasticNetParam=0.5, regParam=2e-4, maxIter=MAX_ITERATIONS,
                                 standardization=False, weightCol="weight")
    fitted = learner.fit(ready.where(~F.col("held")))
    # One row per class and one column per n-gram of the vocabulary, both bounded by the notices.
    matrix = fitted.coefficientMatrix.toArray().T
    model = Model(classes, known, [[float(x) for x in r] for r in matrix],
                  [float(x) for x in fitted.interceptVector], 1.0, MIN_PROBABILITY)
    return calibrated(model, rows.where("held"), false_share)


def probabilities(temperature: float | Column) -> Column:
    """Class probabilities from the array column ``scores``."""
    top = F.array_max("scores")
    powers = F.transform("scores", lambda x: F.exp((x - top) / temperature))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.transform(powers, lambda x: x / total)


def calibrated(model: Model, held: DataFrame, false_share: float) -> Model:
    """The temperature of least log loss on the held-out rows, and the least probability of a family."""
    spark = held.sparkSession
    rows = held.select(F.xxhash64("label", "grams").alias("id"), "label", "weight", "grams").dropDuplicates(["id"])
    scored = with_scores(rows.select("id", "label", "weight", F.explode_outer("grams").alias("gram")),
                         ["id", "label", "weight"], model, weight_rows(spark, model))
    places = F.create_map(*[F.lit(x) for i, c in enumerate(model.classes) for x in (c, i)])
    scored = written(scored.withColumn("_true", places[F.col("label")]), "license-held")
    grid = [0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0]
    each = scored.select("weight", "_true", "scores", F.explode(F.array(*map(F.lit, grid))).alias("t"))
    losses = (each.select("t", "weight", F.get(probabilities(F.col("t")), F.col("_true")).alias("p"))
              .groupBy("t").agg(F.sum(-F.col("weight") * F.log(F.greatest("p", F.lit(1e-12)))).alias("loss"))
              .orderBy("loss", "t").limit(1).collect())  # one row per temperature of the grid
    if losses:
        model.temperature = losses[0]["t"]
    best = F.array_max(F.slice(probabilities(model.temperature), 2, len(model.classes)))
    edge = scored.where(F.col("_true") == 0).select(best.alias("p")).select(
        F.percentile_approx("p", 1 - false_share, 10_000)).first()[0]
    model.least = max(MIN_PROBABILITY, min(0.99, edge or 0.0))
    return model


def with_scores(grams: DataFrame, keys: list[str], model: Model, lookup: DataFrame,
                extra: list[Column] | None = None) -> DataFrame:
    """Class ``scores`` per ``keys`` from exploded rows (keys, gram); rows without a known n-gram keep the intercepts.

    ``lookup`` has one row per n-gram of the notices, a bounded size.
    """
    sums = [F.sum(F.col("w")[i]).alias(f"s{i}") for i in range(len(model.classes))]
    added = grams.join(F.broadcast(lookup), "gram", "left").groupBy(*keys).agg(*sums, *(extra or []))
    scores = F.array(*[F.coalesce(F.col(f"s{i}"), F.lit(0.0)) + F.lit(b) for i, b in enumerate(model.intercepts)])
    return added.withColumn("scores", scores).drop(*[f"s{i}" for i in range(len(model.classes))])


def weight_rows(spark: SparkSession, model: Model) -> DataFrame:
    """gram, its weights ``w`` by class, and the templates it is ``in``."""
    places: dict[str, list[int]] = {}
    for t, grams in model.known.grams.items():
        for g in grams:
            places.setdefault(g, []).append(t)
    return literal_rows(spark, [{"gram": g, "w": w, "in": places[g]} for g, w in zip(
        model.known.vocabulary, model.weights, strict=True)], "gram:string,w:array<double>,in:array<int>")


def scan(docs: DataFrame, model: Model, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    sizes = {t: (family, len(model.known.grams[t]), len(words)) for t, (family, words) in model.known.words.items()}
    longest = max((words for _, _, words in sizes.values()), default=2)
    least = min((math.ceil(min_coverage * n) for _, n, _ in sizes.values()), default=1)
    lookup = weight_rows(spark, model)
    # Written, since lines and runs are made of it. The same row twice counts its paragraphs once.
    hits = written(known_grams(docs, lookup, sorted({g.split(" ")[0] for g in model.known.vocabulary})), "license-hits")
    plain = {t for t, (_, words) in model.known.words.items() if " ".join(words) != RESERVATION.lower().rstrip(".")}
    held = [F.sum((F.array_contains("in", i) & (F.col("off") <= words)).cast("int")).alias(f"t{i}")
            for i, (_, _, words) in sizes.items()]
    # Written twice on the way: the few rows left are cheap, the expressions over them would repeat in one plan.
    scored = written(with_scores(units(hits, longest, least), UNIT, model, lookup, held), "license-scores")

    def covers(templates: set[int]) -> Column:
        """By class: the greatest coverage, and the words of that template (the fewest of equals)."""
        return F.array(*[F.array_max(F.array(*[F.struct(F.lit(c).alias("c") if k is None else (F.col(f"t{k}") / c).alias(
            "c"), F.lit(-w).alias("w")) for k, c, w in [(None, 0.0, 0)] + [
                (k, n, w) for k, (f, n, w) in sizes.items() if f == family and k in templates]]))
            for family in model.classes])

    ranked = F.transform(F.slice(F.arrays_zip(probabilities(model.temperature).alias("p"), F.col("covers"),
                                              F.col("terms")), 2, len(model.classes)),
                         # Structs compare by their first differing field: probability, then the earlier family.
                         lambda x, i: F.struct(x["p"].alias("p"), (-i).alias("i"), x["covers"]["c"].alias("coverage"),
                                               (x["terms"]["c"] >= min_coverage).alias("terms"),
                                               (-x["covers"]["w"]).alias("words"),
                                               F.get(F.array(*map(F.lit, model.classes[1:])), i).alias("family")))
    likely = written(scored.withColumn("covers", covers(set(sizes))).withColumn("terms", covers(plain)).select(
        *UNIT, F.array_max(ranked).alias("b")), "license-families").where(
        (F.col("b.p") >= model.least) | (F.col("b.coverage") >= 1.0))
    likely = likely.withColumn("ok", F.col("b.coverage") >= min_coverage).withColumn(
        "until", F.when(F.col("alone"), F.col("until")).otherwise(F.col("at") + F.col("b.words") - 1))
    judged = without_overlaps(likely.where("ok"), longest).unionByName(likely.where(~F.col("ok") & F.col("alone")))
    best = F.struct(F.col("ok"), F.col("b.terms"), F.col("b.coverage"), F.col("alone"), F.col("b.p"),
                    (-F.col("paragraph")).alias("at"), F.col("b.family"))
    verdict = judged.groupBy("doc_id", "row").agg(
        F.max(best).alias("best"), F.sum(F.col("ok").cast("long")).alias("n"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("row"), F.coalesce(F.size(F.filter(
        F.split(F.col("text"), "\n"), lambda x: x != "")), F.lit(0)).cast("long").alias("n_paragraphs"))
    v = verdict.select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), "best", "n")
    out = rows.join(v, rows["doc_id"].eqNullSafe(v["_id"]) & (rows["row"] == v["_row"]), "left")
    return out.select(
        "doc_id", F.when(F.col("best").isNull(), "none").when(F.col("best.ok"), F.col("best.family")).otherwise(
            UNKNOWN).alias("license"),
        (-F.col("best.at")).alias("paragraph"), F.col("best.p").alias("probability"),
        F.col("best.coverage").alias("coverage"), F.greatest("n_paragraphs", F.lit(0)).alias("n_paragraphs"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_license_paragraphs"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return scan(docs, train(docs))
