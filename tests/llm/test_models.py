"""Operators 1, 2 and 10: held-out accuracy and the awkward rows."""

import collections
import math
import random
import re
import textwrap

import numpy as np
import pytest

from mandisight.llm import lang_id, license_scan, pu_quality
from tests.conftest import SF001
from tests.llm.helpers import TEXTS, documents, empty


def test_gram_counts_against_a_plain_count():
    texts = ["ab A", "", "  x\n\ny ", "aa" * 50]
    counts = lang_id.gram_counts(texts, 1 << 12)
    for t, row in zip(texts, counts, strict=True):
        t = re.sub(r"\s+", " ", t).lower()
        marked = f"\0{t}\0"
        # All 1-grams but the end marks, and all 2- and 3-grams with them.
        assert row.sum() == len(t) + max(0, len(marked) - 1) + max(0, len(marked) - 2)
    alone = np.vstack([lang_id.gram_counts([t], 1 << 12) for t in texts])
    assert (alone == counts).all()


def plain_language(model, text):
    """(language, score) of one text, n-gram by n-gram, from the stored weights."""
    marked = "\0" + re.sub(r"\s+", " ", text).lower().replace("\0", " ") + "\0"
    counts = collections.Counter()
    for i in range(len(marked)):
        code = 0
        for n, c in enumerate(marked[i:i + lang_id.MAX_GRAM], 1):
            code = ((code * 0x01000193 & 0xFFFFFFFF) ^ ord(c)) * 0x9E3779B1 & 0xFFFFFFFF
            code ^= code >> 15
            if n > 1 or c != "\0":
                counts[code % len(model.idf)] += 1
    x = {f: math.log1p(k) * float(model.idf[f]) for f, k in counts.items()}
    norm = math.sqrt(sum(v * v for v in x.values())) or 1.0
    at = {int(f): row for f, row in zip(model.live, model.weights)}
    logits = [sum(v / norm * float(at[f][k]) for f, v in x.items() if f in at) / model.temperature
              for k in range(len(model.languages))]
    e = [math.exp(z - max(logits)) for z in logits]
    best = max(range(len(e)), key=e.__getitem__)
    return model.languages[best], e[best] / sum(e)


def test_predictions_equal_plain_python(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text", "lang")
    model = lang_id.train(docs.where(~lang_id.held_out()).select("text", "lang"), most=400)
    few = docs.where("length(text) < 400").unionByName(docs.where("doc_id < 40")).dropDuplicates(["doc_id"])
    rows = lang_id.predict(few, model).collect()
    assert len(rows) > 60
    for r in rows:
        if lang_id.has_letter(r.text):
            language, score = plain_language(model, r.text)
            assert abs(r.score - score) < 1e-4 and (r.lang_pred == language or score < 0.51)
        else:
            assert (r.lang_pred, r.score) == (lang_id.UNDETERMINED, 1.0)


def test_document_frequencies_cover_every_row(spark):
    docs = documents(spark)
    frequency, n = lang_id.document_frequencies(docs.repartition(3))
    texts = [t for t in TEXTS if lang_id.has_letter(t)]
    assert n == len(texts)
    assert (frequency == (lang_id.gram_counts(texts) > 0).sum(axis=0)).all()


def test_ftrl_l1_leaves_weights_at_zero():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 400)
    x = rng.standard_normal((400, 20)) * 0.1
    x[:, 0] = y * 2 - 1
    ftrl = lang_id.Ftrl(20, 2, l1=2.0)
    for i in range(0, 400, 10):
        ftrl.step(x[i:i + 10], np.eye(2)[y[i:i + 10]])
    w = ftrl.weights()
    assert (w[1:] == 0).mean() > 0.5 and w[0, 1] > 0 > w[0, 0]


def test_temperature_softens_wrong_certainty():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 500)
    logits = np.eye(2)[np.where(rng.random(500) < 0.7, y, 1 - y)] * 20
    assert lang_id.temperature_of(logits, y) > 5


def test_language_held_out(spark):
    rows = lang_id.op10_lang_id(spark, SF001).join(
        spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 100 and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97


def test_language_awkward_rows(spark):
    docs = documents(spark)
    model = lang_id.train(docs.select("text", "lang"))
    got = lang_id.predict(docs, model).collect()
    assert len(got) == len(TEXTS) and got[0].kept == 7
    for r in got:
        assert (r.lang_pred == "und") == (not lang_id.has_letter(TEXTS[r.doc_id]))
    none = lang_id.train(empty(spark).select("text", "lang"))
    assert {r.lang_pred for r in lang_id.predict(docs, none).collect()} == {"und"}
    assert lang_id.predict(empty(spark), model).count() == 0


def test_language_sample_of_copies_and_small_languages(spark):
    rows = [("one text of many copies", "aa")] * 200 + [("first", "bb"), ("second", "bb"), ("only", "cc")]
    rows += [(f"text {i}", "dd") for i in range(400)]
    got = [tuple(r) for r in lang_id.sample_of(spark.createDataFrame(rows, "text string, lang string"), 24).collect()]
    assert len(got) == len(set(got)) == 24
    assert sorted(r for r in got if r[1] != "dd") == sorted({r for r in rows if r[1] != "dd"})


def test_language_sample_of_huge_languages():
    sizes = {f"l{i:02}": 10 ** 10 for i in range(100)} | {"small": 1}
    parts = lang_id.quotas(sizes, lang_id.SAMPLE_DOCS)
    assert parts["small"] == 1 and sum(parts.values()) == lang_id.SAMPLE_DOCS
    share = parts["l00"] / sizes["l00"]
    assert abs((lang_id.hash_bound(share) + 2 ** 63) / 2 ** 64 / share - 1) < 1e-6
    assert lang_id.hash_bound(2.0) == 2 ** 63 - 1


def test_prior_and_risk_on_known_mixture():
    rng = np.random.default_rng(2)

    def some(n, at):
        return np.hstack([rng.standard_normal((n, 2)) + at, np.ones((n, 1))])

    p, u = some(1500, 2), np.vstack([some(1500, 2), some(500, -2)])
    rng.shuffle(u)
    order = pu_quality.fit_pu_order(p[:750], u)
    prior = pu_quality.prior_of(*(np.bincount(pu_quality.bins_of(x, order), minlength=pu_quality.BINS) for x in (p[750:], u)))
    assert 0.65 < prior < 0.85
    w = pu_quality.fit_nnpu(p, u, prior)
    assert (some(500, 2) @ w > 0).mean() > 0.95 and (some(500, -2) @ w < 0).mean() > 0.95


def test_quality_held_out(spark):
    rows = pu_quality.op2_pu_quality(spark, SF001).join(
        spark.read.parquet(f"{SF001}/labels.parquet").select("doc_id", "quality"), "doc_id").where("held_out").collect()
    for label in (0, 1):
        mine = [r for r in rows if r.quality == label]
        assert sum(r.predicted == label for r in mine) / len(mine) > 0.8


def test_quality_awkward_rows(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(TEXTS))] + [(None, 1), (5, None), (5, 1)],
                                   "doc_id long, quality int")
    model = pu_quality.train(docs, labels)
    got = pu_quality.score(docs, model).collect()
    assert len(got) == len(TEXTS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert got[0].score == got[1].score  # null and empty alike
    nothing = pu_quality.train(docs, labels.where("quality = 9"))
    assert {r.score for r in pu_quality.score(docs, nothing).collect()} == {0.0}
    assert pu_quality.score(empty(spark), model).count() == 0


def plain_features(text):
    """The features of one text, character by character."""
    data = (text or "").encode("utf-8", "surrogatepass")
    kinds = [k for k in (int(pu_quality.CLASS_OF[b]) for b in data) if k >= 0]
    pairs = collections.Counter(zip(kinds, kinds[1:]))
    total = max(1, sum(pairs.values()))
    out = [math.sqrt(pairs[a, b] / total) for a in range(pu_quality.CLASSES) for b in range(pu_quality.CLASSES)]
    words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    n, threes = len(words), list(zip(words, words[1:], words[2:]))
    return out + [math.log1p(n), len(set(words)) / n if n else 0.0, len(set(threes)) / len(threes) if threes else 0.0,
                  1 - len(set(lines)) / len(lines) if lines else 0.0, math.log1p(len(data) / n) if n else 0.0,
                  math.log1p(n / len(lines)) if lines else 0.0]


def test_quality_equals_brute_force_over_all_texts(spark):
    """Moments, first scores, prior and every score, from the stored weights, in plain Python."""
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF001}/labels.parquet")
    learn = docs.where(~pu_quality.held_out())
    texts = {r.doc_id: r.text for r in docs.collect()}
    x = np.array([plain_features(r.text) for r in learn.collect()])
    mean, scale, n = pu_quality.moments(learn)
    assert n == len(x) and np.allclose(mean, x.mean(axis=0)) and np.allclose(scale, x.std(axis=0), atol=1e-7)
    model = pu_quality.train(learn, labels.where(~pu_quality.held_out()))
    weights = np.random.default_rng(0).standard_normal(pu_quality.N_FEATURES + 1) / 10
    z = (model.inputs(x) * weights).sum(axis=1)
    want = np.bincount(np.minimum((pu_quality.BINS / (1 + np.exp(-z))).astype(int), pu_quality.BINS - 1), minlength=pu_quality.BINS)
    assert np.abs(pu_quality.first_scores(learn, model, weights) - want).sum() <= 2  # a score on the edge of two bins
    assert 0.02 <= model.prior <= 0.98
    for r in pu_quality.score(docs, model).collect():
        z = model.weights[-1] + sum(w * min(8.0, max(-8.0, (f - m) / s)) for w, f, m, s in zip(
            model.weights, plain_features(texts[r.doc_id]), model.mean, model.scale))
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-9 and r.predicted == (r.score >= 0.5)


def test_prior_is_the_smallest_ratio_of_shares():
    positive, unlabelled = np.array([0, 1, 0, 3, 6]), np.array([40, 30, 20, 6, 4])
    ratios = []
    for k in (1, 3, 4):  # cuts where a positive lies
        qp, qu = positive[k:].sum() / 10, unlabelled[k:].sum() / 100
        margin = math.sqrt(math.log(40) / 20) + math.sqrt(math.log(40) / 200)
        ratios.append(((qu + margin) / qp, qu / qp))
    assert abs(pu_quality.prior_of(positive, unlabelled) - min(ratios)[1]) < 1e-12


def test_features_of_a_text_do_not_depend_on_its_batch():
    alone = np.vstack([pu_quality.features([t]) for t in TEXTS])
    assert np.allclose(alone, pu_quality.features(TEXTS))


NOTICE = {  # text -> licence
    "Released under the MIT License.": "mit",
    "licensed under the apache license, version 2.0": "apache-2.0",
    "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0",
    "Licensed under CC BY-NC 4.0.": "cc-by-nc",
    "Licensed under CC BY-SA 4.0.": "cc-by-sa",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software": "mit",
}


@pytest.fixture(scope="module")
def licence_rows(spark):
    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("lo", "ri", "an", "te", "mu") for b in ("sa", "ke", "dor", "pil", "u")]
    words += ["the", "under", "is", "of", "this", "version", "public", "license"]

    def line():
        return " ".join(rng.choice(words) for _ in range(rng.randint(3, 12)))

    texts = ["\n".join(line() for _ in range(4)) for _ in range(60)]
    texts += [f"{line()}\n\n{notice}\n{line()}" for notice in NOTICE]
    texts += [None, "", "x", "\n\n", "the license of this version"]
    extra = [(60, texts[60], None, None, 1, "", "", 0)]
    docs = documents(spark, texts, extra)
    model = license_scan.train(docs, sample=300)
    return texts, model, docs, license_scan.scan(docs, model).collect()


def test_licences(licence_rows):
    texts, _, _, rows = licence_rows
    assert len(rows) == len(texts) + 1
    for r in rows:
        text = texts[r.doc_id]
        want = next((f for n, f in NOTICE.items() if text and n in text), "none")
        assert r.license == want, (text, r)
        if want != "none":
            assert r.paragraph == 2 and r.n_license_paragraphs == 1 and r.coverage >= license_scan.MIN_COVERAGE
            assert 0.5 <= r.probability <= 1
        assert r.n_paragraphs == len([x for x in (text or "").split("\n") if x])


def verdicts(spark, model, texts):
    rows = license_scan.scan(documents(spark, texts), model).collect()
    return [r.license for r in sorted(rows, key=lambda r: r.doc_id)]


def test_every_notice_of_every_family(spark, licence_rows):
    cases = [(family, n) for family, notices in license_scan.all_notices().items() for n in notices]
    cases += [("proprietary", "All rights reserved."), ("proprietary", "Some Body 2011. all rights reserved")]
    want = [family for family, _ in cases]
    assert verdicts(spark, licence_rows[1], [f"first words\n\n{n}\nlast words" for _, n in cases]) == want


APART = {  # labelled paragraphs that are no templates
    "// SPDX-License-Identifier: Apache-2.0": "apache-2.0", "# SPDX-License-Identifier: MIT": "mit",
    "<!-- SPDX-License-Identifier: CC-BY-SA-4.0 -->": "cc-by-sa", "SPDX-License-Identifier: GPL-2.0-only": "gpl-2.0",
    "Licensed under the GNU GPL v3.": "gpl-3.0", "Licensed under the MIT licence.": "mit",
    "The code here is licensed under the MIT License, see the file of that name.": "mit",
    "Our library is released under the BSD License and may be used freely.": "bsd",
    "This work is licensed under a Creative Commons Attribution 4.0 International License, except the figures.": "cc-by",
    "Copyright 2019 Some Body. Licensed under the Apache License, Version 2.0.": "apache-2.0",
    "Pictures: licensed under CC BY-NC 4.0, with thanks.": "cc-by-nc",
    "This file is licensed under the MPL 2.0 as are all others.": "mpl-2.0",
    "2011 Some Body, Ltd. All Rights Reserved.": "proprietary",
    "All rights reserved by the publisher.": "proprietary",
    # Hard ones: words of licences that are none.
    "We licensed the song last year, all rights reserved for the band.": "none",
    "He had all rights reserved seats taken from him.": "none",
    "The driver was licensed under the old rules of the county.": "none",
    "Permission is hereby denied to the parties named above.": "none",
    "This program is free for all who come before noon.": "none",
    "The general public was asked to stay at home.": "none",
    "Terms of the agreement were published by the foundation.": "none",
    "The identifier of this record is not a license number.": "none",
    "Under the terms of the treaty either side may leave.": "none",
    "Additional terms may apply to bookings in the summer.": "none",
}


def test_labelled_paragraphs_apart_from_the_templates(spark, licence_rows):
    got = dict(zip(APART, verdicts(spark, licence_rows[1], list(APART))))
    wrong = {t: (got[t], want) for t, want in APART.items() if got[t] != want and not (want == "none" and got[t] == "unknown")}
    assert not wrong
    for family in set(APART.values()) - {"none"}:
        named = [t for t, g in got.items() if g == family]
        assert [t for t in named if APART[t] == family] == named  # precision 1 on these
        assert len(named) == sum(w == family for w in APART.values())  # and recall 1


def test_a_reservation_does_not_outrank_a_licence(spark, licence_rows):
    texts = [f"Some Body 2011\nAll rights reserved.\n\n{n}" for n in NOTICE]
    assert verdicts(spark, licence_rows[1], texts) == list(NOTICE.values())


GPL_3 = """\
This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
BSD_3 = """\
Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
    * Redistributions of source code must retain the above copyright
      notice, this list of conditions and the following disclaimer.
    * Neither the name of the copyright holder nor the names of its
      contributors may be used to endorse or promote products derived
      from this software without specific prior written permission."""


def test_wrapped_headers(spark, licence_rows):
    cases = {GPL_3: "gpl-3.0", GPL_3.replace("GNU General", "GNU Affero General"): "agpl-3.0",
             GPL_3.replace("GNU General", "GNU Lesser General"): "lgpl", BSD_3: "bsd",
             f"Copyright 2011 Some Body\nAll rights reserved.\n\n{BSD_3}": "bsd"}
    texts = [*cases, *["\n".join(f" * {line}" for line in t.split("\n")) for t in cases],
             *[t.replace("\n", "\r\n\r\n") for t in cases]]
    assert verdicts(spark, licence_rows[1], texts) == list(cases.values()) * 3


@pytest.mark.parametrize("width", [40, 72])
def test_every_notice_wrapped(spark, licence_rows, width):
    cases = [(family, n) for family, notices in license_scan.all_notices().items() for n in notices]
    texts = ["some words of this story\n\n" + textwrap.fill(n, width) + "\nand the end" for _, n in cases]
    rows = sorted(license_scan.scan(documents(spark, texts), licence_rows[1]).collect(), key=lambda r: r.doc_id)
    for (family, n), r in zip(cases, rows, strict=True):
        assert (r.license, r.paragraph) == (family, 2), (n, r)


def test_licences_empty_and_native(spark, licence_rows):
    _, model, docs, _ = licence_rows
    assert license_scan.scan(empty(spark), model).count() == 0
    assert model.temperature > 0 and model.least >= license_scan.MIN_PROBABILITY
    plan = license_scan.scan(docs, model)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|ArrowEval", plan)


def test_grams(spark):
    row = spark.sql("SELECT 'Licensed under CC BY-NC 4.0.' AS t").select(
        license_scan.words_of(license_scan.F.col("t")).alias("w")).select(
        "w", license_scan.grams_of(license_scan.F.col("w")).alias("g")).first()
    assert row.w == ["licensed", "under", "cc", "by", "nc", "4.0"]
    assert row.g[:2] == ["licensed under", "under cc"] and row.g[-1] == "by nc 4.0" and len(row.g) == 9
