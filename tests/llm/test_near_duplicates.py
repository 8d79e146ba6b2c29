"""Operators 3 and 5 against brute force."""

import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mandisight.llm import blocks, common, embed_dedup, ngram_join
from mandisight.llm.common import written
from mandisight.llm.components import connected_components, local_components
from tests.llm.helpers import TEXTS, documents, empty, passage


def shingles(text, k=5):
    w = [x for x in re.split("[ \t\n\x0b\x0c\r]+", text or "") if x]
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(texts, threshold=0.8):
    sets = [shingles(t) for t in texts]
    n, label = Counter(), list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= threshold * len(sets[i] | sets[j]) - 1e-9:
                n[i] += 1
                n[j] += 1
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return {i: (n[i], root(i)) for i in range(len(texts))}


def near_copies():
    rng = random.Random(1)
    texts = list(TEXTS)
    for s in range(6):
        base = passage(rng.randint(30, 200), s)
        for _ in range(rng.randint(2, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = f"edit{rng.random()}"
            texts.append(" ".join(copy))
        texts += [" ".join(base), "\n ".join(base), " ".join(base)]
    shared = " ".join(passage(60, 99))
    texts += [shared + " " + " ".join(passage(150, 200 + i)) for i in range(12)]  # a common passage is no copy
    texts += ["one two three", "one two three", "one  two\nthree", "one two", "a b c d e", "a b c d e f"]
    hot = passage(120, 500)
    texts += [" ".join([*hot[:i], f"new{i}", *hot[i + 1:]]) for i in range(90)]  # one large group of near copies
    return texts


def test_jaccard_join_equals_brute_force(spark):
    texts = near_copies()
    rows = ngram_join.jaccard_join(documents(spark, texts).repartition(4), block=16).collect()
    assert {r.doc_id: (r.n_links, r.class_id) for r in rows} == brute(texts) and len(rows) == len(texts)
    assert all(r.kept == (r.doc_id == r.class_id) for r in rows)


def test_jaccard_join_repeats_null_ids_and_empty(spark):
    text = " ".join(passage(50))
    docs = documents(spark, [text, text + " x", "other words entirely here now"], [
        (None, text, None, None, 1, "", "", 0), (0, text, None, None, 1, "", "", 0)])
    got = sorted(((r.doc_id, r.n_links, r.class_id, r.kept) for r in ngram_join.jaccard_join(docs).collect()),
                 key=str)
    assert got == sorted([(0, 2, 0, True), (0, 2, 0, True), (1, 2, 0, False), (2, 0, 2, True), (None, 0, None, True)],
                         key=str)
    assert ngram_join.jaccard_join(empty(spark)).count() == 0


def test_banding_reaches_its_recall():
    bands, rows = ngram_join.banding(0.8, 0.9995, 256)
    assert bands * rows <= 256 and 1 - (1 - 0.8 ** rows) ** bands >= 0.9995
    with pytest.raises(ValueError):
        ngram_join.banding(0.01, 0.99999, 8)


def test_signature_of_a_long_set_equals_that_of_its_parts():
    x = np.random.default_rng(0).integers(0, 2**63, 70_000).astype(np.uint64)
    low = (x >> np.uint64(32)).astype(np.uint32)
    whole = ngram_join.band_hashes(x, 2, 2)
    signature = [min(int((np.uint32(m) * low[:40_000]).min()), int((np.uint32(m) * low[40_000:]).min()))
                 for m in ngram_join.MULTIPLIERS[:4]]
    value = np.arange(1, 3, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for column in np.array(signature, np.uint64).reshape(2, 2).T:
        value = (value ^ column) * np.uint64(0xFF51AFD7ED558CCD)
        value ^= value >> np.uint64(33)
    assert (whole == value.view(np.int64)).all()


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(i, i + 1) for i in range(300, 360)] + [
        (400, 400), (500, 501), (500, 501)]
    label = local_components(502, np.array([a for a, _ in edges]), np.array([b for _, b in edges]))
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {n: int(label[n]) for n in nodes}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_units_hold_every_pair_once(spark):
    members = written(spark.range(50).selectExpr("id AS rep", "id % 2 AS g", "1L AS copies"), "m")
    sizes = members.groupBy("g").count().withColumnRenamed("count", "_n")
    units, n = blocks.in_block_pairs(members, ["g"], 6, sizes)
    units = units.toPandas()
    assert len(units) == n
    seen = Counter()
    for (g, i, j), u in units.groupby(["g", "_i", "_j"]):
        assert len(u) <= 24
        left, right = u[u._b == i].rep.tolist(), u[u._b == j].rep.tolist()
        for a in left:
            for b in right:
                if i != j or a < b:
                    seen[min(a, b), max(a, b)] += 1
    assert seen == Counter((a, b) for a in range(50) for b in range(a + 1, 50) if a % 2 == b % 2)


VECTORS = "vec_id long, embedding array<float>, label int, kept string, _b string"


def vector_rows():
    rng = np.random.default_rng(5)
    rows = []
    for label in (0, 1, None):
        for c in range(6):
            centre = rng.standard_normal(24)
            for spread in (0.02, 0.05, 0.2, 0.3, 0.36, 0.42):
                v = centre + spread * np.linalg.norm(centre) / np.sqrt(24) * rng.standard_normal(24)
                rows.append((len(rows), v.astype(np.float32).tolist(), label))
        rows += [(len(rows) + k, rows[-1][1], label) for k in range(3)]
        for k in range(40):  # a large group around one vector
            v = centre + 0.1 * rng.standard_normal(24)
            rows.append((len(rows), v.astype(np.float32).tolist(), label))
    tail = [None, [], [0.0] * 24, [float("nan")] + [1.0] * 23, [float("inf")] * 24, [None] + [1.0] * 23, [1.0] * 3,
            [2.0] * 3, [1e-30] * 24, [3e37] * 24]
    rows += [(len(rows) + k, v, 0) for k, v in enumerate(tail)]
    return [(*r, "mine", "mine") for r in rows]


def brute_vectors(rows, threshold=0.93):
    ok = [r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    n, a, b = Counter(), [], []
    for i, x in enumerate(rows):
        for j, y in enumerate(rows[:i]):
            if ok[i] and ok[j] and x[2] == y[2] and len(x[1]) == len(y[1]):
                p, q = (np.array(np.float32(v), float) for v in (x[1], y[1]))
                if p @ q / np.sqrt(p @ p) / np.sqrt(q @ q) >= threshold:
                    n[i] += 1
                    n[j] += 1
                    a.append(i)
                    b.append(j)
    label = local_components(len(rows), np.array(a), np.array(b))
    return {r[0]: (n[i], rows[label[i]][0]) for i, r in enumerate(rows)}


def test_embeddings_equal_brute_force(spark):
    rows = vector_rows()
    got = embed_dedup.near_duplicates(spark.createDataFrame(rows, VECTORS).repartition(3), block=16).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute_vectors(rows) and len(got) == len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_embeddings_repeats_null_ids_and_empty(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 0, "", ""), (1, v, 0, "", ""), (None, v, 0, "", ""), (2, v, 1, "", "")]
    got = sorted((str((r.vec_id, r.n_links, r.component_id, r.kept))
                  for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()))
    assert got == ["(1, 1, 1, True)", "(1, 1, 1, True)", "(2, 0, 2, True)", "(None, 0, None, True)"]
    assert embed_dedup.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def test_estimates_are_unbiased_and_bounds_hold():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x + 0.045 * rng.standard_normal((400, 64))
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    codes, factors = embed_dedup.codes_of(x)
    estimate = embed_dedup.estimates(codes, factors, y @ embed_dedup.rotation(64))
    truth = x @ y.T
    assert abs((estimate - truth).mean()) < 0.002
    least = embed_dedup.least_estimate(factors, 64, 0.93, embed_dedup.CONFIDENCE)
    reached = truth >= 0.93
    assert reached.sum() > 100 and (estimate >= least[:, None])[reached].all()
    assert (estimate >= least[:, None]).mean() < 0.05  # most pairs need no exact recomputation


def test_different_texts_of_one_id(spark):
    one, two, near_two = (" ".join(w) for w in (passage(60, 1), passage(60, 2), [*passage(60, 2), "more"]))
    docs = spark.createDataFrame([(5, one), (5, two), (3, near_two), (7, one), (9, f"{one} more")],
                                 "doc_id long, text string")
    got = sorted((r.doc_id, r.n_links, r.class_id, r.kept) for r in ngram_join.jaccard_join(docs).collect())
    assert got == [(3, 1, 3, True), (5, 1, 3, False), (5, 2, 5, True), (7, 2, 5, False), (9, 2, 5, False)]
    kept = corpus_pipeline.keep_one_copy(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(3, near_two), (5, one)]
    apart = corpus_pipeline.keep_one_copy(spark, docs.where("doc_id = 5"), "")
    assert sorted(r.text for r in apart.collect()) == sorted([one, two])


def test_pairs_of_blocks_carry_no_vectors_and_stored_vectors_go(spark, monkeypatch):
    seen, linked, shared = [], embed_dedup.linked, common.shared_dir(spark).removeprefix("file://")
    monkeypatch.setattr(embed_dedup, "linked", lambda pairs, *rest: seen.append(pairs) or linked(pairs, *rest))
    before = set(os.listdir(shared))
    rows = vector_rows()
    got = embed_dedup.near_duplicates(spark.createDataFrame(rows, VECTORS), block=8)
    assert seen and not any("binary" in kind or "array" in kind for _, kind in seen[0].dtypes)
    left = {x.rsplit("-", 5)[0] for x in set(os.listdir(shared)) - before}
    assert not {x.split("-")[0] for x in left} & {"codes", "vectors", "blocks", "placed"}
    assert {r.vec_id: (r.n_links, r.component_id) for r in got.collect()} == brute_vectors(rows)


@pytest.mark.parametrize("kind", ["array<double>", "array<int>"])
def test_embeddings_of_other_types(spark, kind):
    rows = [(0, [3, 4, 0], 1), (1, [3, 4, 0], 1), (2, [30, 41, 0], 1), (3, [0, 0, 2], 1), (4, [3, 4, 0], 2)]
    got = embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<long>, label int").withColumn(
        "embedding", F.col("embedding").cast(kind))).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {0: (2, 0), 1: (2, 0), 2: (2, 0), 3: (0, 3), 4: (0, 4)}


def test_zeros_of_both_signs_are_one_vector(spark):
    rows = [(0, [0.0, 1.0], 1), (1, [-0.0, 1.0], 1), (2, [1.0, 0.0], 1)]
    got = embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {0: (1, 0), 1: (1, 0), 2: (0, 2)}
