"""Operator 2: quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text train a linear scorer by the
non-negative unbiased risk: prior * R+(positives) + max(0, R-(unlabelled) -
prior * R-(positives)), logistic loss; where the bracket turns negative, the
step climbs it back instead. The class prior is estimated from the data: a
first positive-against-unlabelled scorer orders the texts, and the prior is
the smallest ratio of unlabelled to positive share above a score (with a
confidence margin on both shares).

Features come from the whole text, whatever its language: frequencies of
neighbouring character classes, and shares of repeated lines and words.
Their means and scales, and the unlabelled shares of the prior (a histogram of
first scores), are taken over every document that may be learned from; only
the weights are fitted on samples of stated size. Every document is scored.

Defined results: null and empty texts have features of zero and the score
that the model gives them; with no positive or no unlabelled text to learn
from every score is 0; rows are scored one by one, so repeated rows are
equal; an empty table gives no rows; extra columns are carried on by ``score``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mandisight.llm.common import fold, given_back, table, text_chunks

#: At most so many positives, and so many unlabelled texts, are collected (as features) to fit weights on.
SAMPLE_POSITIVE = 5000
SAMPLE_UNLABELLED = 5000
ROUNDS, RATE, DECAY = 500, 0.05, 1e-4
#: Bins of the first scores, between 0 and 1.
BINS = 4096

# Character classes by byte of the UTF-8 form; bytes that continue a character have none.
LOWER, UPPER, DIGIT, SPACE, LINE, STOP, COMMA, MARK, QUOTE, SIGN, BAR, DASH, OTHER, CONTROL = range(14)
CLASSES = 14


def _class_table() -> np.ndarray:
    t = np.full(256, CONTROL, np.int64)
    for chars, k in (("abcdefghijklmnopqrstuvwxyz", LOWER), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", UPPER),
                     ("0123456789", DIGIT), (" \t", SPACE), ("\n\r", LINE), (".", STOP), (",;:", COMMA),
                     ("!?", MARK), ("'\"`", QUOTE), ("#$%&*+=@^~\\", SIGN), ("|<>[]{}()/", BAR), ("-_", DASH)):
        for c in chars:
            t[ord(c)] = k
    t[192:] = OTHER
    t[128:192] = -1
    return t


CLASS_OF = _class_table()
N_FEATURES = CLASSES * CLASSES + 6


def features(texts: list) -> np.ndarray:
    """One row of features per text, computed from all of it."""
    raw = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]
    kinds = CLASS_OF[np.frombuffer(b"".join(raw), np.uint8)]
    owner = np.repeat(np.arange(len(raw)), np.fromiter(map(len, raw), np.int64, len(raw)))
    kinds, owner = kinds[kinds >= 0], owner[kinds >= 0]
    same = owner[1:] == owner[:-1]
    slot = owner[:-1][same] * CLASSES ** 2 + kinds[:-1][same] * CLASSES + kinds[1:][same]
    pairs = np.bincount(slot, minlength=len(raw) * CLASSES ** 2).reshape(len(raw), -1).astype(np.float64)
    out = np.zeros((len(raw), N_FEATURES))
    out[:, :CLASSES ** 2] = np.sqrt(pairs / np.maximum(1, pairs.sum(axis=1, keepdims=True)))
    for row, data in zip(out, raw, strict=True):
        words = data.split()
        lines = [x for x in data.split(b"\n") if x.strip()]
        n = len(words)
        row[CLASSES ** 2:] = (
            np.log1p(n), len(set(words)) / n if n else 0.0,
            len(set(zip(words, words[1:], words[2:], strict=False))) / (n - 2) if n > 2 else 0.0,
            1 - len(set(lines)) / len(lines) if lines else 0.0,
            np.log1p(len(data) / n) if n else 0.0, np.log1p(n / len(lines)) if lines else 0.0)
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _loss(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, -z)


class Adam:
    def __init__(self, n: int, rate: float):
        self.w, self.m, self.v, self.t, self.rate = np.zeros(n), np.zeros(n), np.zeros(n), 0, rate

    def step(self, g: np.ndarray) -> None:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * g
        self.v = 0.999 * self.v + 0.001 * g * g
        self.w -= self.rate * (self.m / (1 - 0.9 ** self.t)) / (np.sqrt(self.v / (1 - 0.999 ** self.t)) + 1e-8)


def fit_nnpu(p: np.ndarray, u: np.ndarray, prior: float, rounds: int = ROUNDS) -> np.ndarray:
    """Weights (the last is the intercept) of least non-negative risk."""
    best = Adam(p.shape[1], RATE)
    for _ in range(rounds):
        zp, zu = p @ best.w, u @ best.w
        # Gradients of the mean losses: label +1 on positives, label -1 on both.
        plus = p.T @ -sigmoid(-zp) / len(p)
        minus_p, minus_u = p.T @ sigmoid(zp) / len(p), u.T @ sigmoid(zu) / len(u)
        bracket = _loss(-zu).mean() - prior * _loss(-zp).mean()
        g = prior * plus + (minus_u - prior * minus_p) if bracket >= 0 else prior * minus_p - minus_u
        decay = DECAY * best.w
        decay[-1] = 0
        best.step(g + decay)
    return best.w


def fit_pu_order(p: np.ndarray, u: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Positives against unlabelled, plain logistic: only its order is used."""
    x, y = np.vstack([p, u]), np.r_[np.ones(len(p)), np.zeros(len(u))]
    share = np.r_[np.full(len(p), 0.5 / len(p)), np.full(len(u), 0.5 / len(u))]
    best = Adam(x.shape[1], RATE)
    for _ in range(rounds):
        best.step(x.T @ (share * (sigmoid(x @ best.w) - y)) + 1e-3 * best.w)
    return best.w


def bins_of(inputs: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The bins of first scores."""
    return np.minimum((sigmoid((inputs * weights).sum(axis=1)) * BINS).astype(np.int64), BINS - 1)


def prior_of(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """Share of positives among the unlabelled texts, from how many of both have a first score in each bin."""
    n_p, n_u = positive.sum(), unlabelled.sum()
    qp, qu = (np.cumsum(x[::-1])[::-1] / n for x, n in ((positive, n_p), (unlabelled, n_u)))
    margin = np.sqrt(np.log(4 / delta) / 2 / n_p) + np.sqrt(np.log(4 / delta) / 2 / n_u)
    cuts = np.flatnonzero(positive)
    at = cuts[np.argmin((qu[cuts] + margin) / qp[cuts])]
    return float(np.clip(qu[at] / qp[at], 0.02, 0.98))


class Model:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray | None, prior: float):
        self.mean, self.scale, self.weights, self.prior = mean, scale, weights, prior

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([np.clip((x - self.mean) / self.scale, -8, 8), np.ones((len(x), 1))])

    def score(self, texts: list) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(texts))
        out = np.zeros(len(texts))
        for a, b in text_chunks(texts, 1_000_000):
            # Row sums, not a matrix product: a row scores the same in any batch.
            out[a:b] = sigmoid((self.inputs(features(texts[a:b])) * self.weights).sum(axis=1))
        return out


def sample_ids(ids: DataFrame, most: int, salt: int) -> DataFrame:
    """At most ``most`` ids (column doc_id), by hash; about 1.2 times as many reach the last cut."""
    total = ids.count()
    spot = F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1 << 30))
    near = ids.where(spot < int(min(1.0, 1.2 * most / max(1, total)) * (1 << 30)))
    return near.orderBy(F.xxhash64("doc_id", F.lit(salt)), "doc_id").limit(most)


def feature_rows(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in text_chunks(texts, 1_000_000):
                yield pd.DataFrame({"positive": batch["positive"].iloc[a:b].array,
                                    "x": [r.astype(np.float32) for r in features(texts[a:b])]})

    return docs.select("positive", "text").mapInPandas(run, "positive boolean, x array<float>")


def moments(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean and standard deviation of every feature over all rows of ``docs`` (text), and the number of rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((3, N_FEATURES))
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in text_chunks(texts):
                x = features(texts[a:b])
                total += [x.sum(axis=0), (x * x).sum(axis=0), np.full(N_FEATURES, b - a)]
        yield pd.DataFrame({"feature": np.arange(N_FEATURES), "s": total[0], "ss": total[1], "n": total[2]})

    rows = (docs.select("text").mapInPandas(lambda b: given_back(run(b)), "feature int, s double, ss double, n double")
            .groupBy("feature").agg(F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum("n").alias("n"))
            .orderBy("feature").toPandas())  # one row per feature
    n = float(rows["n"].max()) if len(rows) else 0.0
    if not n:
        return np.zeros(N_FEATURES), np.zeros(N_FEATURES), 0
    mean = rows["s"].to_numpy() / n
    return mean, np.sqrt(np.maximum(rows["ss"].to_numpy() / n - mean * mean, 0.0)), int(n)


def first_scores(docs: DataFrame, model: Model, weights: np.ndarray) -> np.ndarray:
    """How many rows of ``docs`` (text) have a first score in each bin."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BINS, np.int64)
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in text_chunks(texts):
                total += np.bincount(bins_of(model.inputs(features(texts[a:b])), weights), minlength=BINS)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bin": at, "n": total[at]})

    rows = (docs.select("text").mapInPandas(lambda b: given_back(run(b)), "bin long, n long")
            .groupBy("bin").agg(F.sum("n").alias("n")).toPandas())  # at most BINS rows
    out = np.zeros(BINS, np.int64)
    out[rows["bin"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def train(docs: DataFrame, labels: DataFrame, most_positive: int = SAMPLE_POSITIVE,
          most_unlabelled: int = SAMPLE_UNLABELLED) -> Model:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, quality), both already cut to what may be learned
    from. Labels other than 1 are not used."""
    trusted = labels.where(F.col("quality") == 1).select("doc_id").dropDuplicates()
    chosen = sample_ids(trusted, most_positive, 1).select("doc_id", F.lit(True).alias("positive")).unionByName(
        sample_ids(docs.select("doc_id").where(F.col("doc_id").isNotNull()).dropDuplicates(), most_unlabelled, 2)
        .select("doc_id", F.lit(False).alias("positive")))
    # The sample is bounded by the two parameters, so its ids may be broadcast.
    rows = feature_rows(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")).toPandas()
    x = np.array(rows["x"].tolist(), np.float64).reshape(len(rows), -1)
    positive = rows["positive"].to_numpy(bool)
    if not positive.any() or positive.all():
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), None, 0.0)
    mean, scale, _ = moments(docs)
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), None, 0.5)
    # The rows come in any order; sorted by their features they are the same sample in every run.
    x, positive = x[order := np.lexsort(x.T)], positive[order]
    order = np.random.default_rng(5).permutation(len(x))
    x, positive = x[order], positive[order]
    p, u = model.inputs(x[positive]), model.inputs(x[~positive])
    half = len(p) // 2
    if half >= 20 and len(u) >= 40:
        # One half of the positives makes the order, the other half and all documents are ordered by it.
        w = fit_pu_order(p[:half], u)
        model.prior = prior_of(np.bincount(bins_of(p[half:], w), minlength=BINS), first_scores(docs, model, w))
    model.weights = fit_nnpu(p, u, model.prior)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with score and predicted (columns of these names are replaced)."""

    @F.pandas_udf("double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(model.score(batch.tolist()))

    return docs.withColumn("score", run(F.col("text"))).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))


def held_out(doc_id: str | Column = "doc_id") -> Column:
    return F.coalesce(fold(doc_id, 3) == 1, F.lit(False))


def op2_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    model = train(docs.where(~held_out()), labels.where(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
