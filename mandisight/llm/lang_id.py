"""Operator 10: language ID.

Character 1- to 3-grams (lower-cased, white space as one mark) are hashed
into a fixed number of features. Document frequencies are counted over every
document that may be learned from; a multinomial logistic regression on
TF-IDF vectors is then trained on a bounded, documented sample of labelled
documents with follow-the-regularised-leader (per-coordinate learning rates,
L1 and L2 penalties), which leaves most weights at exactly zero. A held-out
quarter of the sample sets the temperature that calibrates the scores. Every
whole text is scored.

Defined results: null texts and texts without a letter are ``und`` with score
1; ties between languages go to the first in alphabetical order; with no
labelled text at all every text is ``und`` with score 0 (those without a
letter: 1); rows are judged one by one, so repeated rows are equal; an empty
table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mandisight.llm.common import fold, given_back, table, text_chunks

FEATURES = 1 << 12
MAX_GRAM = 3
#: At most this many labelled documents are collected to train on.
SAMPLE_DOCS = 3000
#: Of which the training holds back every fourth to calibrate.
CALIBRATION = 4
ALPHA, BETA, L1, L2 = 0.1, 1.0, 0.02, 0.02
EPOCHS, BATCH = 4, 16
#: Share of right predictions that may lie below the floor of certain scores.
RIGHT_BELOW = 0.002
UNDETERMINED = "und"

_LETTER = regex.compile(r"\p{L}")
_SPACE = regex.compile(r"\s+")


def gram_counts(texts: list[str], features: int = FEATURES) -> np.ndarray:
    """texts x features counts of hashed character n-grams."""
    # NUL marks the ends of a text, so no n-gram spans two texts.
    clean = [_SPACE.sub(" ", t).lower().replace("\0", " ") for t in texts]
    points = np.frombuffer("".join(f"\0{t}\0" for t in clean).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), [len(t) + 2 for t in clean])
    out = np.zeros(len(texts) * features, np.int64)
    code = np.zeros(len(points), np.uint32)
    for n in range(1, MAX_GRAM + 1):
        # The hash of an n-gram from that of its first n - 1 characters.
        code = (code[:len(points) - n + 1] * np.uint32(0x01000193) ^ points[n - 1:]) * np.uint32(0x9E3779B1)
        code ^= code >> np.uint32(15)
        rows = owner[:len(code)]
        inside = rows == owner[n - 1:]
        inside &= points[:len(code)] != 0 if n == 1 else True
        slot = rows[inside] * features + (code[inside] % np.uint32(features))
        out += np.bincount(slot, minlength=len(out))
    return out.reshape(len(texts), features)


def has_letter(text) -> bool:
    return isinstance(text, str) and _LETTER.search(text) is not None


def batches_of_counts(texts: list, features: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Counts of short runs of texts: at most 256 rows and about 400,000 characters at a time."""
    for a, b in text_chunks(texts, 400_000):
        for i in range(a, b, 256):
            j = min(i + 256, b)
            yield i, j, gram_counts(texts[i:j], features)


def document_frequencies(docs: DataFrame, features: int = FEATURES) -> tuple[np.ndarray, int]:
    """Documents holding each feature, and all documents, over every row of ``docs`` (text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(features + 1, np.int64)
        for batch in batches:
            texts = [t for t in batch["text"] if has_letter(t)]
            total[features] += len(texts)
            for _, _, counts in batches_of_counts(texts, features):
                total[:features] += (counts > 0).sum(axis=0)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"feature": at, "n": total[at]})

    # At most features + 1 rows reach the driver.
    rows = (docs.select("text").mapInPandas(lambda batches: given_back(run(batches)), "feature long, n long")
            .groupBy("feature").agg(F.sum("n").alias("n")).collect())
    total = np.zeros(features + 1, np.int64)
    for r in rows:
        total[r["feature"]] = r["n"]
    return total[:features], int(total[features])


def idf_of(frequency: np.ndarray, n_docs: int) -> np.ndarray:
    return (np.log((1 + n_docs) / (1 + frequency)) + 1).astype(np.float32)


def tf_idf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Sub-linear term frequencies times idf, rows of length one."""
    x = np.log1p(counts).astype(np.float32) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Ftrl:
    """Follow-the-regularised-leader (proximal) for multinomial logistic loss."""

    def __init__(self, features: int, classes: int, alpha: float = ALPHA, beta: float = BETA,
                 l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((features, classes)), np.zeros((features, classes))

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def step(self, x: np.ndarray, y: np.ndarray) -> None:
        """One update on a batch (rows of features, one-hot classes)."""
        at = np.flatnonzero(x.any(axis=0))
        x, w = x[:, at], self.weights(at)
        g = x.T @ (softmax(x @ w) - y)
        n = self.n[at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] = n + g * g


def temperature_of(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search over its logarithm.

    Targets are smoothed by one imagined row per class, so a sample without
    errors does not drive the scores to certainty.
    """
    k = logits.shape[1]
    target = np.full(logits.shape, 1 / (len(y) + k))
    target[np.arange(len(y)), y] += len(y) / (len(y) + k)

    def loss(t: float) -> float:
        return -(target * np.log(np.maximum(softmax(logits / np.exp(t)), 1e-12))).sum(axis=1).mean()

    low, high, g = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


class Model:
    """``floor``: the score below which a prediction is uncertain (see ``floor_of``)."""

    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, temperature: float, floor: float = 0.0):
        self.languages, self.idf, self.temperature, self.floor = languages, idf, temperature, floor
        # Only features with a weight are kept.
        self.live = np.flatnonzero(np.abs(weights).any(axis=1))
        self.weights = weights[self.live].astype(np.float32)

    def predict(self, texts: list) -> tuple[list[str], np.ndarray]:
        languages, score = [UNDETERMINED] * len(texts), np.ones(len(texts))
        rows = [i for i, t in enumerate(texts) if has_letter(t)]
        if not self.languages:
            score[rows] = 0.0
            return languages, score
        for a, b, counts in batches_of_counts([texts[i] for i in rows], len(self.idf)):
            # Not a matrix product: a row scores the same in any batch.
            p = softmax(np.einsum("ij,jk->ik", tf_idf(counts, self.idf)[:, self.live], self.weights) / self.temperature)
            best = p.argmax(axis=1)
            for i, k, s in zip(rows[a:b], best, p.max(axis=1), strict=True):
                languages[i], score[i] = self.languages[k], s
        return languages, np.clip(score, 0.0, 1.0)


def floor_of(p: np.ndarray, y: np.ndarray) -> float:
    """The score that RIGHT_BELOW of the right predictions of calibration rows lie below; 0 without such rows.

    So the floor says the same for any number of languages: what scores lower is less certain than almost every
    right prediction.
    """
    right = p.argmax(axis=1) == y
    return float(np.quantile(p.max(axis=1)[right], RIGHT_BELOW)) - 1e-6 if right.any() else 0.0


def quotas(sizes: dict[str, int], most: int) -> dict[str, int]:
    """Equal parts of ``most`` by language; what small languages leave goes to the others. At least one for each."""
    out, left = {}, most
    for i, k in enumerate(sorted(sizes, key=lambda k: (sizes[k], k))):
        out[k] = min(sizes[k], max(1, left // (len(sizes) - i)))
        left = max(0, left - out[k])
    return out


def hash_bound(share: float) -> int:
    """The 64-bit hash up to which ``share`` of all hashes lie."""
    return min((1 << 63) - 1, int(min(1.0, share) * (1 << 64)) - (1 << 63))


def sample_of(labelled: DataFrame, most: int) -> DataFrame:
    """At most ``most`` different (text, lang) in an order given by the text's hash, by ``quotas`` (one per language
    where there are more languages)."""
    spot = F.xxhash64("text", F.lit(10))
    sizes = {r["lang"]: r["n"] for r in labelled.select("lang", spot.alias("spot")).distinct().groupBy("lang").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return labelled.limit(0)
    parts = quotas(sizes, most)
    # Keep a little over each language's part, then cut every language to its own in hash order.
    bounds = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, hash_bound((1.2 * parts[k] + 30) / n))])
    near = labelled.select("text", "lang").where(spot <= bounds[F.col("lang")]).distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("text", F.lit(11)), "text"))
    limits = F.create_map(*[F.lit(x) for k, n in parts.items() for x in (k, n)])
    return near.withColumn("_place", place).where(F.col("_place") <= limits[F.col("lang")]).orderBy(
        F.xxhash64("text", F.lit(11)), "lang").drop("_place")


def train(labelled: DataFrame, most: int = SAMPLE_DOCS, features: int = FEATURES, epochs: int = EPOCHS) -> Model:
    """A model from ``labelled`` (text, lang): frequencies from all rows, weights from the sample."""
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    frequency, n_docs = document_frequencies(labelled, features)
    idf = idf_of(frequency, n_docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[[has_letter(t) for t in batch["text"]]]
            for a, b, counts in batches_of_counts(batch["text"].tolist(), features):
                at = [np.flatnonzero(c) for c in counts]
                yield pd.DataFrame({"lang": batch["lang"].iloc[a:b].array, "at": at,
                                    "n": [c[i] for c, i in zip(counts, at, strict=True)]})

    rows = (sample_of(labelled, most).mapInPandas(run, "lang string, at array<int>, n array<int>")
            .toPandas())  # at most ``most`` sparse rows
    languages = sorted(rows["lang"].unique())
    if not languages:
        return Model([], idf, np.zeros((features, 1)), 1.0)
    # Row by row, so that the driver holds one matrix in single precision and no copies of it.
    x = np.zeros((len(rows), features), np.float32)
    for row, at, n in zip(x, rows["at"], rows["n"], strict=True):
        row[at] = tf_idf(np.asarray(n)[None, :], idf[at])[0]
    y = np.array([languages.index(v) for v in rows["lang"]])
    del rows
    order = np.random.default_rng(0).permutation(len(x))
    held = order[::CALIBRATION] if len(x) >= 8 * CALIBRATION else order[:0]
    learn = np.setdiff1d(order, held)
    ftrl, hot, rng = Ftrl(features, len(languages)), np.eye(len(languages)), np.random.default_rng(1)
    for _ in range(epochs):
        rng.shuffle(learn)
        for a in range(0, len(learn), BATCH):
            part = learn[a:a + BATCH]
            ftrl.step(x[part], hot[y[part]])
    weights = ftrl.weights()
    if not len(held):
        return Model(languages, idf, weights, 1.0)
    logits = x[held] @ weights
    temperature = temperature_of(logits, y[held])
    return Model(languages, idf, weights, temperature, floor_of(softmax(logits / temperature), y[held]))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score (columns of these names are replaced)."""

    @F.pandas_udf("lang_pred string, score double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        def judged() -> Iterator[pd.DataFrame]:
            for batch in texts:
                languages, score = model.predict(batch.tolist())
                yield pd.DataFrame({"lang_pred": languages, "score": score})

        return given_back(judged())

    kept = docs.select(F.struct(*[c for c in docs.columns if c not in ("lang_pred", "score")]).alias("_row"), "text")
    return kept.select("_row", run(F.col("text")).alias("_judged")).select("_row.*", "_judged.*")


def held_out(doc_id: str | Column = "doc_id") -> Column:
    return F.coalesce(fold(doc_id, 4) == 2, F.lit(False))


def op10_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = train(docs.where(~held_out()).select("text", "lang"))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
