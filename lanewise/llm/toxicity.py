"""Toxicity scores by non-negative positive-unlabelled learning.

A logistic classifier in numpy is trained from confirmed toxic documents (P)
and unlabelled ones (U) on the class-prior-corrected risk

    prior * E_P[l(z)] + max(0, E_U[l(-z)] - prior * E_P[l(-z)])

whose second term, the risk of the unseen negatives, is kept from going below
zero: where a batch takes it there, the step goes the other way. Features are
whether a text holds a word, or a word with one of some beginnings, which
stand for stems; those kept tell P from U best on the training sample.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.llm.common import drop, small_batches, utf8, written

#: Default bounds of the training sample: confirmed toxic documents and unlabelled ones, drawn by the hash of their id, in expectation. Scoring has no such bound.
MOST_POSITIVE, MOST_UNLABELLED = 4_000, 12_000
FEATURES, BEGINNINGS, LEAST_DOCS, LEAST_RATIO = 1024, (4, 5, 6), 3, 2.0
THRESHOLD = 0.3
#: The prior is taken as this share of what the labels show: an estimate that is too high makes the negatives' risk negative at the right answer.
PRIOR_SHARE = 0.75
CACHE = 400_000

#: ASCII letters in lower case, digits and all other bytes as they are, the rest of ASCII as space.
AS_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def word_features(word: bytes) -> set[bytes]:
    """The word with a mark at its end, and its beginnings of some lengths in bytes."""
    return {word + b"$", *(word[:n] for n in BEGINNINGS if len(word) >= n)}


def text_features(text: bytes) -> set[bytes]:
    return set().union(*map(word_features, set(text.translate(AS_WORDS).split())))


@dataclass
class Model:
    """vocabulary: feature -> column; score = sigmoid(sum of the weights of the features that a text holds + bias)."""

    vocabulary: dict[bytes, int]
    weights: np.ndarray
    bias: float

    def scorer(self):
        """bytes -> score, with a bounded memory of the words seen."""
        dull: set[bytes] = set()
        live: dict[bytes, list[int]] = {}

        def columns(text: bytes) -> list[int]:
            words = set(text.translate(AS_WORDS).split()) - dull
            found: set[int] = set()
            for w in words:
                if w not in live:
                    hits = [self.vocabulary[f] for f in word_features(w) if f in self.vocabulary]
                    if not hits:
                        dull.add(w)
                        continue
                    live[w] = hits
                found.update(live[w])
            if len(dull) + len(live) > CACHE:
                dull.clear()
                live.clear()
            return sorted(found)

        def score(text: bytes) -> float:
            z = float(self.weights[columns(text)].sum()) + self.bias
            return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

        score.columns = columns
        return score


def held_out(name: str = "doc_id") -> Column:
    """crc32(id as text) mod 4 is 2; false for a null id."""
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _drawn(df: DataFrame, most: int) -> DataFrame:
    """About ``most`` rows, by the hash of doc_id: all of them where there are no more."""
    n = df.count()
    return df if n <= most else df.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int((1 << 30) * most / n)))


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = {True: Counter(), False: Counter()}
    for b in batches:
        for text, positive in zip(b.column("text").to_pylist(), b.column("positive").to_pylist(), strict=True):
            counts[positive].update(text_features(text))
    names = list(counts[True].keys() | counts[False].keys())
    for i in range(0, len(names), 1 << 16):
        part = names[i : i + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), *(pa.array([counts[k][x] for x in part], pa.int64()) for k in (True, False))], ["f", "p", "u"])


def risk(w: np.ndarray, xp: np.ndarray, xu: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """The two terms of the PU risk (positives, unseen negatives before it is kept from going below zero) and their gradients; the last of w is the bias."""
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    bias = w[-1].astype(xp.dtype)
    zp, zu = xp @ w[:-1].astype(xp.dtype) + bias, xu @ w[:-1].astype(xu.dtype) + bias
    positive, negative = prior * np.logaddexp(0, -zp).mean(), np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()

    def mean(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.append(y.astype(x.dtype) @ x, y.sum()).astype(np.float64) / len(x)

    return float(positive), float(negative), -prior * mean(xp, sigmoid(-zp)), mean(xu, sigmoid(zu)) - prior * mean(xp, sigmoid(zp))


def fit_nnpu(x: np.ndarray, positive: np.ndarray, prior: float, decay: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of the non-negative PU risk with logistic loss and weight decay, by Adam on all rows at once.

    Batches would estimate the second term of the risk too badly where
    positives are few, and its correction would undo what the first one learns.
    """
    xp, xu = (x[k].astype(np.float32) for k in (positive, ~positive))
    w = np.zeros(x.shape[1] + 1)
    w[-1] = math.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        _, negative, of_positive, of_negative = risk(w, xp, xu, prior)
        grad = of_positive + of_negative if negative >= 0 else -of_negative
        grad[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED) -> Model:
    """A model from docs(doc_id, text) and labels(doc_id, toxic), of rows that are not held_out alone.

    Positives have a label toxic = 1, unlabelled documents no label at all; the
    class prior is PRIOR_SHARE of toxic's share among the labelled. Null ids, labels and
    texts: no part of the training (a null text is an empty one). A document
    with labels of both kinds counts as toxic. At most about most_positive and
    most_unlabelled documents are learned from, drawn by the hash of their id
    (the driver holds them as rows of FEATURES bytes); the choice of features
    and the fit see these alone, scoring sees every text whole. Without positives or without
    unlabelled documents the model gives every text the prior.
    """
    small_batches(docs.sparkSession)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    prior = known.agg(F.avg("toxic")).first()[0]
    prior = PRIOR_SHARE * min(max(prior if prior is not None else 0.01, 1e-3), 0.9)
    ids = docs.where(F.col("doc_id").isNotNull() & ~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"))
    p = _drawn(known.where("toxic = 1").select("doc_id"), most_positive).withColumn("positive", F.lit(True))
    u = _drawn(ids.join(known, "doc_id", "left_anti").distinct(), most_unlabelled).withColumn("positive", F.lit(False))
    chosen = F.broadcast(p.union(u))  # bounded by most_positive + most_unlabelled
    sample = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text")).join(chosen, "doc_id"), "sample")
    np_, nu = (sample.where(F.col("positive") == k).count() for k in (True, False))
    if not np_ or not nu:
        drop(sample)
        return Model({}, np.zeros(0), float(np.log(prior / (1 - prior))))
    counts = sample.select("text", "positive").mapInArrow(_feature_counts, "f binary, p long, u long").groupBy("f").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    rate_p, rate_u = (F.col("p") + 0.5) / (np_ + 1), (F.col("u") + 0.5) / (nu + 1)
    rate_n = F.greatest((rate_u - prior * rate_p) / (1 - prior), F.lit(0.5 / (nu + 1)))
    gain = rate_p * F.log(rate_p / rate_n) + (1 - rate_p) * F.log((1 - rate_p) / (1 - F.least(rate_n, F.lit(1 - 1e-6))))
    known_well = F.log(rate_p / rate_u) - 2 * F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("u") + 0.5)) > math.log(LEAST_RATIO)
    best = counts.where((F.col("p") >= LEAST_DOCS) & known_well).select("f", gain.alias("g")).orderBy(F.desc("g"), "f").limit(FEATURES).collect()
    vocabulary = {bytes(r.f): i for i, r in enumerate(best)}
    empty = Model(vocabulary, np.zeros(len(vocabulary)), 0.0)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = empty.scorer().columns
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("positive"), pa.array([columns(t) for t in b.column("text").to_pylist()], pa.list_(pa.int32()))], ["doc_id", "positive", "x"])

    rows = sample.mapInArrow(vectors, "doc_id long, positive boolean, x array<int>").toArrow().sort_by([("doc_id", "ascending"), ("positive", "ascending")])
    drop(sample)
    x = np.zeros((rows.num_rows, len(vocabulary)), np.uint8)
    for i, columns in enumerate(rows.column("x").to_pylist()):
        x[i, columns] = 1
    weights, bias = fit_nnpu(x, rows.column("positive").to_numpy().astype(bool), prior, decay=0.1 / np_)
    return Model(vocabulary, weights, bias)


def score(model: Model, text: str = "text") -> Column:
    """The score of a text column, 0 to 1; of null and empty texts that of a text without features."""
    cell: list = []

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        if not cell:
            cell.append(model.scorer())
        return pa.array([cell[0](t) for t in texts.to_pylist()], pa.float64())

    return of(utf8(text))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; other columns are no input and not returned.

    Repeated ids keep a row each, scored by its own text; a null text is an empty one.
    """
    scored = docs.select("doc_id", held_out().alias("held_out"), score(train(docs, labels)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of docs whose score is below THRESHOLD, with all their columns."""
    return docs.where(score(train(docs, labels)) < THRESHOLD)
