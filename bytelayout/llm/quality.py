"""Quality classifier from positives and unlabelled text.

Only documents that are known to be good are labelled; everything else is unlabelled
web text in which an estimated share is good as well. With the risk of calling a
positive negative subtracted at that share, the unlabelled rows give an unbiased risk
of the negatives; where a flexible model would drive it below zero, it is held at zero
by stepping back (the non-negative estimator). That share, the class prior, is
estimated from the positives and the unlabelled rows alone; labels of bad documents
are not used.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bytelayout.llm.rows import id_and_text, keep_where, map_texts, named
from bytelayout.session import materialize

# The model is fitted on the driver, on at most so many rows of either kind.
SAMPLE_ROWS = 20_000
FOLDS = 5
THRESHOLD = 0.3

MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def features(text: bytes) -> np.ndarray:
    """Shape of a text, whatever its language or length: a vector of numbers around 0 to 1."""
    size = max(1, len(text))
    share = np.bincount(np.frombuffer(text, np.uint8), minlength=256) / size
    words = text.split()
    n = max(1, len(words))
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    lines = [line for line in text.split(b"\n") if line.strip()]
    return np.array([
        share[65:91].sum(), share[97:123].sum(), share[48:58].sum(), share[128:].sum(), share[32], share[10],
        *np.sqrt(share[list(MARKS)]),
        np.sqrt(share[list(MARKS)].sum()),
        np.log1p(len(words)) / 8,
        lengths.mean() / 10,
        lengths.std() / 10,
        len(counts) / n,
        max(counts.values(), default=0) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n,
        sum(word.isupper() and len(word) > 1 for word in words) / n,
        sum(not word[-1:].isalnum() and word[-1] < 0x80 for word in words) / n,
        sum(len(word) == 1 and not word.isalnum() for word in words) / n,
        len(set(lines)) / max(1, len(lines)),
        len(zlib.compress(text, 1)) / size if len(text) > 64 else 0.6,
        float(not words),
    ])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass(frozen=True)
class Model:
    """One hidden layer over standardised features; `prior` is the estimated share of positives."""

    mean: np.ndarray
    scale: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: float
    prior: float

    def scores(self, rows: np.ndarray) -> np.ndarray:
        x = np.clip((rows - self.mean) / self.scale, -8, 8)
        return sigmoid(np.tanh(x @ self.hidden + self.hidden_bias) @ self.out + self.out_bias)


def fit(
    positive: np.ndarray, unlabelled: np.ndarray, prior: float, units: int = 16, epochs: int = 60,
    rate: float = 0.01, decay: float = 1e-4, batch: int = 512, seed: int = 7,
) -> Model:
    """Minimise the non-negative risk with the sigmoid loss by Adam on mini-batches."""
    random = np.random.default_rng(seed)
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-3
    x_p, x_u = (np.clip((rows - mean) / scale, -8, 8) for rows in (positive, unlabelled))
    width = x_p.shape[1]
    weights = [random.normal(0, 1 / np.sqrt(width), (width, units)), np.zeros(units), random.normal(0, 0.3, units), np.zeros(1)]
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in weights]
    steps = max(1, min(len(x_p), len(x_u)) // batch)
    time = 0
    for epoch in range(epochs):
        order_p, order_u = random.permutation(len(x_p)), random.permutation(len(x_u))
        for step in range(steps):
            rows_p, rows_u = x_p[order_p[step::steps]], x_u[order_u[step::steps]]
            rows = np.concatenate((rows_p, rows_u))
            inner = np.tanh(rows @ weights[0] + weights[1])
            positive_p = sigmoid(inner @ weights[2] + weights[3][0])
            n_p, n_u = len(rows_p), len(rows_u)
            slope = positive_p * (1 - positive_p)
            # Loss of calling a row positive is 1 - p, of calling it negative p.
            negative_risk = positive_p[n_p:].mean() - prior * positive_p[:n_p].mean()
            grad = np.empty_like(slope)
            if negative_risk >= 0:
                grad[:n_p], grad[n_p:] = -2 * prior * slope[:n_p] / n_p, slope[n_p:] / n_u
            else:  # step back: only the negative risk, upwards
                grad[:n_p], grad[n_p:] = prior * slope[:n_p] / n_p, -slope[n_p:] / n_u
            back = np.outer(grad, weights[2]) * (1 - inner**2)
            grads = [rows.T @ back + decay * weights[0], back.sum(0), inner.T @ grad + decay * weights[2], grad.sum(keepdims=True)]
            time += 1
            step_rate = rate * (1 - epoch / epochs)
            for weight, moment, g in zip(weights, moments, grads, strict=True):
                moment[0] += 0.1 * (g - moment[0])
                moment[1] += 0.001 * (g * g - moment[1])
                weight -= step_rate * (moment[0] / (1 - 0.9**time)) / (np.sqrt(moment[1] / (1 - 0.999**time)) + 1e-8)
    return Model(mean, scale, weights[0], weights[1], weights[2], float(weights[3][0]), prior)


def smallest_bound(positive: np.ndarray, unlabelled: np.ndarray, confidence: float = 0.9) -> float:
    """The share of positives among unlabelled rows, from scores of both.

    Above any threshold, the share of unlabelled rows divided by the share of positives
    is at least the wanted share, and equals it where no negative scores so high. The
    threshold with the smallest quotient is taken, after adding to each what the two
    shares may be off by (Hoeffding); without that the few highest rows would decide.
    One unlabelled row more counts as above the threshold, so that the share is never 0.
    """
    thresholds = np.unique(positive)
    share_p, share_u = (
        1 - np.searchsorted(np.sort(scores), thresholds, "left") / len(scores) for scores in (positive, unlabelled)
    )
    spread = np.log(4 / (1 - confidence)) / 2
    error = np.sqrt(spread / len(positive)) + np.sqrt(spread / len(unlabelled))
    share_u = (share_u * len(unlabelled) + 1) / (len(unlabelled) + 1)
    best = np.argmin((share_u + error) / share_p)
    return min(1.0, share_u[best] / share_p[best])


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 7) -> float:
    """The share of positives among the unlabelled rows, known from the two kinds alone.

    A model that tells the kinds apart is fitted on every other row and scores the
    rest, and the other way round; the prior is the mean of both estimates. Where
    there is only one row of a kind, it is in both halves.
    """
    halves = [(rows[::2], rows[1::2] if len(rows) > 1 else rows) for rows in (positive, unlabelled)]
    found = []
    for fitted, scored in ((0, 1), (1, 0)):
        model = fit(halves[0][fitted], halves[1][fitted], 0.5, seed=seed)
        found.append(smallest_bound(model.scores(halves[0][scored]), model.scores(halves[1][scored])))
    return float(np.mean(found))


def fold(doc_id: Column, folds: int = FOLDS) -> Column:
    """CRC-32 of the id as text, modulo `folds`; fold 0 is held out. A null id is the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def sampled(rows: DataFrame, most: int) -> DataFrame:
    """Some `most` rows, chosen by a hash of their columns, so that the layout of the files does not matter.

    Equal rows are taken or left together. Should they make more than `most`, each row is taken or left by
    itself, which keeps the sample bounded though a row repeats without end. Nothing is shuffled.
    """
    share = 0.95 * most / max(1, rows.count())
    if share >= 1:
        return rows
    parts = 1 << 30
    chosen = rows.where(F.pmod(F.xxhash64(*rows.columns, F.lit(11)), F.lit(parts)) < int(share * parts))
    left = 0.95 * most / max(1, chosen.count())
    return chosen if left >= 0.9 else chosen.where(F.rand(11) < left)


def vectors(docs: DataFrame) -> np.ndarray:
    """Feature rows of a bounded table, on the driver."""
    def each() -> Callable[[list[bytes]], list[list]]:
        return lambda texts: [[features(text).astype("<f4").tobytes() for text in texts]]

    rows = map_texts(docs, [T.StructField("x", T.BinaryType())], each).select("x").collect()
    return np.array([np.frombuffer(row[0], "<f4") for row in rows], float) if rows else np.zeros((0, 0))


def train_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    label_id_col: str = "doc_id", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, seed: int = 7,
) -> Model | None:
    """A model from the labels outside fold 0, None when there is no positive or no text.

    Positives are documents with label 1, unlabelled ones any documents; at most
    `sample_rows` of either are used. The class prior is estimated from these two, see
    `estimate_prior`. An id labelled more than once counts by its largest label; labels
    that are 0 or null, or of unknown ids, are left out.
    """
    texts = id_and_text(docs, id_col, text_col)
    known = labels.select(named(labels, label_id_col).alias("doc_id"), named(labels, label_col).alias("label"))
    known = known.where("doc_id IS NOT NULL AND label = 1").where(fold(F.col("doc_id")) != 0)
    # Some sample_rows ids; the rows of an id that repeats are thinned out again.
    chosen = F.broadcast(materialize(sampled(known.select("doc_id").distinct(), sample_rows)))
    positive = vectors(sampled(texts.join(chosen, "doc_id", "left_semi"), sample_rows))[:sample_rows]
    unlabelled = vectors(sampled(texts, sample_rows))[:sample_rows]
    if not len(positive) or not len(unlabelled):
        return None
    return fit(positive, unlabelled, estimate_prior(positive, unlabelled, seed), seed=seed)


def score_texts(model: Model | None, texts: list[bytes]) -> list[float]:
    if model is None:
        return [0.5] * len(texts)
    return model.scores(np.array([features(text) for text in texts])).tolist()


def score_quality(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id` and `score` (0 to 1) of every row; null counts as empty text. Without a model all score 0.5."""
    fields = [T.StructField("score", T.DoubleType())]
    return map_texts(id_and_text(docs, id_col, text_col), fields, lambda: lambda texts: [score_texts(model, texts)])


def keep_good(docs: DataFrame, model: Model | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that score at least `threshold`, with all their columns."""
    return keep_where(docs, text_col, lambda: lambda texts: [s >= threshold for s in score_texts(model, texts)])
