"""Quality classification from positives and unlabelled text.

The classifier minimises the non-negative unbiased risk of positive-unlabelled learning: with class
prior pi, trusted positives P and unlabelled web text U,

    risk = pi * R+(P) + max(0, R-(U) - pi * R-(P)),

where R+ and R- are the mean logistic losses for either sign. When the second term falls below
zero, its gradient is followed upwards instead, so a flexible model does not overfit.

Negative labels are never learned from. The prior is estimated from P and U: a linear classifier of P
against U ranks a third of both that was held aside, and the share of U over a threshold, divided by that
of P, bounds the prior from above; the threshold is the one whose ratio plus its sampling error is least
(best bin estimation). A last logistic calibration of the margin minimises the unbiased risk of the two over
the same third, which is convex, so scores are probabilities under the estimated prior.

Features are computed over whole texts from their bytes: shares of each ASCII character, of
transitions between character classes, repetition of words and of lines, and lengths. They know
nothing of language, source or id.

Training reads a sample of bounded size, chosen by hashed id: at most SAMPLE_POSITIVE trusted
positives and SAMPLE_UNLABELLED unlabelled texts. Rows are put in an order of their own first, so the
same tables give the same model. Where all documents are labelled, the labelled ones count as unlabelled.

Edge cases: null and empty texts have all shares zero and get a score like any other. Null ids and
labels train nothing. Repeated rows are scored each. With fewer than LEAST_ROWS positives or unlabelled texts there
is nothing to learn from; then every score is 1, so that a filter keeps all. An empty table gives an
empty result. Very long texts are read whole. Columns besides id and text are not looked at, whatever
their names, and keep_good passes them through.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.llm._core import labelled_sample, slices
from voxlake.llm._text import U64, buffers, mixed, word_hashes
from voxlake.llm.toxicity import logistic

SAMPLE_POSITIVE, SAMPLE_UNLABELLED = 8_000, 8_000
LEAST_ROWS = 10
#: Score from which a document is good.
GOOD = 0.7

_LETTER_A, _LETTER_Z = 97, 122


def _class_of(b: int) -> int:
    """One of sixteen classes: marks that carry structure stand alone."""
    c = chr(b)
    if b >= 128:
        return 0
    if c.islower():
        return 1
    if c.isupper():
        return 2
    if c.isdigit():
        return 3
    if c in " \n\t":
        return 4 + " \n\t".index(c)
    if c in ".,":
        return 7
    if c in "!?":
        return 8
    if c in "#$%&*":
        return 9
    if c == "|":
        return 10
    if c in "<>{}[]()":
        return 11
    if c in "'\"`-":
        return 12
    if c in ":;=/\\@_+~^":
        return 13
    return 14 if b >= 32 else 15


_CLASS = np.array([_class_of(b) for b in range(256)], np.int64)
_CHAR = np.array([min(b, 128) for b in range(256)], np.int64)
N_FEATURES = 129 + 256 + 8


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of features for each text."""
    n, sizes = len(offsets) - 1, np.diff(offsets)
    out = np.zeros((n, N_FEATURES), np.float32)
    if not len(data):
        return out
    doc = np.repeat(np.arange(n), sizes)
    length = np.maximum(sizes, 1)[:, None]
    out[:, :129] = np.bincount(doc * 129 + _CHAR[data], minlength=n * 129).reshape(n, 129) / length
    kind = _CLASS[data]
    same = doc[1:] == doc[:-1]
    out[:, 129:385] = np.bincount((doc[:-1] * 256 + kind[:-1] * 16 + kind[1:])[same], minlength=n * 256).reshape(n, 256) / length
    words, of = word_hashes(data, offsets)
    counts = np.bincount(of, minlength=n)
    per = np.maximum(counts, 1)
    twice = np.zeros(len(words), bool)
    if len(words) > 1:
        twice[1:] = (words[1:] == words[:-1]) & (of[1:] == of[:-1])
    pairs = mixed(words[:-1] * U64(31) + words[1:]) if len(words) > 1 else np.zeros(0, U64)
    of_pair = of[1:][of[1:] == of[:-1]] if len(words) > 1 else np.zeros(0, np.int64)
    pairs = pairs[of[1:] == of[:-1]] if len(words) > 1 else pairs
    key = np.sort((of_pair.astype(U64) << U64(44)) | (pairs >> U64(20)))
    again = np.zeros(len(key), bool)
    again[1:] = key[1:] == key[:-1]
    repeated = np.bincount((key[again] >> U64(44)).astype(np.int64), minlength=n)
    lines = np.bincount(doc[data == 10], minlength=n)
    out[:, 385] = np.bincount(of[twice], minlength=n) / per
    out[:, 386] = repeated / per
    out[:, 387] = np.log1p(counts)
    out[:, 388] = np.minimum(sizes / per, 60) / 10
    out[:, 389] = np.minimum((lines + 1) / per, 1)
    out[:, 390] = np.log1p(sizes)
    out[:, 391] = np.sqrt(out[:, 385])
    out[:, 392] = np.sqrt(out[:, 386])
    return out


class Model(NamedTuple):
    centre: np.ndarray
    spread: np.ndarray
    hidden: tuple[np.ndarray, np.ndarray]
    last: tuple[np.ndarray, float]
    calibration: tuple[float, float]
    prior: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        return _forward(((x - self.centre) / self.spread).clip(-8, 8), self.hidden, self.last)[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.centre):
            return np.ones(len(x))
        return 1 / (1 + np.exp(-np.clip(self.calibration[0] + self.calibration[1] * self.margin(x), -30, 30)))


UNTRAINED = Model(np.zeros(0), np.ones(0), (np.zeros((0, 0)), np.zeros(0)), (np.zeros(0), 0.0), (0.0, 0.0), 1.0)


def _forward(x: np.ndarray, hidden: tuple, last: tuple) -> tuple[np.ndarray, np.ndarray]:
    h = np.tanh(x @ hidden[0] + hidden[1])
    return h @ last[0] + last[1], h


def train_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, width: int = 16, epochs: int = 40, least_steps: int = 400, batch: int = 512, rate: float = 2e-3, decay: float = 1e-4, seed: int = 7) -> tuple[tuple, tuple]:
    """One hidden layer under the non-negative risk, by Adam."""
    rng = np.random.default_rng(seed)
    d = positive.shape[1]
    params = [rng.normal(0, 1 / np.sqrt(d), (d, width)), np.zeros(width), rng.normal(0, 1 / np.sqrt(width), width), np.zeros(1)]
    first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    steps = max(1, min(len(positive), len(unlabelled)) // batch)
    epochs = max(epochs, least_steps // steps)

    def gradient(x: np.ndarray, sign: float) -> tuple[float, list[np.ndarray]]:
        """Mean logistic loss for the given sign, and its gradient."""
        z, h = _forward(x, (params[0], params[1]), (params[2], params[3]))
        loss = np.logaddexp(0, -sign * z).mean()
        g = -sign / (1 + np.exp(np.clip(sign * z, -30, 30))) / len(x)
        back = np.outer(g, params[2]) * (1 - h * h)
        return loss, [x.T @ back, back.sum(0), h.T @ g, np.array([g.sum()])]

    for _ in range(epochs):
        p_order, u_order = rng.permutation(len(positive)), rng.permutation(len(unlabelled))
        for s in range(steps):
            p, u = positive[p_order[s::steps]], unlabelled[u_order[s::steps]]
            _, up = gradient(p, 1.0)
            down_loss, down = gradient(p, -1.0)
            u_loss, u_grad = gradient(u, -1.0)
            if u_loss - prior * down_loss >= 0:
                total = [prior * a - prior * b + c for a, b, c in zip(up, down, u_grad, strict=True)]
            else:
                total = [prior * b - c for b, c in zip(down, u_grad, strict=True)]
            t += 1
            for i, g in enumerate(total):
                g = g + decay * params[i]
                first[i] += 0.1 * (g - first[i])
                second[i] += 0.001 * (g * g - second[i])
                params[i] = params[i] - rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    return (params[0], params[1]), (params[2], float(params[3][0]))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, doubt: float = 0.1, slack: float = 0.01) -> float:
    """The share of positives among the unlabelled, from rankings of both that training has not seen.

    U(t) >= prior * P(t) for the tails over any threshold t, and nearly equal where no negative ranks that
    high. The threshold is the one at which the ratio and its sampling error are least in sum.
    """
    at = np.unique(positive)
    p = 1 - np.searchsorted(np.sort(positive), at) / len(positive)
    u = 1 - np.searchsorted(np.sort(unlabelled), at) / len(unlabelled)
    error = (1 + slack) * (np.sqrt(np.log(4 / doubt) / (2 * len(unlabelled))) + np.sqrt(np.log(4 / doubt) / (2 * len(positive))))
    return float(np.clip((u / p)[np.argmin((u + error) / p)], 0.01, 0.99))


def calibrate(positive: np.ndarray, unlabelled: np.ndarray, prior: float, ridge: float = 1e-4, rounds: int = 100) -> tuple[float, float]:
    """(a, b) of sigmoid(a + b * margin) with the least unbiased logistic risk of positives and unlabelled.

    The risk is mean over U of softplus(a + b z) less prior times the mean over P of a + b z; it is convex.
    """
    scale = max(1e-9, float(np.abs(unlabelled).mean()))
    x = np.stack([np.ones(len(unlabelled)), unlabelled / scale], 1)
    goal = prior * np.array([1.0, float(positive.mean()) / scale])
    keep = np.diag([1e-6, ridge])

    def risk(w: np.ndarray) -> float:
        return float(np.logaddexp(0, x @ w).mean() - goal @ w + w @ keep @ w / 2)

    w = np.zeros(2)
    for _ in range(rounds):
        s = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (s * (1 - s))[:, None]).T @ x / len(x) + keep, x.T @ s / len(x) - goal + keep @ w)
        size = 1.0
        while size > 1e-6 and risk(w - size * step) > risk(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(w[0]), float(w[1] / scale)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, seed: int = 7) -> Model:
    """A model from positives and unlabelled alone; without a prior, it is estimated."""
    rng = np.random.default_rng(seed)
    everything = np.vstack([positive, unlabelled])
    centre, spread = everything.mean(0), everything.std(0) + 1e-3
    (p, p_aside), (u, u_aside) = (np.split(x[rng.permutation(len(x))], [len(x) - len(x) // 3]) for x in (((a - centre) / spread).clip(-8, 8) for a in (positive, unlabelled)))
    if prior is None:
        w = logistic(np.vstack([p, u]), np.concatenate([np.ones(len(p)), np.zeros(len(u))]))
        prior = estimate_prior(p_aside @ w[1:], u_aside @ w[1:])
    hidden, last = train_nnpu(p, u, prior)
    margins = [_forward(x, hidden, last)[0] for x in (p_aside, u_aside)]
    return Model(centre, spread, hidden, last, calibrate(*margins, prior), prior)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in slices(batch.column(0)):
            x = features(*buffers(batch.column(0).slice(a, b - a)))
            yield pa.RecordBatch.from_arrays([pa.array([row.tobytes() for row in x], pa.binary()), batch.column(1).slice(a, b - a)], ["x", "label"])


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, others: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", prior: float | None = None) -> Model:
    """A model from the positives among labels (the training rows alone) and from documents that others does not name.

    others has the ids of all labelled documents, of any fold: none of them counts as unlabelled, unless
    there are no other documents; then those that labels names do, whatever their label.
    """
    rows = labels.select(F.col(id_col), F.col(label_col).cast("int").alias("label"))
    known = rows.where("label = 1")
    free = docs.select(id_col).join(others.select(id_col), id_col, "left_anti").select(id_col, F.lit(2).alias("label"))
    by = _sampled(spark, docs, known.unionAll(free), id_col, text_col)
    if not len(by[2]):
        by[2] = _sampled(spark, docs, rows.where("label in (0, 1)").select(id_col, F.lit(2).alias("label")), id_col, text_col)[2]
    if min(len(by[1]), len(by[2])) < LEAST_ROWS:
        return UNTRAINED
    return fit(by[1], by[2], prior)


def _sampled(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> dict[int, np.ndarray]:
    """Features of the positives (1) and the unlabelled (2) of a bounded sample, in an order of their own."""
    sample = labelled_sample(spark, docs, labels, {1: SAMPLE_POSITIVE, 2: SAMPLE_UNLABELLED}, id_col, text_col)
    rows = sorted(((r.label, bytes(r.x)) for r in sample.mapInArrow(_vectors, "x binary, label int").collect()))
    return {k: np.array([np.frombuffer(x, np.float32) for label, x in rows if label == k], np.float64).reshape(-1, N_FEATURES) for k in (1, 2)}


def score_documents(spark: SparkSession, docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, score."""
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                found = shared.value.score(features(*buffers(batch.column(1).slice(a, b - a))))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(found, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(score, "doc_id long, score double")


def keep_good(spark: SparkSession, docs: DataFrame, model: Model, text_col: str = "text", least: float = GOOD) -> DataFrame:
    """The rows of docs whose score is at least least; all columns stay."""
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(at)):
                part = batch.slice(a, b - a)
                good = shared.value.score(features(*buffers(part.column(at)))) >= least
                if good.any():
                    yield part.filter(pa.array(good))

    return docs.mapInArrow(keep, docs.schema)
