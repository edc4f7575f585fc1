"""Toxicity by maximum-scoring segment search.

Training, on a bounded sample of labelled documents: features are words and their beginnings of
four to eight letters. A feature's score is its log-odds between toxic and other documents under a
Dirichlet prior that follows the feature's overall rate, kept where its z-value is significant; a
document counts a feature at most BURST times, so junk repeats weigh little. A word scores as its
best feature, any other word scores -COST.

Scoring: a linear scan keeps the list of disjoint maximal segments of a document (each segment's
sum is the largest there is locally), so every toxic passage is found, however many a document has.
Segment sums follow extreme-value statistics under the background distribution: lambda solves
sum p exp(lambda s) = 1, and K is fitted to how often clean training documents of their lengths
exceed the smallest positive score. A passage's excess is lambda * S - ln(K * N) of its document
of N words; a passage is significant when its expected number is under one. The largest excess, the
sum over significant passages, the number of scoring words, and their share become a probability by
logistic calibration on the training sample.

Edge cases: null and empty texts have no words and get the score of a document without any scoring
word. Null labels or ids train nothing. Ties in scores need no order. Repeated rows are scored each;
a repeated label row counts as often as it stands. Where no toxic document, or no other, is
labelled, all scores are 0. Very long texts are scanned whole, in time linear in their words. An empty table
gives an empty result. Columns besides id and text are not looked at, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.llm._core import by_bytes, labelled_sample
from voxlake.llm.decontamination import words_of

#: Rows of labelled documents that training reads at most, toxic and other.
SAMPLE_TOXIC, SAMPLE_OTHER = 6_000, 9_000
#: Features that the lexicon holds at most.
LEXICON = 20_000
#: Weight of the prior, as a share of all words counted.
PRIOR = 0.02
BURST = 6
COST = 0.35
LEAST_Z = 3.0
LEAST_DOCS = 4
SHORTEST, LONGEST = 4, 8
EULER = 0.5772156649015329


def features_of(words: Iterable[bytes]) -> Counter[bytes]:
    """Words and marked beginnings, each as often as it occurs but at most BURST times."""
    out: Counter[bytes] = Counter()
    for word, n in Counter(words).items():
        out[word] += n
        for k in range(SHORTEST, min(LONGEST, len(word) - 1) + 1):
            out[word[:k] + b"*"] += n
    return Counter({f: min(n, BURST) for f, n in out.items()})


def log_odds(toxic: int, other: int, all_toxic: int, all_other: int, prior: float = PRIOR) -> tuple[float, float]:
    """(log-odds ratio, z-value) under a Dirichlet prior at the pooled rate."""
    prior *= all_toxic + all_other
    a = prior * (toxic + other) / (all_toxic + all_other)
    up = math.log((toxic + a) / (all_toxic + prior - toxic - a))
    down = math.log((other + a) / (all_other + prior - other - a))
    return up - down, (up - down) / math.sqrt(1 / (toxic + a) + 1 / (other + a))


class Passage(NamedTuple):
    start: int
    stop: int
    score: float


def maximal_segments(scores: Iterable[tuple[int, float]], cost: float) -> list[Passage]:
    """All maximal-scoring segments, given the (position, score) of positive words; others score -cost.

    Candidates are kept with the sums before and at their ends; a new word extends back over the
    candidates whose sum before it is not lower, as long as that raises the sum. Each candidate is
    merged once, so the scan is linear in the words.
    """
    held: list[list] = []  # start, stop, sum before, sum at the end
    chain: list[int] = []  # for each candidate, the last one before it with a lower sum before; -1: none
    total, last = 0.0, -1
    for position, score in scores:
        total -= cost * (position - last - 1)
        before, total, last = total, total + score, position
        new = [position, position + 1, before, total]
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= new[2]:
                j = chain[j]
            if j < 0 or held[j][3] >= new[3]:
                held.append(new)
                chain.append(j)
                break
            new[0], new[2] = held[j][0], held[j][2]
            del held[j:], chain[j:]
    return [Passage(a, b, end - before) for a, b, before, end in held]


class Model(NamedTuple):
    lexicon: dict[bytes, float]
    scale: float  # lambda
    log_k: float
    weights: tuple[float, ...]
    trained: bool


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model, self.known = model, {}

    def word(self, word: bytes) -> float:
        lexicon = self.model.lexicon
        best = lexicon.get(word, 0.0)
        for k in range(SHORTEST, min(LONGEST, len(word) - 1) + 1):
            best = max(best, lexicon.get(word[:k] + b"*", 0.0))
        if len(self.known) > 400_000:
            self.known.clear()
        self.known[word] = best
        return best

    def passages(self, words: list[bytes]) -> tuple[list[Passage], int]:
        known, word = self.known, self.word
        hits = [(i, s) for i, w in enumerate(words) if (s := known[w] if w in known else word(w)) > 0]
        return maximal_segments(hits, COST), len(hits)

    def evidence(self, words: list[bytes]) -> tuple[list[float], list[Passage]]:
        """What calibration reads, and the significant passages."""
        found, hits = self.passages(words)
        bar = self.model.log_k + math.log(max(1, len(words)))
        excess = [(self.model.scale * p.score - bar, p) for p in found]
        over = [e for e, _ in excess if e > 0]
        top = max((e for e, _ in excess), default=-bar - 5)
        return [max(-15.0, min(60.0, top)), math.log1p(sum(over)), math.log1p(hits), 40 * math.sqrt(hits / max(20, len(words)))], [p for e, p in excess if e > 0]

    def score(self, evidence: list[float]) -> float:
        if not self.model.trained:
            return 0.0
        x = self.model.weights[0] + sum(w * e for w, e in zip(self.model.weights[1:], evidence, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def choose_lexicon(toxic: dict[bytes, int], other: dict[bytes, int], all_toxic: int, all_other: int, size: int = LEXICON) -> dict[bytes, float]:
    found = []
    for f, n in toxic.items():
        d, z = log_odds(n, other.get(f, 0), all_toxic, all_other)
        if z >= LEAST_Z and d > 2 * COST:
            found.append((z, f, d))
    return {f: d for _, f, d in sorted(found, reverse=True)[:size]}


def background(histograms: list[list[float]], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and their shares of all words, from histograms (score, times, score, times, ...); other words score -COST."""
    times: Counter[float] = Counter()
    for h in histograms:
        for score, n in zip(h[::2], h[1::2], strict=True):
            times[score] += n
    if not times:
        times[1.0] = 1
    values = np.array(sorted(times))
    share = np.array([times[v] for v in values.tolist()]) / max(words, sum(times.values()) + 1)
    return np.append(values, -COST), np.append(share, 1 - share.sum())


def solve_scale(values: np.ndarray, shares: np.ndarray) -> float:
    """lambda > 0 with sum share * exp(lambda * value) = 1; the mean is negative."""
    low, high = 1e-6, 5.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (low, mid) if (shares * np.exp(mid * values)).sum() > 1 else (mid, high)
    return high


def solve_log_k(lengths: np.ndarray, tops: np.ndarray, scale: float) -> float:
    """ln K at which clean documents exceed the median of their positive tops as often as they do."""
    positive = tops[tops > 0]
    if not len(positive):
        return 0.0
    bar = float(np.median(positive))
    seen, low, high = (tops >= bar).sum(), -30.0, 30.0
    for _ in range(100):
        mid = (low + high) / 2
        expected = (1 - np.exp(-np.exp(mid + np.log(np.maximum(lengths, 1)) - scale * bar))).sum()
        low, high = (low, mid) if expected > seen else (mid, high)
    return (low + high) / 2


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1.0) -> np.ndarray:
    """Newton's method; the first weight is the intercept."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    keep = ridge * np.eye(len(w))
    keep[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


_COUNTS = pa.schema([("feature", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])
_EVIDENCE = pa.schema([("label", pa.int32()), ("words", pa.int64()), ("top", pa.float64()), ("hits", pa.list_(pa.float64()))])


def _counted(wanted):
    """Per slice of documents: feature counts, and the number of all words under the empty feature."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            n, docs, total = Counter(), Counter(), 0
            for batch in batches:
                for text in batch.column(0):
                    words = words_of(text.as_py())
                    total += sum(min(c, BURST) for c in Counter(words).values())
                    own = features_of(words)
                    if wanted is not None:
                        own = {f: c for f, c in own.items() if f in wanted.value}
                    n.update(own)
                    docs.update(own.keys())
                    if len(n) > 300_000:
                        yield from ((f, c, docs[f]) for f, c in n.items())
                        n, docs = Counter(), Counter()
            yield from ((f, c, docs[f]) for f, c in n.items())
            yield b"", total, 1 << 40  # stays in front of every feature

        yield from by_bytes(found(), _COUNTS, lambda r: 40)

    return count


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from the labelled documents; a sample of bounded size, chosen by hashed id, is read."""
    sample = labelled_sample(spark, docs, labels.select(F.col(id_col), F.col(label_col).cast("int").alias("label")), {1: SAMPLE_TOXIC, 0: SAMPLE_OTHER}, id_col, text_col)
    return fit(spark, sample.where("label = 1"), sample.where("label = 0"))


def fit(spark: SparkSession, toxic: DataFrame, other: DataFrame) -> Model:
    ddl = "feature binary, n long, docs long"

    def counts(df: DataFrame, wanted, least: int) -> tuple[dict[bytes, int], int]:
        found = df.select("text").mapInArrow(_counted(wanted), ddl).groupBy("feature").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        found = {bytes(r.feature): r.n for r in found.where(F.col("docs") >= least).orderBy(F.desc("docs"), "feature").limit(10 * LEXICON).collect()}
        return found, found.pop(b"", 0)

    n_toxic, all_toxic = counts(toxic, None, LEAST_DOCS)
    wanted = spark.sparkContext.broadcast(frozenset(n_toxic))
    n_other, all_other = counts(other, wanted, 1)
    if not all_toxic or not all_other:
        return Model({}, 1.0, 0.0, (0.0,) * 5, False)
    lexicon = choose_lexicon(n_toxic, n_other, all_toxic, all_other)
    draft = Model(lexicon, 1.0, 0.0, (0.0,) * 5, False)
    scan = spark.sparkContext.broadcast(draft)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(scan.value)

        def found():
            held: Counter[float] = Counter()
            for batch in batches:
                for text in batch.column(0):
                    words = words_of(text.as_py())
                    held.update(s for w in words if (s := scorer.known[w] if w in scorer.known else scorer.word(w)) > 0)
                    yield 0, len(words), max((p.score for p in scorer.passages(words)[0]), default=0.0), []
            yield -1, 0, 0.0, [x for pair in sorted(held.items()) for x in pair]

        yield from by_bytes(found(), _EVIDENCE, lambda r: 32 + 8 * len(r[3]))

    seen = toxic.unionAll(other)
    tops = other.select("text").mapInArrow(look, "label int, words long, top double, hits array<double>").collect()
    lengths, highest = np.array([r.words for r in tops if r.label == 0]), np.array([r.top for r in tops if r.label == 0])
    values, share = background([r.hits for r in tops if r.label < 0], int(lengths.sum()))
    scale = solve_scale(values, share)
    draft = draft._replace(scale=scale, log_k=solve_log_k(lengths, highest, scale))
    weigh = spark.sparkContext.broadcast(draft)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(weigh.value)

        def found():
            for batch in batches:
                for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                    words = words_of(text.as_py())
                    yield label, len(words), 0.0, scorer.evidence(words)[0]

        yield from by_bytes(found(), _EVIDENCE, lambda r: 64)

    known = seen.select("text", "label").mapInArrow(evidence, "label int, words long, top double, hits array<double>").collect()
    x, y = np.array([r.hits for r in known]), np.array([r.label for r in known])
    return draft._replace(weights=tuple(logistic(x, y).tolist()), trained=True)


_SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("n_passages", pa.int64()), ("passages", pa.list_(pa.int64()))])


def score_documents(spark: SparkSession, docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, score, n_passages, passages (flat word ranges)."""
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)

        def found():
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    evidence, passages = scorer.evidence(words_of(text.as_py()))
                    yield doc_id, scorer.score(evidence), len(passages), [x for p in passages for x in (p.start, p.stop)]

        yield from by_bytes(found(), _SCORED, lambda r: 40 + 8 * len(r[3]))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(score, "doc_id long, score double, n_passages long, passages array<long>")
