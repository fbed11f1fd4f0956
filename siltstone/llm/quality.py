"""Quality by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are documents labelled good; unlabelled is web text as it comes. With the
class prior pi, the risk  pi E_p[l(g)] + max(0, E_u[l(-g)] - pi E_p[l(-g)])  is minimised for a
small network over statistics of whole texts; where a minibatch's second term falls below zero,
the step goes up that term instead, so that the network can't fit it below zero. With the
logistic loss the output is a probability. The prior is estimated from positives and unlabelled
text alone, by the best bin of a classifier between the two (Garg et al. 2021): above a score that
positives reach often, unlabelled text that reaches it is taken to be positive. Labels of bad
documents are never read.

Fitting reads at most PER_CLASS labelled documents and UNLABELLED others, none held out, in the
order of their ids; scoring reads whole texts of all documents.

Defined cases: null counts as empty; an empty text has the statistics of no words and is scored
like any other; a very long text is measured as a whole, in memory that grows with it; without
positives every document scores 0.5; rows that repeat a text score alike; an empty table gives no
rows; columns beside doc_id and text are never an input.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import given_back, held_out, table
from .samples import labelled, unlabelled

PER_CLASS, UNLABELLED = 10_000, 20_000
THRESHOLD = 0.3
HIDDEN, STEPS, BATCH, RATE, DECAY = 24, 1500, 512, 0.01, 1e-4
MARKS = b"#$%&*|!<>{}[]\\^~_=+@"
#: Bytes compressed at a time.
PIECE = 1 << 16


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float


def statistics(text: str) -> list[float]:
    """Numbers about a whole text; every one is bounded, or grows with the logarithm of the length."""
    raw = text.encode()
    n = len(raw)
    words = text.split()
    k = len(words)
    if not k:
        return [0.0] * 22
    bytes_of = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper = bytes_of[65:91].sum()
    lower = bytes_of[97:123].sum()
    counts = Counter(words)
    common = counts.most_common(3)
    number = {w: i for i, w in enumerate(counts)}
    turn = np.array([number[w] for w in words], np.int64)
    pairs = len(np.unique(turn[:-1] * len(number) + turn[1:]))
    runs = int((turn[:-1] == turn[1:]).sum())
    lines = [x.strip() for x in text.replace(".", "\n").split("\n")]
    lines = [x for x in lines if x]
    marked = sum(c for w, c in counts.items() if not w[-1].isalnum() and w[-1] not in ".,;:")
    single = sum(c for w, c in counts.items() if len(w) == 1)
    capital = sum(c for w, c in counts.items() if w[0].isupper())
    pieces = [raw[i : i + PIECE] for i in range(0, n, PIECE)]
    packed = sum(len(zlib.compress(p, 1)) for p in pieces)
    seen = set()
    again = 0
    for x in lines:
        if x in seen:
            again += len(x)
        seen.add(x)
    return [
        math.log1p(k),
        n / k / 8,
        upper / n,
        math.log1p(1000 * upper / n),
        lower / n,
        sum(bytes_of[b] for b in MARKS) / n,
        math.log1p(1000 * sum(bytes_of[b] for b in MARKS) / n),
        math.log1p(1000 * bytes_of[48:58].sum() / n),
        math.log1p(1000 * bytes_of[124] / n),
        math.log1p(1000 * bytes_of[33] / n),
        bytes_of[46] / k,
        bytes_of[44] / k,
        len(counts) / k,
        math.log(len(counts)) / math.log(k + 1),
        pairs / max(1, k - 1),
        runs / k,
        common[0][1] / k,
        sum(c for _, c in common) / k,
        again / max(1, n),
        packed / n,
        marked / k,
        capital / k + single / k,
    ]


def standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / scale, -6, 6)


def forward(model: Model, x: np.ndarray) -> np.ndarray:
    h = np.tanh(standard(x, model.mean, model.scale) @ model.w1 + model.b1)
    return h @ model.w2 + model.b2


Weights = list[np.ndarray]


def network(theta: Weights, x: np.ndarray) -> np.ndarray:
    return np.tanh(x @ theta[0] + theta[1]) @ theta[2] + theta[3]


def sigmoid(g: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(g, -30, 30)))


def back(theta: Weights, x: np.ndarray, slope: Callable[[np.ndarray], np.ndarray]) -> Weights:
    """The gradient of a sum over rows whose derivative by g is slope(g)."""
    h = np.tanh(x @ theta[0] + theta[1])
    e = slope(h @ theta[2] + theta[3])
    eh = np.outer(e, theta[2]) * (1 - h * h)
    return [x.T @ eh, eh.sum(0), h.T @ e, np.array([e.sum()])]


def risk(theta: Weights, xp: np.ndarray, xu: np.ndarray, prior: float) -> tuple[float, float]:
    """pi E_p[l(g)] and E_u[l(-g)] - pi E_p[l(-g)], with l(g) = log(1 + exp(-g))."""
    gp, gu = network(theta, xp), network(theta, xu)
    return prior * np.logaddexp(0, -gp).mean(), np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()


def risk_gradient(theta: Weights, xp: np.ndarray, xu: np.ndarray, prior: float) -> Weights:
    """Of the sum of both terms, or of the second term taken negative where that is below zero."""
    of_u = back(theta, xu, lambda g: sigmoid(g) / len(xu))
    of_p = back(theta, xp, lambda g: -prior * sigmoid(g) / len(xp))
    if risk(theta, xp, xu, prior)[1] < 0:
        return [-(a + b) for a, b in zip(of_u, of_p, strict=True)]
    of_good = back(theta, xp, lambda g: prior * (sigmoid(g) - 1) / len(xp))
    return [a + b + c for a, b, c in zip(of_u, of_p, of_good, strict=True)]


def telling_gradient(theta: Weights, xp: np.ndarray, xu: np.ndarray, _: float) -> Weights:
    """Of E_p[l(g)] + E_u[l(-g)], which tells positives from unlabelled rows."""
    both = back(theta, xp, lambda g: (sigmoid(g) - 1) / len(xp)), back(theta, xu, lambda g: sigmoid(g) / len(xu))
    return [a + b for a, b in zip(*both, strict=True)]


def train(positive: np.ndarray, other: np.ndarray, prior: float, gradient: Callable = risk_gradient, seed: int = 5) -> Model:
    """Adam over minibatches of positives and unlabelled rows; the weights are the mean of the second half of the steps."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([positive, other])
    mean, scale = both.mean(0), both.std(0) + 1e-6
    p, u = standard(positive, mean, scale), standard(other, mean, scale)
    d = p.shape[1]
    theta = [rng.normal(0, 1 / math.sqrt(d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / math.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    average = [np.zeros_like(t) for t in theta]
    for step in range(1, STEPS + 1):
        xp = p[rng.integers(0, len(p), min(BATCH, len(p)))]
        xu = u[rng.integers(0, len(u), 2 * BATCH)]
        rate = RATE * (1 - step / (STEPS + 1))
        for i, g in enumerate(gradient(theta, xp, xu, prior)):
            g = g + DECAY * theta[i]
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            theta[i] = theta[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        if step > STEPS // 2:
            average = [a + t / (STEPS - STEPS // 2) for a, t in zip(average, theta, strict=True)]
    return Model(mean, scale, average[0], average[1], average[2], float(average[3][0]), prior)


def class_prior(positive: np.ndarray, other: np.ndarray, delta: float = 0.1, gamma: float = 0.01) -> float:
    """The share of positives among the others, by the best bin.

    A classifier between the two is fitted on every other row of each; on the rest, that threshold is
    taken whose share of others over its share of positives is surely lowest. It is one row of the
    others at least and all of them at most; from fewer than four rows of either kind it is 0.5.
    """
    if min(len(positive), len(other)) < 4:
        return 0.5
    model = train(positive[::2], other[::2], 0.5, telling_gradient)
    p, u = np.sort(forward(model, positive[1::2])), np.sort(forward(model, other[1::2]))
    of_p = 1 - np.arange(len(p)) / len(p)
    of_u = 1 - np.searchsorted(u, p) / len(u)
    error = math.sqrt(math.log(4 / delta) / 2 / len(u)) + math.sqrt(math.log(4 / delta) / 2 / len(p))
    at = int(((of_u + (1 + gamma) * error) / of_p).argmin())
    return min(1.0, max(1 / len(u), float(of_u[at] / of_p[at])))


def measured(rows: DataFrame, columns: str) -> pd.DataFrame:
    """The statistics of a bounded sample, with the named columns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.drop(columns="text").assign(x=[statistics(t) for t in pdf["text"]])

    return rows.mapInPandas(given_back(run), f"{columns}, x array<double>").toPandas()


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, others: int = UNLABELLED) -> Model | None:
    good = measured(labelled(docs, labels, "quality", per_class, classes=(1,)).select("doc_id", "text"), "doc_id bigint")
    web = measured(unlabelled(docs, others).select("doc_id", "text"), "doc_id bigint")
    if good.empty or web.empty:
        return None
    # in one order, however the rows came
    good, web = (np.array(sorted((i, *x) for i, x in zip(d["doc_id"], d["x"], strict=True)))[:, 1:] for d in (good, web))
    return train(good, web, class_prior(good, web))


def scorer(model: Model | None):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            if model is None:
                yield pd.Series(0.5, index=texts.index)
            elif len(texts):
                g = forward(model, np.array([statistics(t) for t in texts.fillna("")]))
                yield pd.Series(1 / (1 + np.exp(-np.clip(g, -30, 30))))

    def code(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return given_back(run)(batches)

    return F.pandas_udf(code, "double")


def score_documents(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scorer(model)("text").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
