"""Toxicity by maximum-scoring segments.

A word's score is the log-odds, between toxic and clean documents, of the word itself or of one of
its beginnings (inflected and compound forms share those), whichever is farthest from 0, under an
informative Dirichlet prior (the pooled frequencies of the sample). Log-odds of either sign count
that are clear of their own error, by more than chance gives the best of so many terms, and every word pays a small drift. One linear scan over a
document's scores finds all maximal-scoring segments. Scores follow Karlin-Altschul statistics: lambda solves
E[exp(lambda s)] = 1 on clean words, K is set by the segments clean documents have, and a
document's segments together give one -ln p, which a logistic curve turns into a probability.

Fitting reads at most PER_CLASS labelled documents of each class, none held out; everything
else reads whole texts of all documents. The lexicon is every term of the sample whose log-odds are
significant, which the sample bounds.

Defined cases: null counts as empty; a text without words has no segments and the score of a
document with no evidence; a very long text is scanned whole; without labels of both classes every
document scores 0; rows that repeat a text score alike; an empty table gives no rows; columns beside
doc_id and text are never an input.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import given_back, held_out, table
from .samples import labelled

PER_CLASS = 5_000
#: Lengths of the beginnings of words that count as terms; a whole word ends in END.
STEMS, END = range(3, 9), "$"
#: Weight of the Dirichlet prior as a share of the sample, and documents of a term that can be significant.
PRIOR, LEAST_DOCS = 0.2, 5
THRESHOLD = 0.5
KNOWN = 100_000
WORDS = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    scores: dict[str, float]
    drift: float
    lam: float = 1.0
    k: float = 1e-4
    slope: float = 1.0
    shift: float = 0.0
    fitted: bool = True
    #: Scores of words met so far, forgotten when there are KNOWN of them.
    known: dict[str, float] = field(default_factory=dict)

    def score(self, word: str) -> float:
        get = self.scores.get
        return max([get(word + END, 0.0), *[get(word[:k], 0.0) for k in STEMS if k < len(word)]], key=abs)


def term_counts(sample: DataFrame) -> DataFrame:
    """term, y1, y0: toxic and clean documents of the sample with the term; equal texts count once."""
    once = sample.groupBy(F.sha2("text", 256).alias("sha")).agg(F.max(F.struct("label", "text")).alias("d"))
    words = F.array_distinct(F.regexp_extract_all(F.lower("d.text"), F.lit(r"\p{L}+"), F.lit(0)))
    terms = F.array_distinct(F.concat(F.transform(words, lambda w: F.concat(w, F.lit(END))), *[stems(words, k) for k in STEMS]))
    rows = once.select(F.col("d.label").alias("label"), F.explode(terms).alias("term"))
    return rows.groupBy("term").agg(F.sum("label").alias("y1"), F.sum(1 - F.col("label")).alias("y0"))


def stems(words: Column, k: int) -> Column:
    """The first k letters of the words that have more."""
    return F.transform(F.filter(words, lambda w: F.length(w) > k), lambda w: F.substring(w, 1, k))


def log_odds(counts: DataFrame, prior: float, least_z: float | None = None) -> DataFrame:
    """The terms whose log-odds are least_z errors from 0, on either side: term, score, z, y1, y0, n1, n0.

    By default that is sqrt(2 ln m), about the largest of m chance values, for the m terms of LEAST_DOCS documents.
    """
    tried = F.greatest(F.lit(2), F.count_if(F.col("y1") + F.col("y0") >= LEAST_DOCS))
    bound = F.sqrt(2 * F.log(tried.cast("double"))) if least_z is None else F.lit(float(least_z))
    totals = counts.agg(F.sum("y1").alias("n1"), F.sum("y0").alias("n0"), bound.alias("bound"))
    rows = counts.join(F.broadcast(totals))
    a0 = F.lit(prior) * (F.col("n1") + F.col("n0"))
    a = F.lit(prior) * (F.col("y1") + F.col("y0"))
    top = F.log((F.col("y1") + a) / (F.col("n1") + a0 - F.col("y1") - a))
    rest = F.log((F.col("y0") + a) / (F.col("n0") + a0 - F.col("y0") - a))
    error = F.sqrt(1.0 / (F.col("y1") + a) + 1.0 / (F.col("y0") + a))
    rows = rows.withColumn("score", top - rest).withColumn("z", F.col("score") / error)
    return rows.where(F.abs("z") >= F.col("bound")).drop("bound")


def segments(values: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first and last word, score) of a sequence in which the words named
    score as given (above 0 or not) and all others drift; linear in the named words.

    Each candidate keeps the sums before and up to its end, and which earlier candidate is the last
    with a lower sum before it; a candidate that ends higher than that one joins with it.
    """
    found: list[tuple[int, int, float, float, int]] = []
    raised = 0.0
    for at, s in values:
        low = drift * at + raised
        raised += s - drift
        if s <= 0:
            continue
        high = low + s
        first = at
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= high:
                break
            first, low = found[j][0], found[j][2]
            del found[j:]
            j -= 1
        found.append((first, at, low, high, j))
    return [(a, b, high - low) for a, b, low, high, _ in found]


def hits(text: str, model: Model) -> tuple[int, list[tuple[int, float]]]:
    """The number of words, and the positions and scores of those that score."""
    words = WORDS.findall(text.lower())
    known = model.known
    out = []
    for i, w in enumerate(words):
        s = known.get(w)
        if s is None:
            if len(known) >= KNOWN:
                known.clear()
            s = known[w] = model.score(w)
        if s:
            out.append((i, s))
    return len(words), out


def measure(text: str, model: Model) -> tuple[int, list[tuple[int, int, float]]]:
    """The number of words, and the segments."""
    n, found = hits(text, model)
    return n, segments([(i, s + model.drift) for i, s in found], model.drift) if found else []


def evidence(n: int, found: list[tuple[int, int, float]], model: Model) -> float:
    """-ln p of a document's best segments together, 0 if it has none (Karlin and Altschul's sum statistic)."""
    best, total = 0.0, 0.0
    for r, s in enumerate(sorted((s for *_, s in found), reverse=True), 1):
        total += model.lam * s - math.log(max(model.k * n, 1e-12))
        if total <= 0:
            break
        # P(sum of r) is about exp(-t) t**(r-1) / (r! (r-1)!)
        best = max(best, total - (r - 1) * math.log(max(total, 1.0)) + math.lgamma(r + 1) + math.lgamma(r))
    return best


def solve_lambda(drift: float, n: int, clean: np.ndarray) -> float:
    """The positive root of E[exp(lambda s)] = 1 over n clean words; clean holds the scores of those that have one.

    The bracket grows until the sign changes, which it does where some word scores above 0; else the root is infinite.
    """
    if not len(clean) or clean.max() + drift <= 0:
        return math.inf

    def over(lam: float) -> float:
        with np.errstate(over="ignore"):
            return (1 - len(clean) / n) * math.exp(lam * drift) + float(np.exp(lam * (clean + drift)).sum()) / n - 1

    low, high = 1e-3, 1.0
    while over(high) < 0:
        low, high = high, 2 * high
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if over(mid) < 0 else (low, mid)
    return high


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and shift of a regularised logistic curve, both classes of equal weight, by damped Newton steps."""
    w = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    xs = np.stack([x, np.ones_like(x)], 1)
    ridge = np.array([1e-4, 1e-4])

    def loss(t: np.ndarray) -> float:
        g = xs @ t
        return float((w * (np.logaddexp(0, g) - y * g)).sum() + (ridge * t * t).sum() / 2)

    t = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(xs @ t, -30, 30)))
        step = np.linalg.solve((xs.T * (w * p * (1 - p))) @ xs + np.diag(ridge), xs.T @ (w * (p - y)) + ridge * t)
        size = 1.0
        while size > 1e-6 and loss(t - size * step) > loss(t):
            size /= 2
        t = t - size * step
        if np.abs(size * step).max() < 1e-7:
            break
    return max(float(t[0]), 1e-3), float(t[1])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    sample = labelled(docs, labels, "toxic", per_class)
    lexicon = log_odds(term_counts(sample), PRIOR).toPandas()
    if lexicon.empty:
        return Model({}, -1.0, fitted=False)
    model = Model(dict(zip(lexicon["term"], lexicon["score"].astype(float), strict=True)), -1.0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [hits(t, model) for t in pdf["text"]]
            yield pd.DataFrame({"label": pdf["label"], "n": [n for n, _ in got], "at": [[i for i, _ in h] for _, h in got], "s": [[s for _, s in h] for _, h in got]})

    seen = sample.mapInPandas(given_back(run), "label int, n bigint, at array<bigint>, s array<double>").toPandas()
    y = seen["label"].to_numpy()
    n1, n0 = (int(seen["n"][y == c].sum()) for c in (1, 0))
    of1, of0 = (np.array([x for s in seen["s"][y == c] for x in s]) for c in (1, 0))
    if not n1 or not n0 or not (of1 > 0).any():
        return Model({}, -1.0, fitted=False)
    # one chance hit stands for what a finite sample of clean text can't show
    usual = float(np.median(of1[of1 > 0]))
    of0 = np.append(of0, usual)
    rho1 = min(0.5, float((of1 > 0).sum()) / n1)
    model.drift = math.log((1 - rho1) / (1 - min(rho1 / 2, float((of0 > 0).sum()) / n0)))
    model.lam = solve_lambda(model.drift, n0, of0)
    if math.isinf(model.lam):
        return Model({}, -1.0, fitted=False)
    found = [segments([(int(i), v + model.drift) for i, v in zip(at, s, strict=True)], model.drift) for at, s in zip(seen["at"], seen["s"], strict=True)]
    typical = usual + model.drift
    chance = sum(v >= typical for f, c in zip(found, y, strict=True) if c == 0 for *_, v in f)
    model.k = (0.5 + chance) * math.exp(model.lam * typical) / n0
    x = np.array([evidence(int(n), f, model) for n, f in zip(seen["n"], found, strict=True)])
    model.slope, model.shift = logistic(x, y.astype(float))
    return model


def probability(text: str, model: Model) -> float:
    x = evidence(*measure(text, model), model)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, model.slope * x + model.shift))))


def scorer(model: Model):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.fillna("").map(lambda t: probability(t, model) if model.fitted else 0.0).astype("float64")

    def code(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return given_back(run)(batches)

    return F.pandas_udf(code, "double")


def passages(docs: DataFrame, model: Model, least: float = 3.0) -> DataFrame:
    """doc_id and each significant passage: first and last word, score, -ln p (of that segment alone), text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                n, found = measure(text, model)
                spans = [m.span() for m in WORDS.finditer(text.lower())] if found else []
                for a, b, s in found:
                    x = evidence(n, [(a, b, s)], model)
                    if x >= least:
                        rows.append((doc_id, a, b, s, x, text[spans[a][0] : spans[b][1]]))
            yield pd.DataFrame(rows, columns=["doc_id", "first_word", "last_word", "score", "evidence", "passage"])

    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"doc_id {kind}, first_word bigint, last_word bigint, score double, evidence double, passage string")


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scorer(model)("text").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that are not rejected, with all their columns."""
    return docs.where(scorer(model)(F.col("text")) < threshold)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
