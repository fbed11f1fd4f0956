"""Empty tables, very long texts, statistics and sums against plain counts."""

import math
import zlib
from itertools import pairwise

import numpy as np
import pytest

from siltstone.llm import jaccard_join, mixing, quality, suffix_dedup, token_counts, toxicity
from tests.llm.test_text_operators import BPE, docs_of

LABELS = "doc_id bigint, quality int, toxic int"


def test_empty_tables(spark):
    none, labels = docs_of(spark, []), spark.createDataFrame([], LABELS)
    assert quality.score_documents(none, quality.fit(none, labels)).count() == 0
    assert toxicity.score_documents(none, toxicity.fit(none, labels)).count() == 0
    assert token_counts.count_tokens(none, BPE).count() == 0
    some = docs_of(spark, [(1, "a text"), (2, None), (None, "")])
    got = quality.score_documents(some, quality.fit(some, labels)).collect()
    assert len(got) == 3 and all(r.score == 0.5 and r.predicted == 1 for r in got)
    got = toxicity.score_documents(some, toxicity.fit(some, labels)).collect()
    assert len(got) == 3 and all(0 <= r.score <= 1 and r.predicted == 0 for r in got)


def test_very_long_texts(spark):
    base = " ".join(f"w{i % 5003}" for i in range(250_000))
    rows = [(i, f"plain text number {i} of some words, all of them clean.") for i in range(1, 60)] + [(i, "vile slur filth " * 3 + f"{i}") for i in range(60, 90)]
    rows += [(1000, base), (1001, base + " end"), (1002, "x" * 2_000_000), (1003, base + " vile slur filth" * 200)]
    docs = docs_of(spark, rows).repartition(3)
    labels = spark.createDataFrame([(i, int(i < 60), int(i >= 60)) for i in range(1, 90)], LABELS)
    got = {r.doc_id: r for r in toxicity.score_documents(docs, toxicity.fit(docs, labels)).collect()}
    assert got[1003].score > got[1000].score and got[1000].predicted == 0 and got[1003].predicted == 1
    got = {r.doc_id: r.score for r in quality.score_documents(docs, quality.fit(docs, labels)).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    got = {r.doc_id: r.component_id for r in jaccard_join.classes(docs, 5, 80).collect()}
    assert got[1001] == got[1003] == 1000 and got[1002] == 1002
    sizes = {r.doc_id: r["size"] for r in mixing.mix(spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id bigint, text string, source string")).collect()}
    assert (sizes[1000], sizes[1001], sizes[1002]) == (250_000, 250_001, 1)
    removed = {r.doc_id: r for r in suffix_dedup.without_repeats(docs_of(spark, rows[-4:])).collect()}
    assert len(base) <= removed[1001].n_removed <= len(base) + 1 and removed[1002].n_removed == 0 and removed[1003].n_removed >= len(base)


def test_statistics_equal_plain_counts():
    text = "The cat sat. The cat ran! | A dog & The cat sat.\nThe cat sat 12 34 # x x x"
    words, lines = text.split(), [s for s in (x.strip() for x in text.replace(".", "\n").split("\n")) if s]
    n, k = len(text.encode()), len(words)
    top = sorted((words.count(w) for w in set(words)), reverse=True)
    per = lambda chars: sum(text.count(c) for c in chars)
    upper, marks = sum(c.isupper() for c in text), per("#$%&*|!<>{}[]\\^~_=+@")
    again = sum(len(x) for i, x in enumerate(lines) if x in lines[:i])
    want = [
        math.log1p(k), n / k / 8, upper / n, math.log1p(1000 * upper / n), sum(c.islower() for c in text) / n, marks / n, math.log1p(1000 * marks / n), math.log1p(1000 * per("0123456789") / n), math.log1p(1000 * per("|") / n), math.log1p(1000 * per("!") / n),
        per(".") / k, per(",") / k, len(set(words)) / k, math.log(len(set(words))) / math.log(k + 1), len(set(pairwise(words))) / (k - 1), sum(a == b for a, b in pairwise(words)) / k, top[0] / k, sum(top[:3]) / k, again / n, len(zlib.compress(text.encode(), 1)) / n,
        sum(not w[-1].isalnum() and w[-1] not in ".,;:" for w in words) / k, sum(w[0].isupper() for w in words) / k + sum(len(w) == 1 for w in words) / k,
    ]
    assert quality.statistics(text) == pytest.approx(want)
    assert quality.statistics("") == quality.statistics(" \n") == [0.0] * 22


def test_evidence_of_several_segments_is_the_best_sum():
    """Of the r best segments, -ln of exp(-t) t**(r-1) / (r! (r-1)!), for the r that is least likely by chance."""
    rng = np.random.default_rng(5)
    model = toxicity.Model({}, -0.1, lam=0.7, k=2e-3)
    for _ in range(50):
        n, scores = int(rng.integers(50, 5000)), sorted(rng.uniform(2, 25, rng.integers(1, 7)), reverse=True)
        best = 0.0
        for r in range(1, len(scores) + 1):
            t = sum(0.7 * s - math.log(2e-3 * n) for s in scores[:r])
            if t <= 0:
                break
            best = max(best, t - (r - 1) * math.log(max(t, 1.0)) + math.log(math.factorial(r)) + math.log(math.factorial(r - 1)))
        assert toxicity.evidence(n, [(0, 0, s) for s in scores], model) == pytest.approx(best)
