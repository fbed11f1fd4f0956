"""Source divergence, fast similarity sketching, whitening: SQL on small tables, brute force, definitions."""

import math
import random
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from siltstone.llm import divergence, fast_minhash, jaccard_join, whitening
from tests.llm.test_text_operators import brute, docs_of, near_copies, prose

# --- source divergence


def by_sql(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    return sorted(con.execute(divergence.ORACLE).fetchall())


def of_sources(seed, n=400):
    rng = random.Random(seed)
    words = [f"{rng.choice(['a', 'É', 'x', 'Ω', '日'])}{rng.choice('bcdefg')}{rng.choice('hijk')}" for _ in range(60)]
    rows = []
    for i in range(n):
        source = rng.choice(["hot"] * 6 + ["a", "b", "B", "é", None, ""])
        some = words[: 20 + 5 * len(source or "")]
        rows.append((i, rng.choice([" ", "-", "1", "\x00"]).join(rng.choice(some) for _ in range(rng.randrange(30))), rng.choice(["en", "de", None]), source))
    return [*rows, (1, None, "en", "silent"), (1, "", "xx", "alone"), (1, "rare words here", "yy", "one"), (2, "rare words there", "yy", "two"), (None, "rare", "yy", None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_divergence_equals_sql(spark, monkeypatch, seed):
    if seed == 2:
        monkeypatch.setattr(divergence, "TILE", 2)
        monkeypatch.setattr(divergence, "HELD", 50)
        monkeypatch.setattr(divergence, "PIECE", 10)
    rows = of_sources(seed)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, lang string, source string, term string, p int").repartition(5)
    got = sorted(map(tuple, divergence.audit(docs).collect()))
    assert got == by_sql(rows)
    assert ("xx", "alone") not in {r[:2] for r in got} and ("yy", "one", "pair", "two", 0, 2) in got


def test_divergence_of_nothing_and_of_much(spark):
    schema = "doc_id bigint, text string, lang string, source string"
    assert divergence.audit(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "ab " * 300_000 + "cd", "en", "x"), (2, "ab cd", "en", "y"), (3, "cd AB" * 9, "en", "y")]
    assert sorted(map(tuple, divergence.audit(spark.createDataFrame(rows, schema)).collect())) == by_sql(rows)


# --- fast similarity sketching


def naive_sketch(s, t):
    from siltstone.llm.hashing import keys, mixed

    out = [None] * t
    for i, key in enumerate(keys(2 * t, 1301)):
        if None not in out:
            break
        for h in sorted(int(x) for x in mixed(s ^ key)):
            at = (h >> 32) * t >> 32 if i < t else i - t
            if out[at] is None or (out[at][0] == i and h < out[at][1]):
                out[at] = (i, h)
    return [h for _, h in out]


def test_sketches_follow_their_definition():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 2, 7, 40, 333, 2000)]
    rows = fast_minhash.sketches(sets)
    assert not (rows == fast_minhash.EMPTY).any()
    for t in (8, fast_minhash.T):
        assert fast_minhash.sketches(sets, t).tolist() == [naive_sketch(s, t) for s in sets]
    assert fast_minhash.sketches([]).shape == (0, fast_minhash.T)
    # a set's sketch doesn't depend on the sets beside it
    assert (fast_minhash.sketches(sets[2:3]) == rows[2]).all()


@pytest.mark.parametrize("n", [12, 100, 3000])
@pytest.mark.parametrize("j", [0.3, 0.85])
def test_coordinates_agree_as_often_as_sets_are_similar(n, j):
    """The mean of many pairs is near the similarity, and a single pair within five standard deviations of independent draws."""
    rng = np.random.default_rng(n)
    both, own = round(n * j), n - round(n * j)
    agreed = []
    for _ in range(60):
        x = np.unique(rng.integers(0, 2**63, both + own).astype(np.uint64))
        cut = both + own // 2
        a, b = fast_minhash.sketches([x[:cut], np.concatenate([x[:both], x[cut:]])])
        agreed.append((a == b).mean())
    real = both / (both + own)
    deviation = math.sqrt(real * (1 - real) / fast_minhash.T)
    assert abs(np.mean(agreed) - real) < 5 * deviation / math.sqrt(60)
    assert max(abs(np.array(agreed) - real)) < 5 * deviation


@pytest.mark.parametrize("seed, tile, long", [(1, 2048, 256), (2, 16, 20)])
def test_near_copies_equal_brute_force(spark, monkeypatch, seed, tile, long):
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    monkeypatch.setattr(fast_minhash, "LONG", long)
    rows = near_copies(seed)
    rng = random.Random(seed)
    base = prose(rng, 150, 10**6).split()
    for i in range(2000, 2090):
        w = list(base)
        for k in rng.sample(range(150), rng.randrange(4)):
            w[k] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows.append((3000, "long " + " ".join(str(k) for k in range(60_000))))
    rows.append((3001, " ".join(str(k) for k in range(60_000)) + " end"))
    want, sets = brute(rows, 5, 85)
    got = fast_minhash.classes(docs_of(spark, [*rows, (None, "w1 w2 w3 w4")]).repartition(5)).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        assert r.component_id == (None if r.doc_id is None else want[r.doc_id])
        assert r.doc_id is None or r.n_shingles in map(len, sets[r.doc_id])
        assert r.kept == (r.doc_id is not None and r.doc_id == r.component_id)
    assert want[3001] == 3000 and len({want[i] for i in range(2000, 2090)}) < 30


def test_no_documents(spark):
    assert fast_minhash.classes(docs_of(spark, [])).count() == 0


# --- whitening


SCHEMA = "vec_id bigint, embedding array<double>, x int, part string"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v if v is None else [None if c is None else float(c) for c in v], 1, "p") for i, v in rows], SCHEMA)


def skewed(rng, n, d, spread):
    mix = np.linalg.qr(rng.normal(size=(d, d)))[0]
    return rng.normal(size=(n, d)) * np.logspace(0, -spread, d) @ mix * 50 + 3e4


def exact_covariance(x):
    n, sums = len(x), [sum(map(int, c)) for c in x.T]
    y = [[n * int(c) - s for c, s in zip(row, sums, strict=True)] for row in x]
    d = x.shape[1]
    return np.array([[float(Fraction(sum(r[i] * r[j] for r in y), n**3)) for j in range(d)] for i in range(d)]), [sum(c * c for c in r) for r in y]


@pytest.mark.parametrize("d, spread, block", [(6, 2, 2048), (40, 3, 7)])
def test_whitening_equals_eigenvectors(spark, monkeypatch, d, spread, block):
    monkeypatch.setattr(whitening, "BLOCK", block)
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    v = skewed(np.random.default_rng(d), 150, d, spread)
    odd = [(900, None), (901, [None] * d), (902, [float("nan")] * d), (903, [float("inf")] * d), (904, [1.0]), (905, [])]
    rows = [*enumerate(v.tolist()), (3, v[5].tolist()), (None, v[6].tolist()), *odd]
    got = whitening.whiten(vectors_of(spark, rows).repartition(5)).collect()
    x = np.floor(64 * np.vstack([v, v[5:7]])).astype(np.int64) + 1_000_000
    n, k = len(x), min(32, d)
    covariance, deviations = exact_covariance(x)
    values, basis = np.linalg.eigh(covariance)
    values, basis = values[::-1][:k], basis[:, ::-1][:, :k]
    want = (x - x.mean(0)) @ basis / np.sqrt(values)
    assert len(got) == n * k and {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1
    assert 0 <= got[0].identity_error < 1e-9
    signs = {}
    for r in got:
        if r.vec_id not in (3, None):
            w = want[r.vec_id, r.component - 1]
            signs.setdefault(r.component, set()).add(np.sign(r.whitened * w) if abs(w) > 1e-3 else 0)
            assert abs(abs(r.whitened) - abs(w)) < 1e-6 and r.deviation == deviations[r.vec_id]
            assert abs(r.explained / (values[r.component - 1] / np.trace(covariance)) - 1) < 1e-9
    assert all(len(s - {0}) == 1 for s in signs.values())


def test_small_deviations_keep_their_digits():
    """Deviations 1e10 apart, far below what a covariance in doubles would keep."""
    rng = np.random.default_rng(8)
    a = np.linalg.qr(rng.normal(size=(300, 12)))[0] * np.logspace(0, -10, 12)
    lengths, v = whitening.jacobi(whitening.triangle(a))
    assert np.allclose(lengths, np.logspace(0, -10, 12), rtol=1e-9, atol=0)
    assert np.allclose(v.T @ v, np.eye(12), atol=1e-13)
    seen = [tuple(sorted(p)) for i, j in whitening.meetings(7) for p in zip(i.tolist(), j.tolist(), strict=True)]
    assert sorted(seen) == [(i, j) for i in range(7) for j in range(i + 1, 7)]


def test_whitening_of_odd_tables(spark):
    assert whitening.whiten(vectors_of(spark, [])).count() == 0
    assert whitening.whiten(vectors_of(spark, [(1, None), (2, [])])).count() == 0
    assert whitening.whiten(vectors_of(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    # one direction alone has a deviation; lengths 2 and 1 are equally common
    got = whitening.whiten(vectors_of(spark, [(1, [0.0, 2.0]), (2, [1.0, 2.0]), (3, [1.0]), (4, [2.0])])).orderBy("vec_id").collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained) for r in got] == [(1, 1, 2, 64**2, -1.0, 1.0), (2, 1, 2, 64**2, 1.0, 1.0)]
    # beyond the range of longs
    got = whitening.whiten(vectors_of(spark, [(1, [1e15]), (2, [-1e15]), (3, [1e15])])).orderBy("vec_id").collect()
    assert [r.deviation for r in got] == [2**63 - 1] * 3 and np.allclose([r.whitened for r in got], [0.5**0.5, -(2**0.5), 0.5**0.5])
