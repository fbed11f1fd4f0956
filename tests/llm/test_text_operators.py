"""Token counts, SentencePiece, Jaccard join, suffix dedup, search, classifiers: brute force, round trips, held-out accuracy."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest

from siltstone.llm import components, jaccard_join, quality, sentencepiece_codec, suffix_dedup, token_counts, topk, toxicity

EXTRA = "doc_id bigint, text string, key string, node bigint, block int, score double"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "k", 1, 2, 0.5) for i, t in rows], EXTRA)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# --- tokens


BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
HARD = ["", "a", "it's we'll I've", "x" * 70000, " " * 70000, "a1" * 40000, "\n\n  \t" * 20000, "é" * 50000, "日本語 😀 " * 12000, "word " * 9000 + "<|endoftext|>" + " more" * 9000, "<|endoftext|>", "ǆ ɐ ͅ x"]


def test_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BPE)
    rows = [*enumerate(HARD), (90, None), (None, "null id")]
    got = {r.doc_id: r for r in token_counts.count_tokens(docs_of(spark, rows), BPE).collect()}
    for i, t in rows:
        want = len(tok.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (want, len((t or "").encode()), want > 1024)


def test_splice_widens_until_aligned():
    """Small chunks and a pattern that seldom has common starts."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BPE)
    asked = []

    def one(piece):
        asked.append(len(piece))
        e = tok.encode(piece, add_special_tokens=False)
        return e.offsets, e.word_ids

    rng = random.Random(3)
    for _ in range(60):
        text = "".join(rng.choice(["ab", " ", "  ", "\n", "12", "'s", "é", "x" * rng.randrange(80)]) for _ in range(rng.randrange(400)))
        assert token_counts.splice(text, one, chunk=40, overlap=8, guard=4) == len(tok.encode(text, add_special_tokens=False).ids)
    assert len(set(asked)) > 50


def test_model_files_count_with_sentencepiece(spark):
    assert [r.n_tokens for r in token_counts.count_tokens(docs_of(spark, [(1, "hello world")]), PIECES).collect()] == [3]


def test_codec_parity_and_round_trip(spark):
    import sentencepiece

    reference = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = [*enumerate([t[:3000] for t in HARD] + ["   a    b", "<s> </s> <unk> <0x41>", "\x00\x01", "ﬁ Å"]), (90, None)]
    out = sentencepiece_codec.encoded(docs_of(spark, rows), PIECES)
    assert out.columns[:3] == ["doc_id", "text", "key"]
    back = {r.doc_id: r for r in sentencepiece_codec.decoded(out, PIECES).collect()}
    for i, t in rows:
        assert back[i].token_ids == reference.encode(t or "") and back[i].parity in (True, None)
        assert back[i].round_trip and back[i].decoded_text == (t or "")
    ours, parity = sentencepiece_codec.encode([t or "" for _, t in rows], PIECES, one_in=1)
    assert all(parity) and ours == reference.encode([t or "" for _, t in rows])


def test_codec_verifies_every_text(monkeypatch):
    texts = [f"plain words number {i} and no more" for i in range(40)] + ["", "a  b", " a", "a ", "line\nbreak", "é ▁ x"]
    _, reference, *rest = sentencepiece_codec.load(PIECES, 2)
    ids, parity = sentencepiece_codec.encode(texts, PIECES)
    assert all(p is True for p in parity) and ids == reference.encode(texts)
    right = sentencepiece_codec.load(PIECES, 2)

    class Wrong:
        """Loses the last id of what holds the word odd."""

        def encode_batch_fast(self, some, **_):
            found = right[0].encode_batch_fast(some, add_special_tokens=False)
            return [type("E", (), {"ids": e.ids[:-1] if "odd" in t else e.ids}) for e, t in zip(found, some, strict=True)]

    monkeypatch.setattr(sentencepiece_codec, "load", lambda *_: (Wrong(), *right[1:]))
    texts = [f"an odd number {i}" for i in range(20)] + ["an even number"]
    ids, parity = sentencepiece_codec.encode(texts, PIECES)
    assert parity == [False] * 20 + [True] and ids == [x[:-1] for x in reference.encode(texts[:20])] + reference.encode(texts[20:])


def test_codec_encodes_a_word_once(monkeypatch):
    """Texts of known words cost neither library a call; the words' memory is bounded, and long words are not kept."""
    tok, reference = sentencepiece_codec.load(PIECES, 2)
    asked = []

    class Counting:
        def encode_batch_fast(self, some, **_):
            asked.extend(some)
            return tok.encode_batch_fast(some, add_special_tokens=False)

    monkeypatch.setattr(sentencepiece_codec, "load", lambda *_: (Counting(), reference))
    monkeypatch.setattr(sentencepiece_codec, "WORDS", 50)
    known = sentencepiece_codec.verified(PIECES)[1]
    known.clear()
    texts = ["once more twice more", "twice once", "é\tñ 漢字 once", "y" * 100 + " once", "", "twice  once"]
    want = reference.encode(texts)
    assert sentencepiece_codec.encode(texts, PIECES) == (want, [True] * 6)
    asked.clear()
    assert sentencepiece_codec.encode(texts, PIECES) == (want, [True] * 6) and sorted(asked) == ["twice  once", "y" * 100]
    for k in range(20):
        many = [f"w{k}x{i} once" for i in range(20)]
        assert sentencepiece_codec.encode(many, PIECES) == (reference.encode(many), [True] * 20) and len(known) <= 50


def test_codec_work_grows_with_distinct_words(monkeypatch):
    """New words go through the libraries many at once, and the ids of a part's words are decoded once, not those of its texts."""
    tok, reference = sentencepiece_codec.load(PIECES, 2)
    asked, told = [], []

    class Counting:
        def encode_batch_fast(self, some, **_):
            asked.extend(some)
            return tok.encode_batch_fast(some, add_special_tokens=False)

        def decode_batch(self, some, **_):
            told.extend(some)
            return tok.decode_batch(some, skip_special_tokens=False)

    monkeypatch.setattr(sentencepiece_codec, "load", lambda *_: (Counting(), reference))
    sentencepiece_codec.verified(PIECES)[1].clear()
    rng = random.Random(8)
    texts = [" ".join(f"term{rng.randrange(300)}" for _ in range(400)) for _ in range(20)]
    words = {w for t in texts for w in t.split(" ")}
    assert sentencepiece_codec.encode(texts, PIECES) == (reference.encode(texts), [True] * 20)
    assert len(asked) <= 10 and Counter(" ".join(asked).split(" ")) == Counter(words)
    ids, parity, trip = sentencepiece_codec.coded(pa.array(texts), PIECES)
    assert ids.to_pylist() == reference.encode(texts) and parity.all() and trip.all()
    assert sum(map(len, told)) == sum(map(len, reference.encode(list(words))))


def test_codec_words_and_whole_texts_keep_their_places(monkeypatch):
    """Blanks, markers, empty and long texts among plain ones, in parts of any size, words that differ or are decoded to something else."""
    tok, reference = sentencepiece_codec.load(PIECES, 2)
    rng = random.Random(9)
    pieces = ["ab", "the", "\n", "\t", " ", " ", "  ", "▁", "é", "e\u0301", "漢字", "😀", "\x00", "\u00a0", "\ue000", "<s>", "<0x20>", "x" * 90, ""]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(12))) for _ in range(400)] + ["", " ", "▁", "a", "", "plain words", "z " * 50000 + "z"]
    want, array = reference.encode(texts), pa.array(["none", *texts])[1:]
    assert sum(map(bool, sentencepiece_codec.odd(array))) not in (0, len(texts))
    for most, joined in ((1, 128), (7, 2), (500, 128)):
        monkeypatch.setattr(sentencepiece_codec, "JOINED", joined)
        sentencepiece_codec.verified(PIECES)[1].clear()
        done = [sentencepiece_codec.coded(array[some], PIECES) for some in sentencepiece_codec.parts([1] * len(texts), most, 1000)]
        assert [x for ids, *_ in done for x in ids.to_pylist()] == want
        assert all(parity.all() for _, parity, _ in done)
        assert [x for *_, trip in done for x in trip.tolist()] == [b == t for b, t in zip(tok.decode_batch(want, skip_special_tokens=False), texts, strict=True)]

    class Off:
        """Loses the last id of what holds differs, and decodes spoilt to spoiled."""

        def encode_batch_fast(self, some, **_):
            found = tok.encode_batch_fast(some, add_special_tokens=False)
            return [type("E", (), {"ids": e.ids[:-1] if "differs" in t else e.ids}) for e, t in zip(found, some, strict=True)]

        def decode_batch(self, some, **_):
            return [t.replace("spoilt", "spoiled") for t in tok.decode_batch(some, skip_special_tokens=False)]

    monkeypatch.setattr(sentencepiece_codec, "load", lambda *_: (Off(), reference))
    sentencepiece_codec.verified(PIECES)[1].clear()
    texts = ["all is well", "one differs", "", "one spoilt", "well spoilt  one", "all differs  well", "is well"]
    ids, parity, trip = sentencepiece_codec.coded(pa.array(texts), PIECES)
    assert parity.tolist() == ["differs" not in t for t in texts]
    assert ids.to_pylist() == [x[:-1] if "differs" in t else x for x, t in zip(reference.encode(texts), texts, strict=True)]
    assert trip.tolist() == ["differs" not in t and "spoilt" not in t for t in texts]
    sentencepiece_codec.verified(PIECES)[1].clear()


def test_unigram_models_are_rebuilt():
    spec = sentencepiece_codec.Spec([("<unk>", 0.0, 2), ("▁a", -1.0, 1), ("b", -2.0, 1), ("▁ab", -2.5, 1), ("<0x63>", -9.0, 6)], sentencepiece_codec.UNIGRAM, True)
    assert sentencepiece_codec.build(spec).encode("  ab  a ").tokens == ["▁ab", "▁a"]


def test_bytes_that_are_no_text_decode():
    assert sentencepiece_codec.decode([[3 + 0xE2]], PIECES) == ["�"]


# --- near copies and components


def brute(rows, width, percent):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    sets = {}
    for i, t in rows:
        w = word.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets.setdefault(i, []).append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
            up[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in sets}, sets


def near_copies(seed, n=40):
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.choice([2, 3, 12, 60, 300]))) for i in range(n)]
    for i in range(n, 3 * n):
        w = rows[rng.randrange(len(rows))][1].split()
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(9)}"
        rows.append((i, " ".join(w) if i % 3 else " \t".join(w).upper()))
    base = prose(rng, 100).split()  # a star: copies that differ from each other twice as much as from the first
    for i in range(3 * n, 4 * n):
        w = list(base)
        w[rng.randrange(2, 98)] = f"z{i}"
        w[rng.randrange(2, 98)] = f"y{i}"
        rows.append((i, " ".join(w)))
    return [*rows, (4 * n, " ".join(base)), (900, None), (901, ""), (902, " \n"), (3, "another text of the same id")]


@pytest.mark.parametrize("seed, width, percent", [(1, 3, 90), (2, 5, 80), (3, 3, 60)])
def test_components_equal_brute_force(spark, seed, width, percent):
    rows = near_copies(seed)
    want, sets = brute(rows, width, percent)
    got = jaccard_join.classes(docs_of(spark, [*rows, (None, "w1 w2 w3 w4")]).repartition(5), width, percent).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        assert r.component_id == (None if r.doc_id is None else want[r.doc_id])
        assert r.doc_id is None or r.n_shingles in map(len, sets[r.doc_id])


def test_one_of_each_stays(spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "x y z u v w q"), (4, None)]
    docs = docs_of(spark, rows)
    out = jaccard_join.keep_one_of_each(docs)
    assert out.schema == docs.schema and {r.doc_id for r in out.collect()} == {1, 3, 4}
    assert jaccard_join.classes(docs.where("false")).count() == 0


def test_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(1)
    for n in (5, 50, 700, 3000, 9000):
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[: n // 2], rng.integers(0, 2**63, n // 3).astype(np.uint64)]))
        both = jaccard_join.Sketches([jaccard_join.sketch(x), jaccard_join.sketch(y), None])
        assert 0 < both.apart(np.array([0]), np.array([1]))[0] <= len(np.setxor1d(x, y))
        assert both.apart(np.array([0, 2]), np.array([2, 1])).tolist() == [0, 0]


@pytest.mark.parametrize("tile, short", [(16, 8), (4, 2)])
def test_long_lists_in_tiles_and_groups(spark, monkeypatch, tile, short):
    """Lists above the tile size; sets that share prefix and size, some of which are linked only through others."""
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    monkeypatch.setattr(jaccard_join, "SHORT", short)
    rng = random.Random(9)
    rows = []
    for f in range(3):
        base = prose(rng, 60, 10**6).split()
        for _ in range(45):
            w = list(base)
            for k in rng.sample(range(60), rng.randrange(5)):
                w[k] = rng.choice(["changed", f"x{rng.randrange(10**6)}"])
            rows.append((len(rows), " ".join(w)))
    rng.shuffle(rows)
    want, _ = brute(rows, 3, 75)
    for common in (True, False):
        if not common:
            monkeypatch.setattr(jaccard_join, "common_shingles", lambda *_: np.zeros(0, np.uint64))
        got = {r.doc_id: r.component_id for r in jaccard_join.classes(docs_of(spark, rows), 3, 75).collect()}
        assert got == want


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 102), (101, 102)] + [(200, i) for i in range(201, 260)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {i: 0 for i in range(1, 31)} | {101: 100, 102: 100} | {i: 200 for i in range(201, 260)}


# --- repeated passages


def removed(rows, length=50):
    seen, out = set(), {}
    for i, t in sorted(((i, (t or "").encode()) for i, t in rows if i is not None)):
        gone, own = bytearray(len(t)), set()
        for p in range(len(t) - length + 1):
            if t[p : p + length] in seen:
                gone[p : p + length] = b"\x01" * length
            own.add(t[p : p + length])
        seen |= own
        runs = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(t), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest())
    return out


def passages(seed):
    rng = random.Random(seed)
    shared = [prose(rng, k) for k in (8, 12, 30, 200)] + ["ab" * 60, "\x00" * 70, "é" * 40]
    rows = []
    for i in range(60):
        parts = [prose(rng, rng.randrange(60)) for _ in range(4)]
        for _ in range(rng.randrange(3)):
            parts.insert(rng.randrange(len(parts)), rng.choice(shared))
        rows.append((i, " ".join(parts)))
    return [*rows, (100, rows[5][1]), (101, rows[5][1]), (102, rows[7][1][:49]), (103, rows[7][1][:50]), (104, None), (105, ""), (106, "a" * 200), (107, "a" * 60)]


@pytest.mark.parametrize("seed, shard", [(1, 4 << 20), (2, 3000)])
def test_removal_equals_brute_force(spark, monkeypatch, seed, shard):
    monkeypatch.setattr(suffix_dedup, "SHARD", shard)
    rows = passages(seed)
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.without_repeats(docs_of(spark, rows).repartition(7)).collect()}
    assert got == removed(rows)


def test_removal_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 4000)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1000)
    rows = passages(3)
    got = suffix_dedup.without_repeats(docs_of(spark, [*rows, (None, rows[5][1])]))
    assert {r.doc_id: tuple(r)[1:] for r in got.collect() if r.doc_id is not None} == removed(rows)
    texts = {r.doc_id: r.text for r in suffix_dedup.without_repeats(docs_of(spark, rows), suffix_dedup.kept_texts, suffix_dedup.TEXTS).collect()}
    assert texts[101] == "" and texts[0] == rows[0][1]
    assert suffix_dedup.without_repeats(docs_of(spark, rows).where("false")).count() == 0


def test_suffix_order_and_prefixes():
    rng = random.Random(5)
    pieces = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(50, 84))) for _ in range(40)] + [b"a" * 80, b"a" * 70, b"\x00" * 60]
    text = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.array([len(p) for p in pieces])
    ends = np.cumsum(sizes)
    starts = np.concatenate([np.arange(e - s, e - 49) for s, e in zip(sizes, ends, strict=True)])
    order = suffix_dedup.suffix_order(text, np.repeat(ends, sizes), starts)
    raw = text.tobytes()
    strings = [raw[p : p + 50] for p in order]
    assert strings == sorted(strings) and sorted(order) == sorted(starts)
    got = suffix_dedup.common_prefixes(text, order, ends - sizes, sizes - 49)
    for i in range(1, len(order)):
        a, b = strings[i - 1], strings[i]
        assert got[i] == next((k for k in range(50) if a[k] != b[k]), 50)


# --- search


def test_search_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "TILE", 64)
    monkeypatch.setattr(topk, "BLOCK", 50)
    monkeypatch.setattr(topk, "QUERY_TILE", 7)
    monkeypatch.setattr(topk, "FAN_IN", 2)
    rng = np.random.default_rng(2)
    vectors = {i: rng.integers(-3, 3, 8).astype(np.float32) / 7 for i in range(500)}
    rows = [(i, v.tolist(), 1) for i, v in vectors.items()] + [(900, None, 1), (950, [1.0, None], 1), (1000, [float("nan")] * 8, 1), (1050, [], 1), (None, [1.0] * 8, 1), (7, vectors[7].tolist(), 1)]
    table = topk.valid(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, tile int"))
    assert table.count() == 500
    got = defaultdict(list)
    for r in topk.search(table.where("vec_id % 50 = 0"), table).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    whole = {i: np.floor(256 * v.astype(np.float64)) for i, v in vectors.items()}
    for q in range(0, 500, 50):
        assert got[q] == sorted(((i, int(whole[q] @ v)) for i, v in whole.items() if i != q), key=lambda x: (-x[1], x[0]))[:5]


def test_tiles_of_long_vectors(spark, monkeypatch):
    """4,096 components: tiles are bounded by bytes."""
    monkeypatch.setattr(topk, "TILE_BYTES", 8 * 4096 * 10)
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(64, 4096)).astype(np.float32)
    rows = topk.valid(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<float>"))
    sizes = []
    packed = topk.packed
    monkeypatch.setattr(topk, "packed", lambda r, tiles, schema: sizes.append(tiles) or packed(r, tiles, schema))
    got = {(r.query_id, r["rank"]): r.vec_id for r in topk.search(rows.where("vec_id % 4 = 0"), rows, 3).collect()}
    assert sizes == [7, 2]
    whole = np.floor(256 * vectors.astype(np.float64))
    for q in range(0, 64, 4):
        order = sorted((i for i in range(64) if i != q), key=lambda i: (-int(whole[q] @ whole[i]), i))[:3]
        assert [got[q, k] for k in (1, 2, 3)] == order


def test_few_candidates(spark):
    table = topk.valid(spark.createDataFrame([(0, [1e6, 1e6]), (1, [1e6, 2e6]), (2, [1.0])], "vec_id bigint, embedding array<double>"))
    got = topk.search(table.where("vec_id = 0"), table).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(0, 1, 1, 256_000_000**2 * 3)]


def test_products_beyond_a_long(spark):
    rows = [(0, [1e300, 1.0]), (1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [0.0, 2.0]), (4, [1e308, 0.0]), (5, [3e7, 0.0])]
    table = topk.valid(spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id bigint, embedding array<double>, q string"))
    assert table.count() == 5  # 256 times 1e308 is not finite
    got = [(r.vec_id, r.score) for r in topk.search(table.where("vec_id = 0"), table).orderBy("rank").collect()]
    assert got == [(1, 2**63 - 1), (5, 2**63 - 1), (3, 2 * 256 * 256), (2, -(2**63))]
    assert topk.search(table.where("vec_id = 0"), table.where("false")).count() == 0


# --- classifiers


def test_segments_are_all_maximal():
    """Against the definition: recursive removal of the best segment."""

    def naive(s, at=0):
        best = max(((sum(s[i:j]), -(j - i), i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=(0, 0, 0, 0))
        if best[0] <= 1e-12:
            return []
        _, _, i, j = best
        return naive(s[:i], at) + [(at + i, at + j - 1, best[0])] + naive(s[j:], at + j)

    rng = random.Random(4)
    for _ in range(150):
        drift = -rng.choice([0.3, 0.7, 1.1])
        hits = {i: rng.choice([0.5, 1.3, 2.9, -1.7]) for i in range(rng.randrange(1, 16)) if rng.random() < 0.5}
        n = max(hits, default=0) + 2
        want = naive([hits.get(i, drift) for i in range(n)])
        got = toxicity.segments(sorted(hits.items()), drift)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert [x for *_, x in got] == pytest.approx([x for *_, x in want])


def test_lambda_is_the_root_over_all_words():
    rng = np.random.default_rng(8)
    for drift, n in ((-0.2, 4000), (-0.5, 4000), (-0.69, 10**6), (-0.69, 10**9)):
        scored = np.concatenate([rng.choice([1.1, 2.3, -0.8], 40), [3.0]])
        lam = toxicity.solve_lambda(drift, n, scored)
        mean = ((n - len(scored)) * np.exp(lam * drift) + np.exp(lam * (scored + drift)).sum()) / n
        assert lam > 0 and mean == pytest.approx(1, abs=1e-9)
    assert lam > 2 and toxicity.solve_lambda(-0.69, 100, np.array([0.5])) == np.inf


def test_evidence_of_one_segment_is_its_own_tail():
    """One segment: -ln(K n exp(-lambda s)); more segments than one never count less than the best alone."""
    model = toxicity.Model({}, -0.1, lam=0.9, k=1e-3)
    assert toxicity.evidence(500, [(0, 1, 12.0)], model) == pytest.approx(0.9 * 12 - np.log(1e-3 * 500))
    assert toxicity.evidence(500, [(0, 1, 12.0), (5, 6, 11.0)], model) >= toxicity.evidence(500, [(0, 1, 12.0)], model)
    assert toxicity.evidence(500, [], model) == 0 and toxicity.evidence(500, [(0, 0, -9.0)], model) == 0


def test_log_odds_of_both_signs(spark):
    rows = [("bad", 30, 1), ("good", 1, 60), ("even", 50, 100)]
    got = {r.term: r for r in toxicity.log_odds(spark.createDataFrame(rows, "term string, y1 bigint, y0 bigint"), 0.2, 2.3).collect()}
    n1, n0 = 81, 161
    for t, y1, y0 in rows:
        a, a0 = 0.2 * (y1 + y0), 0.2 * (n1 + n0)
        score = np.log((y1 + a) / (n1 + a0 - y1 - a)) - np.log((y0 + a) / (n0 + a0 - y0 - a))
        z = score / np.sqrt(1 / (y1 + a) + 1 / (y0 + a))
        assert (t in got) == (abs(z) >= 2.3)
        if t in got:
            assert got[t].score == pytest.approx(score)
    assert got["bad"].score > 0 > got["good"].score


def labelled(n=600, seed=6):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = prose(rng, rng.randrange(30, 200), 2000).split()
        toxic, bad = i % 6 == 0, i % 5 == 0
        if toxic:
            for w in ("vile", "nasty", "grosser"):
                words[rng.randrange(len(words))] = w
        if bad:
            words = [w + rng.choice(["%%%", "###"]) for w in words] if i % 2 else words[:3] * 30
        docs.append((i, " ".join(words)))
        if i % 3:
            continue
        labels.append((i, int(not bad), int(toxic)))
    labels += [(i, int(i % 5 != 0), int(i % 6 == 0)) for i in range(n) if i % 3]
    return docs, labels


def check_scores(spark, module, column):
    docs, labels = labelled()
    rows = docs_of(spark, [*docs, (9001, None), (None, "clean words"), (9002, "w1 " * 40000)])
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    out = module.score_documents(rows, module.fit(rows, marks))
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(docs) + 3 and all(0 <= r.score <= 1 for r in got.values())
    truth = pd.DataFrame(labels, columns=["doc_id", "quality", "toxic"]).set_index("doc_id")[column]
    held = [i for i in truth.index if got[i].held_out]
    assert len(held) > 80 and np.mean([got[i].predicted == truth[i] for i in held]) > 0.95
    flipped = spark.createDataFrame([(i, 1 - q, 1 - t) if got[i].held_out else (i, q, t) for i, q, t in labels], "doc_id bigint, quality int, toxic int")
    same = {r.doc_id: r.score for r in module.score_documents(rows, module.fit(rows, flipped)).collect()}
    assert all(same[i] == pytest.approx(got[i].score) for i in same)
    dealt = {r.doc_id: r.score for r in module.score_documents(rows, module.fit(rows.repartition(7), marks.repartition(5))).collect()}
    assert all(dealt[i] == pytest.approx(got[i].score) for i in dealt)
    assert module.score_documents(rows.where("false"), module.fit(rows.where("false"), marks)).count() == 0


@pytest.mark.parametrize("prior", [0.4, 2.0])
def test_risk_gradient_equals_differences(prior):
    """With the second term above zero, and below (which so large a weight of positives forces)."""
    rng = np.random.default_rng(3)
    xp, xu = rng.normal(0, 1, (30, 4)), rng.normal(0.3, 1, (50, 4))
    theta = [rng.normal(0, 1, (4, 3)), rng.normal(0, 1, 3), rng.normal(0, 1, 3), np.array([0.2])]
    sign = quality.risk(theta, xp, xu, prior)[1]
    assert (sign < 0) == (prior > 1)

    def loss():
        good, rest = quality.risk(theta, xp, xu, prior)
        return good + rest if sign >= 0 else -rest

    got = quality.risk_gradient(theta, xp, xu, prior)
    for t, g in zip(theta, got, strict=True):
        for at in np.ndindex(t.shape):
            kept, step = t[at], 1e-6
            t[at] = kept + step
            up = loss()
            t[at] = kept - step
            down = loss()
            t[at] = kept
            assert g[at] == pytest.approx((up - down) / 2 / step, abs=1e-6)


@pytest.mark.parametrize("share", [0.2, 0.7])
def test_prior_from_positives_and_unlabelled(share):
    rng = np.random.default_rng(4)
    good, bad = rng.normal(1.5, 1, (9000, 3)), rng.normal(-1.5, 1, (6000, 3))
    k = int(share * 6000)
    other = rng.permutation(np.concatenate([good[3000 : 3000 + k], bad[: 6000 - k]]))
    assert quality.class_prior(good[:3000], other) == pytest.approx(share, abs=0.06)


def test_toxicity_on_held_out(spark):
    check_scores(spark, toxicity, "toxic")


def test_quality_on_held_out(spark):
    check_scores(spark, quality, "quality")


def test_classifiers_without_labels(spark):
    docs = docs_of(spark, [(1, "some text"), (2, None)])
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r.score for r in toxicity.score_documents(docs, toxicity.fit(docs, none)).collect()} == {0.0}
    assert {r.score for r in quality.score_documents(docs, quality.fit(docs, none)).collect()} == {0.5}


def test_passages_are_found(spark):
    docs, labels = labelled()
    rows = docs_of(spark, docs)
    model = toxicity.fit(rows, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    found = {r.doc_id for r in toxicity.passages(rows, model, least=0.0).collect()}
    # junk made of a text's first three words has lost the words put into it
    toxic = {i for i, t in docs if re.search("vile|nasty|grosser", t)}
    assert len(found & toxic) > 0.95 * len(toxic) and len(found - toxic) < 0.05 * len(docs)
    assert toxicity.keep_clean(rows, model).schema == rows.schema
