"""The corpus pipeline against the same decisions taken one by one, odd rows included."""

import random
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
import sentencepiece

from siltstone.llm import mixing, toxicity

from .test_text_operators import brute, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus():
    rng = random.Random(12)
    rows = []
    for i in range(150):
        words = prose(rng, rng.randrange(20, 90), 3000).split()
        if i % 6 == 0:
            for w in ("vile", "nasty", "grosser"):
                words[rng.randrange(len(words))] = w
        rows.append((i, " ".join(words)))
    for i in range(150, 200):
        text = rows[rng.randrange(150)][1]
        if i % 2:
            words = text.split()
            words[rng.randrange(len(words))] = "changed"
            text = " ".join(words)
        rows.append((i, text.upper() if i % 5 == 0 else text))
    return [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t)) for i, t in rows] + [(500, None, "en", "s0", 0), (501, "", "de", "s1", 0), (502, "word " * 20000, "en", "s2", 5), (502, "word " * 20000, "en", "s2", 5)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(corpus(), SCHEMA).repartition(3).write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), int(i % 6 == 0)) for i in range(150)], "doc_id bigint, quality int, toxic int").write.parquet(f"{place}/labels.parquet")
    return place


def test_run_equals_brute_force(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    clean = [r for r in corpus() if toxicity.probability(r[1] or "", model) < 0.5]
    assert {r[0] for r in corpus()} - {r[0] for r in clean} >= {i for i in range(150) if i % 6 == 0}
    last = {}
    for r in clean:
        key = (r[1] or "").translate(LOWER)
        if key not in last or r[0] > last[key][0]:
            last[key] = r
    component, _ = brute([(r[0], r[1]) for r in last.values()], 5, 80)
    kept = [r for r in last.values() if component[r[0]] == r[0]]
    assert len(kept) < len(last) < len(clean)
    survivors = spark.createDataFrame(kept, SCHEMA)
    times = Counter()
    for r in mixing.mix(survivors, weight=mixing.by_quality(survivors, labels)).collect():
        times[r.doc_id] += (2 * r.taken + r.size) // (2 * r.size) if r.size else 0
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    text = {r[0]: r[1] for r in kept}
    got = corpus_pipeline.run(spark, folder).collect()
    assert Counter(r.doc_id for r in got) == Counter({i: n for i, n in times.items() if n})
    assert all(r.token_ids == pieces.encode(text[r.doc_id]) and r.parity and r.n_tokens == len(r.token_ids) for r in got)


def test_stages_keep_the_columns_and_take_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0 and (name == "sentencepiece" or out.columns == docs.columns)
