"""Exact dedup, mixing and sharding against brute force and on odd rows."""

import hashlib
import math
import struct
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from siltstone.llm import exact_dedup, mixing, sharding

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, shard int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 1, "x", 7) for i, t, s in rows], SCHEMA)


ODD = [(1, "A b", "s"), (2, "a B", "s"), (2, "a B", "s"), (3, None, None), (None, "", "t"), (4, "é", "s"), (5, "É", "t"), (6, "w " * 30000, "t"), (7, " \t\n", "u")]


def test_exact_dedup_odd_rows(spark):
    got = exact_dedup.deduplicate(docs_of(spark, ODD), exact_dedup.new_index(spark), "a").collect()
    assert len(got) == len(ODD)
    by = defaultdict(list)
    for r in got:
        by[r.text_sha256].append(r)
    first = by[hashlib.sha256(b"a b").hexdigest()]
    assert {r.keep_id for r in first} == {2} and {r.group_size for r in first} == {3} and sum(r.kept for r in first) == 1
    empty = by[hashlib.sha256(b"").hexdigest()]
    assert {r.keep_id for r in empty} == {3} and [r.doc_id for r in empty if r.kept] == [3]
    assert len(by) == 6


def test_index_keeps_what_came_before(spark):
    index = exact_dedup.new_index(spark)
    exact_dedup.deduplicate(docs_of(spark, [(9, "one", "s"), (3, "two", "s")]), index, "first").count()
    second = {r.doc_id: r for r in exact_dedup.deduplicate(docs_of(spark, [(20, "ONE", "s"), (21, "three", "s"), (22, "three", "s")]), index, "second").collect()}
    assert (second[20].keep_id, second[20].kept) == (9, False)
    assert (second[21].keep_id, second[21].kept, second[22].kept) == (22, False, True)
    again = exact_dedup.DigestIndex(spark, index.path, index.buckets)
    assert again.entries().count() == 3


def test_a_lost_batch_comes_again(spark):
    index = exact_dedup.new_index(spark)
    exact_dedup.deduplicate(docs_of(spark, [(1, "old", "s")]), index, "before").count()
    rows = docs_of(spark, [*ODD, (8, "OLD", "s")])
    exact_dedup.deduplicate(rows, index, "lost")  # appended, but its result is never written
    again = exact_dedup.deduplicate(rows.repartition(3), index, "lost").collect()
    assert sum(r.kept for r in again) == 6 and [(r.keep_id, r.kept) for r in again if r.doc_id == 8] == [(1, False)]
    assert index.entries().count() == 7
    assert not any(r.kept for r in exact_dedup.deduplicate(rows, index, "later").collect())


def test_columns_of_clashing_names_survive(spark):
    rows = spark.createDataFrame([(1, "a b c", "s", 9, 8, 7, 6), (2, "a b c", "s", 5, 4, 3, 2)], "doc_id bigint, text string, source string, id int, null int, sha int, crc int")
    kept = exact_dedup.keep_first_copies(rows, exact_dedup.new_index(spark), "a").collect()
    assert [tuple(r) for r in kept] == [(2, "a b c", "s", 5, 4, 3, 2)]
    mixed = mixing.mixed_documents(rows)
    assert mixed.columns == rows.columns and {tuple(r) for r in mixed.collect()} <= {tuple(r) for r in rows.collect()}


def test_kept_rows_have_all_columns(spark):
    rows = docs_of(spark, ODD)
    out = exact_dedup.keep_first_copies(rows, exact_dedup.new_index(spark), "a")
    assert out.schema == rows.schema and out.count() == 6
    assert exact_dedup.keep_first_copies(rows.where("false"), exact_dedup.new_index(spark), "b").count() == 0


def water(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Targets by resharing until no source is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total = share * sum(sizes.values())
    target, open_ = {}, set(names)
    while open_:
        left = total - sum(target.values())
        each = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        above = {s for s in open_ if each[s] > cap * sizes[s]}
        if not above:
            return target | each
        target |= {s: cap * sizes[s] for s in above}
        open_ -= above
    return target


def test_mix_meets_targets(spark):
    rows = [(i, "w " * (1 + i % 50), f"s{i % 7}" if i % 11 else None) for i in range(2000)] + [(5000, None, "empty")]
    docs = docs_of(spark, rows)
    got = mixing.mix(docs).collect()
    sizes, taken, target = Counter(), Counter(), {}
    for r, s in zip(sorted(got, key=lambda r: r.doc_id), [s for *_, s in sorted(rows, key=lambda r: r[0])], strict=True):
        sizes[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
        assert 0 <= r.taken <= 2 * r.size
    for s, t in water(sizes).items():
        assert target[s] == pytest.approx(t) and abs(taken[s] - t) <= 1
    again = mixing.mix(docs.repartition(13)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mixed_documents_follow_the_plan(spark):
    docs = docs_of(spark, [(i, f"w{i}  \n" * (3 + i % 9), f"s{i % 4}") for i in range(60)] + [(7, "w7  \n" * 10, "s3"), (7, "w7  \n" * 10, "s3"), (None, "x y", "s0"), (None, "x y", "s0"), (61, None, "s1")])
    plan = Counter()
    for r in mixing.mix(docs).collect():
        if r.size:
            plan[r.doc_id] += (2 * r.taken + r.size) // (2 * r.size)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    texts, times = {(r.doc_id, r.text) for r in docs.collect()}, Counter()
    for r in out.collect():
        times[r.doc_id] += 1
        assert (r.doc_id, r.text) in texts
    assert times == Counter({k: v for k, v in plan.items() if v})
    assert mixing.mixed_documents(docs.where("false")).count() == 0


@pytest.mark.parametrize("cells", [2, 4096])
def test_selection_by_keys_and_prefix_sums(spark, monkeypatch, cells):
    """Against one sorted list for each source, weights as they are given."""
    monkeypatch.setattr(mixing, "CELLS", cells)
    docs = docs_of(spark, [(i, "w " * (1 + i % 7), "abc"[i % 3]) for i in range(3000)])
    weights = {0: 0.001, 1: 0.9, 2: 7.0, 3: None, 4: 0.0, 5: float("nan"), 6: 0.12345}
    weight = F.expr("CASE doc_id % 7 WHEN 0 THEN 0.001D WHEN 1 THEN 0.9D WHEN 2 THEN 7D WHEN 4 THEN 0D WHEN 5 THEN double('nan') WHEN 6 THEN 0.12345D END")
    rows = mixing.sized(docs, 7, weight).collect()
    for r in rows:
        given = weights[r.doc_id % 7]
        assert r.w == (1.0 if given is None or given != given else given)
        assert r.w > 0 or r.key == float("inf")
    got = {r.doc_id: r for r in mixing.mix(docs, weight=weight).collect()}
    for s in "abc":
        own = sorted((r for r in rows if r.source == s), key=lambda r: (r.key, r.doc_id, r.crc))
        total, target = sum(r.size for r in own), got[own[0].doc_id].target
        epochs, left = int(target // total), round(target % total)
        for r in own:
            assert got[r.doc_id].taken == epochs * r.size + max(0, min(r.size, left))
            left -= r.size


def test_mix_prefers_weight(spark):
    rows = [(i, "good words here " * 5, "abc"[i % 3]) for i in range(3000)]
    got = {r.doc_id: r.taken for r in mixing.mix(docs_of(spark, rows), weight=F.when(F.col("doc_id") % 2 == 1, 1.0).otherwise(0.2)).collect()}
    part = range(2, 3000, 3)  # the source of least weight is taken in part
    assert sum(got[i] for i in part if i % 2) > 1.1 * sum(got[i] for i in part if not i % 2)


def test_shards_are_dense_and_only_the_new_one_takes_rows(spark):
    docs = docs_of(spark, [(i, "é" * (i % 5), "s") for i in range(5000)] + [(3, "twin", "s"), (None, None, "s")])
    got = sharding.shard_documents(docs, sharding.tree(24), sharding.tree(25, base=24)).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 24)
    assert set(slots) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) < 1.4 * 5000 / 24 and sum(r.grown_shard == 24 for r in got) == pytest.approx(200, rel=0.4)
    assert next(r for r in got if r.doc_id is None).size == 8 and next(r for r in got if r.doc_id == 4).size == 16


def test_rows_without_ids_are_spread(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 10)
    docs = docs_of(spark, [(None, f"text {i}", "s") for i in range(3000)] + [(None, None, "s")] * 2000)
    got = sharding.shard_documents(docs, sharding.tree(24), sharding.tree(25, base=24)).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 24)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 24
    assert sorted(map(len, slots.values()))[-2] < 1.6 * 3000 / 24


def test_draws_equal_their_definition(spark):
    """Every level's draws recomputed from the hash of the id and the child's name, with unequal weights."""
    layout = sharding.tree(24)
    layout["region0"]["rack1"] = {s: w for s, w in zip(layout["region0"]["rack1"], (0.5, 3.0, 0.0, 1.0), strict=True)}

    def pick(key, node, level):
        def drawn(name):
            h = xxhash.xxh64_intdigest(f"{level}/{name}".encode(), seed=xxhash.xxh64_intdigest(struct.pack("<q", key), seed=42))
            return -math.log(((h >> 11) + 0.5) * 2.0**-53) / sharding.weight(node[name])

        return min((n for n in node if sharding.weight(node[n]) > 0), key=drawn)

    def shard(key):
        region = pick(key, layout, "region")
        rack = pick(key, layout[region], "rack")
        return pick(key, layout[region][rack], "shard")

    got = spark.range(-50, 400).select("id", sharding.choose(F.col("id"), layout).alias("s")).collect()
    assert [r.s for r in got] == [shard(r.id) for r in got]


def test_slots_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 1)
    docs = docs_of(spark, [(i // 2, "x" * (i % 3), "s") for i in range(4000)])
    slots = defaultdict(list)
    for r in sharding.shard_documents(docs, sharding.tree(3)).collect():
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and sum(map(len, slots.values())) == 4000
    assert sharding.shard_documents(docs.where("false"), sharding.tree(3)).count() == 0


def test_weight_change_moves_only_along_its_path(spark):
    before, after = sharding.tree(24), sharding.tree(24)
    after["region0"]["rack1"] = {s: 2.0 for s in after["region0"]["rack1"]}
    ids = spark.range(4000).select(F.col("id").alias("doc_id"))
    moved = ids.select(sharding.choose(F.col("doc_id"), before).alias("a"), sharding.choose(F.col("doc_id"), after).alias("b")).where("a <> b").collect()
    changed, region = set(after["region0"]["rack1"]), {s for r in after["region0"].values() for s in r}
    assert moved and all(r.b in region for r in moved) and all(r.b in changed for r in moved if r.a in region)
