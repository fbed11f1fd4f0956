"""Near-dedup by fast similarity sketching: rounds of hashed bins, banding, exact verification.

A sketch has T coordinates. In each of the first T rounds every shingle of a set is hashed to one
bin, and a bin that no earlier round has filled takes the smallest hash of the round; in round T + i all
shingles go to bin i, so that after 2 T rounds every coordinate is filled. A set of many shingles is
done after a round or two, where plain MinHash hashes each shingle T times, and coordinates agree
with the probability of the Jaccard similarity, with the concentration of as many draws without
replacement or better.

BANDS bands of T / BANDS coordinates each are hashed to buckets. Equal sets are one node. A bucket
isn't expanded into all its pairs: members meet the bucket's leads first, the links that are
verified make components, and then all members of different components are compared, by parity
sketches (lower bounds of the symmetric difference) and at last by their full sets. Links are thus
always true ones; a pair at the threshold of 0.85 misses all bands with a probability of 7e-9.

Defined cases: a null text or one without words has no shingles, links with nothing and is its own
component; with fewer words than a shingle the whole sequence is the only one; rows that repeat an
id are one document; rows with a null id are given a null component and aren't kept; a very long
text is hashed by itself, as a whole; an empty table gives no rows; columns beside doc_id and text
are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import given_back, join_groups, table, written
from .components import components
from .hashing import U64, keys, mixed, shingles
from .jaccard_join import LONG, apart, best, parts, sketch, to_leads, verified

WIDTH, PERCENT = 5, 85
T, BANDS = 160, 32
EMPTY = U64(2**64 - 1)


def sketches(sets: list[np.ndarray], t: int = T) -> np.ndarray:
    """A row of t coordinates for each set of 64-bit hashes; sets must not be empty."""
    out = np.full((len(sets), t), EMPTY)
    rounds = keys(2 * t, 1301)
    sizes = np.array([len(s) for s in sets], np.int64)
    elements, owner = (np.concatenate(sets) if sets else np.zeros(0, U64)), np.repeat(np.arange(len(sets)), sizes)
    flat = out.reshape(-1)
    with np.errstate(over="ignore"):
        for i in range(2 * t):
            if not len(elements):
                break
            h = mixed(elements ^ rounds[i])
            # never the mark of an empty bin
            h -= h == EMPTY
            bin_of = ((h >> U64(32)) * U64(t) >> U64(32)).astype(np.int64) if i < t else np.full(len(h), i - t)
            at = owner * t + bin_of
            free = flat[at] == EMPTY
            np.minimum.at(flat, at[free], h[free])
            left = (out == EMPTY).any(axis=1)[owner]
            if not left.all():
                elements, owner = elements[left], owner[left]
    return out


def bands_of(rows: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A hash for each band of each sketch; the same coordinates in another band give another."""
    wide = rows.reshape(len(rows), bands, -1)
    with np.errstate(over="ignore"):
        return mixed((wide * keys(wide.shape[2], 1303)).sum(axis=2, dtype=U64) + keys(bands, 1307)).view(np.int64)


def described(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n, key (of the set), bands (null without shingles) and parity sketch of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids = pdf["doc_id"]
            for at, texts in parts(pdf["text"].tolist()):
                sets = shingles(texts, width)
                full = [i for i, s in enumerate(sets) if len(s)]
                bands = dict(zip(full, bands_of(sketches([sets[i] for i in full])), strict=True))
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                columns = {"n": [len(s) for s in sets], "key": digests, "bands": [bands.get(i) for i in range(len(sets))], "sketch": [sketch(s) for s in sets]}
                yield pd.DataFrame({"doc_id": ids.iloc[at : at + len(texts)].astype("Int64").array, **columns})

    return docs.mapInPandas(given_back(run), "doc_id bigint, n bigint, key binary, bands array<bigint>, sketch binary")


def links_of(nodes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """u, v: links that connect what is connected. nodes: node, n, bands, sketch of every set."""
    parity = nodes.select("node", "n", "sketch")
    postings = nodes.select(F.explode("bands").alias("s"), "node", "n")
    # buckets of the same members are one list
    lists = postings.groupBy("s").agg(F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("node", "n")).alias("of")).where("c > 1")
    lists = written(lists.groupBy("c", "of").agg(F.min("s").alias("s")).select("s", "c"), "buckets")
    live = written(postings.join(lists, "s").select("s", "c", "node", "n", F.lit(0).alias("pos")), "bucket-members")

    links = verified(best(to_leads(live.withColumn("comp", F.col("node")), parity, percent), "node", "lead"), docs, width, percent)
    comp = components(links).select("node", F.col("component").alias("comp"))
    long = live.where(F.col("c") >= LONG)
    if not long.isEmpty():
        # what the first leads left apart in long lists, so that the pairs of all that is apart stay few
        rows = long.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        more = verified(best(to_leads(rows, parity, percent), "node", "lead"), docs, width, percent)
        if not more.isEmpty():
            links = links.unionByName(more)
            comp = components(links).select("node", F.col("component").alias("comp"))
    entries = live.drop("c").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    rest = apart(written(entries, "entries"), parity, percent)
    return links.unionByName(verified(rest, docs, width, percent)).select("u", "v")


def classes(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = written(described(docs, width), "described")
    full = rows.where("doc_id is not null and n > 0")
    sets = full.groupBy("key").agg(F.min(F.struct("doc_id", "n", "bands", "sketch")).alias("t"), F.count(F.lit(1)).alias("size"))
    sets = written(sets.select("key", "size", F.col("t.doc_id").alias("node"), "t.n", "t.bands", "t.sketch"), "sets")
    final = components(links_of(sets.select("node", "n", "bands", "sketch"), docs, width, percent))

    named = sets.join(final, "node", "left").select("key", "size", F.coalesce("component", "node").alias("component_id"))
    there = join_groups(full.select("doc_id", "n", "key"), named, "key", "size").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = rows.where("doc_id is null or n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return there.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
