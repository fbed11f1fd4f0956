"""Sharding by a hierarchical weighted hash tree.

A document descends region, rack and shard. At each level every child draws an exponential
number from a hash of the document's id and the child's name, divided by the child's weight (the
sum of its shards), and the smallest draw wins. A child's draw depends on its own name and weight
alone, so a changed weight moves documents only into or out of the subtrees on the changed path.
A shard that is added forms a region of its own: all other draws stay as they were, and every
document that moves, moves into it.

Slots are dense per shard without sorting a shard in one task: what is known of the rows is written once
without texts, cut by hash into blocks of about BLOCK_ROWS rows, blocks are counted, and only a block is sorted.

Defined cases: a null text has no bytes and size 8; rows with a null id go by their texts, and those
without both too are spread over blocks; rows
that repeat an id share its shard and get slots one after the other; a very long text counts with all
its bytes; an empty table gives no rows; columns beside doc_id and text are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, unit, written

OVERHEAD = 8
#: Rows of a block, and blocks of a shard at least.
BLOCK_ROWS, BLOCKS = 100_000, 64

Tree = dict[str, dict[str, dict[int, float]]]


def tree(shards: int, racks: int = 3, per_rack: int = 4, base: int | None = None) -> Tree:
    """Region, rack and shard names with weights: base shards in full racks, each later shard a region of its own."""
    base = shards if base is None else min(base, shards)
    out: Tree = {}
    for s in range(base):
        rack = s // per_rack
        out.setdefault(f"region{rack // racks}", {}).setdefault(f"rack{rack}", {})[s] = 1.0
    for s in range(base, shards):
        out[f"region-of-{s}"] = {f"rack-of-{s}": {s: 1.0}}
    return out


def weight(node) -> float:
    return sum(map(weight, node.values())) if isinstance(node, dict) else float(node)


def draw(key: Column | tuple[Column, ...], children: dict, level: str) -> Column:
    """The position of the child that wins the weighted draw."""
    live = [(i, name, w) for i, (name, c) in enumerate(children.items()) if (w := weight(c)) > 0]
    if len(live) == 1:
        return F.lit(live[0][0])
    keys = key if isinstance(key, tuple) else (key,)
    drawn = [F.struct((-F.log(unit(*keys, F.lit(f"{level}/{name}"))) / F.lit(w)).alias("t"), F.lit(i).alias("i")) for i, name, w in live]
    return F.array_min(F.array(*drawn))["i"]


def choose(key: Column | tuple[Column, ...], node: dict, levels: tuple[str, ...] = ("region", "rack", "shard")) -> Column:
    """The shard of key (of several columns those that aren't null count): one draw at each level of the tree."""
    picked = draw(key, node, levels[0])
    if len(levels) == 1:
        return F.element_at(F.array(*[F.lit(int(s)) for s in node]), picked + 1)
    below = [choose(key, child, levels[1:]) for child in node.values()]
    return reduce(lambda rest, ib: F.when(picked == ib[0], ib[1]).otherwise(rest), enumerate(below[:-1]), below[-1])


def shard_documents(docs: DataFrame, layout: Tree, grown: Tree | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    shards = sum(len(rack) for region in layout.values() for rack in region.values())
    # rows without an id are told apart by their texts, and within a shard by where they stand
    nameless = F.col("doc_id").isNull()
    key = (F.col("doc_id"), F.when(nameless, F.crc32(text)))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + OVERHEAD).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        choose(key, layout).alias("shard"),
        (choose(key, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        F.when(nameless, F.monotonically_increasing_id()).alias("place"),
    )
    rows = written(rows, "sharded")
    block = F.pmod(F.xxhash64(F.lit("block"), "doc_id", "text_crc32", "place"), F.lit(max(BLOCKS, -(-rows.count() // (shards * BLOCK_ROWS)))))
    rows = rows.withColumn("block", block)
    counted = rows.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = counted.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    turn = F.row_number().over(W.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size", "place"))
    return (
        rows.withColumn("turn", turn)
        .join(starts, ["shard", "block"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("turn") - 1).cast("bigint").alias("slot"), "grown_shard")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), tree(24), tree(25, base=24))
