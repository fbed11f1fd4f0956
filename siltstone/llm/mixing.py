"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key divided by its quality weight; within a source, documents
are taken by ascending key until the source's token budget is spent. A source whose target is at
least its own size is first taken whole, as often as that goes; only what is left is selected by
key. The document on which a budget ends gives the words that were still missing. The weight is
a column of the caller's; the query takes the score of the quality classifier.

The prefix sum of a source is never one task's work: keys fall into cells, CELLS for each factor of e,
which follow one another in order. Cells are summed first, and only rows of one cell are sorted
together, about one in 10,000 of a source's at most, whatever their weights. Sources themselves are
ranked in one task, one row for each.

Defined cases: a null text has no words; null is a source of its own and comes last; documents
without words are never taken; a null weight counts as 1, of those of 0 or below all others come first; rows that
repeat an id draw the same key and are ordered by the crc of their text; very long texts are counted
whole; an empty table gives an empty mix; columns beside doc_id, text and source are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import quality
from .common import WORD, free_names, table, unit, written

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, CAP = 1.5, 2.0
CELLS = 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def sized(docs: DataFrame, seed: int, weight: Column) -> DataFrame:
    """doc_id, source, size, crc, w, key; the only pass over the texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    given = F.coalesce(F.nanvl(weight.cast("double"), F.lit(1.0)), F.lit(1.0))
    rows = docs.select(
        "doc_id",
        F.col("source").cast("string").alias("source"),
        n_words(text).alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        given.alias("w"),
    )
    drawn = -F.log(unit(F.lit(seed), F.col("doc_id"), F.col("crc")))
    return rows.withColumn("key", F.when(F.col("w") > 0, drawn / F.col("w")).otherwise(F.lit(float("inf"))))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, n_docs, target: shares by weight, no target above cap times its source.

    Resharing the excess until none is above ends where all uncapped sources get one level times
    their weight; that level is found by one pass over the sources in order of size over weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    every = W.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    per = per.withColumn("weight", F.element_at(cycle, ((F.row_number().over(every) - 1) % len(weights) + 1).cast("int")))
    per = per.withColumn("limit", F.col("source_size") * F.lit(float(cap))).withColumn("ratio", F.col("limit") / F.col("weight"))
    before = W.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(F.lit(1))
    level = (F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    per = per.withColumn("level", level)
    # the first source in order whose level does not reach its limit sets the level of all after it
    water = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(whole)["level"]
    target = F.when(water.isNull(), F.col("limit")).otherwise(F.least(F.col("limit"), water * F.col("weight")))
    return per.select("source", "source_size", "n_docs", target.alias("target"))


def mix(
    docs: DataFrame, seed: int = 7, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, weight: Column | None = None
) -> DataFrame:
    """doc_id, size, source_size, target, taken (words), crc of every row of docs."""
    name = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    sizes = written(sized(docs, seed, F.lit(1.0) if weight is None else weight).withColumn("name", name), "mix-sizes")
    per = written(targets(sizes, weights, share, cap).withColumn("name", name), "mix-targets")
    # in order of the keys: 0 comes before all logarithms, what is infinite after them
    cell = F.when(F.col("key") <= 0, -(2**40)).when(F.col("key") == float("inf"), 2**40).otherwise(F.floor(F.log("key") * CELLS))
    rows = sizes.join(per.drop("source"), "name").withColumn("range", cell.cast("bigint"))
    summed = rows.groupBy("name", "range").agg(F.sum("size").alias("words"))
    before = W.partitionBy("name").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    starts = summed.select("name", "range", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start"))
    within = W.partitionBy("name", "range").orderBy("key", "doc_id", "crc").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.join(starts, ["name", "range"]).withColumn("reached", F.col("start") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    rest = F.round(F.col("target") - epochs * F.col("source_size")).cast("bigint")
    part = F.greatest(F.lit(0).cast("bigint"), F.least(F.col("size"), rest - F.col("reached")))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * epochs + part).alias("taken"), "crc")


def mixed_documents(docs: DataFrame, seed: int = 7, **kw) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each time a document is taken.

    Texts stay whole: the document on which a budget ends is taken if half of it or more was still missing.
    """
    keys = [number, null, crc, turn, times, first, last] = free_names(docs, "id", "null", "crc", "turn", "times", "first", "last")
    keys = keys[:3]
    key = {number: F.coalesce(F.col("doc_id"), F.lit(0)), null: F.col("doc_id").isNull()}
    rounds = F.when(F.col("size") > 0, F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size")))).otherwise(0).cast("int")
    plan = (
        mix(docs, seed, **kw)
        .select(*[c.alias(k) for k, c in key.items()], F.col("crc").alias(crc), rounds.alias(times))
        .groupBy(*keys, times)
        .agg(F.count(F.lit(1)).alias(last))
    )
    plan = written(plan, "mix-plan")
    rows = docs.withColumns(key | {crc: F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))})
    # rows that repeat id and text are alike but where a budget ends among them: there the first ones are taken more often
    torn = plan.groupBy(keys).agg(F.count(F.lit(1)).alias(turn)).where(F.col(turn) > 1).select(keys)
    alike = rows.hint("merge").join(plan.join(torn, keys, "left_anti").where(F.col(times) > 0).drop(last), keys)
    order = W.partitionBy(keys).orderBy(F.col(times).desc())
    spans = plan.join(torn, keys, "left_semi").withColumn(last, F.sum(last).over(order)).withColumn(first, F.coalesce(F.lag(last).over(order), F.lit(0)))
    apart = rows.join(torn, keys, "left_semi").withColumn(turn, F.row_number().over(W.partitionBy(keys).orderBy(number)))
    apart = apart.join(spans, keys).where((F.col(turn) > F.col(first)) & (F.col(turn) <= F.col(last)) & (F.col(times) > 0))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    both = alike.select(*columns, times).unionByName(apart.select(*columns, times))
    return both.withColumn(turn, F.explode(F.array_repeat(F.lit(0), F.col(times)))).select(*columns)


def by_quality(docs: DataFrame, labels: DataFrame) -> Column:
    """The quality classifier's score of a text, as a weight."""
    return quality.scorer(quality.fit(docs, labels))(F.col("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix(docs, weight=by_quality(docs, table(spark, sf_dir, "labels"))).drop("crc")
