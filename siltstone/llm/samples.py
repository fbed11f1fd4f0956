"""Bounded samples of labelled and unlabelled documents to fit classifiers on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, written


def drawn(ids: DataFrame, n: int) -> DataFrame:
    """At most n ids, those of smallest hash; the same ones each time."""
    return ids.where(F.col("doc_id").isNotNull()).orderBy(F.xxhash64(F.lit("draw"), "doc_id"), "doc_id").limit(n)


def labelled(docs: DataFrame, labels: DataFrame, column: str, per_class: int, classes: tuple[int, ...] = (0, 1)) -> DataFrame:
    """doc_id, label, text of at most per_class labelled documents of each of the classes, none of them held out.

    The ids are bounded by per_class, so they are broadcast and the texts of the corpus stay in place.
    """
    known = labels.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("label"))
    ids = reduce(DataFrame.unionByName, [drawn(known.where(F.col("label") == c), per_class) for c in classes])
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return written(rows.join(F.broadcast(ids), "doc_id"), "labelled")


def unlabelled(docs: DataFrame, n: int) -> DataFrame:
    """doc_id and text of at most n documents that aren't held out, whatever their labels."""
    ids = drawn(docs.select("doc_id").where(~held_out(F.col("doc_id"))).distinct(), n)
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return written(rows.join(F.broadcast(ids), "doc_id"), "unlabelled")
