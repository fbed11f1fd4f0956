"""Exact deduplication over a persistent digest index.

The index is a Parquet table bucketed and sorted by digest. A batch is reduced to one row per
digest before anything is shuffled by it, then meets the index in a sort-merge anti-join (the
index side needs no exchange), and what is new is appended. Texts never leave the scan.

Defined cases: a null text counts as empty; texts are equal when they agree after lower-casing
A-Z; of the equal rows of a batch the largest doc_id stays (a null id only if all are null); of
rows that repeat id and text one stays; a text that an earlier batch brought is kept there and
dropped here; an empty batch adds nothing. Columns beside doc_id and text are not looked at.

A batch has a name, which the caller gives. If a batch is lost after it was appended and comes again
under its name, what the index holds of that name counts as its own, so it gets the rows it would
have got at first.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ascii_lower, free_names, join_groups, shared_dir, table, written

ENTRY = "digest string, keep_id bigint, group_size bigint, batch string"


def text_digest(text: Column) -> Column:
    return F.sha2(ascii_lower(F.coalesce(text, F.lit(""))).cast("binary"), 256)


class DigestIndex:
    """One row per text seen: digest, the id that stays, the group's size in its batch, the batch."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = "digest_index_" + hashlib.sha256(self.path.encode()).hexdigest()[:16]
        columns = ", ".join(ENTRY.split(", "))
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({columns}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )

    def entries(self) -> DataFrame:
        return self.spark.table(self.name)

    def unseen(self, groups: DataFrame) -> DataFrame:
        """The groups whose digest the index lacks, by sort-merge anti-join."""
        return groups.hint("merge").join(self.entries().select("digest"), "digest", "left_anti")

    def append(self, groups: DataFrame) -> None:
        fresh = self.unseen(groups).select("digest", "keep_id", "group_size", "batch")
        (
            fresh.repartition(self.buckets, "digest")
            .write.mode("append")
            .format("parquet")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .option("path", self.path)
            .saveAsTable(self.name)
        )
        self.spark.catalog.refreshTable(self.name)


def digest_rows(docs: DataFrame) -> DataFrame:
    """doc_id, row and digest of each row, written once so that row means the same to every reader."""
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        text_digest(F.col("text")).alias("digest"),
    ).withColumn("row", F.monotonically_increasing_id())
    return written(rows, "digests")


def batch_groups(rows: DataFrame, batch: str) -> DataFrame:
    top = F.max(F.struct("doc_id", "row"))
    return (
        rows.groupBy("digest")
        .agg(top.alias("top"), F.count(F.lit(1)).alias("group_size"))
        .select("digest", F.col("top.doc_id").alias("keep_id"), F.col("top.row").alias("keep_row"), "group_size", F.lit(batch).alias("batch"))
    )


def deduplicate(docs: DataFrame, index: DigestIndex, batch: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row; texts new to the index are appended to it under the batch's name."""
    rows = digest_rows(docs)
    groups = written(batch_groups(rows, batch), "digest-groups")
    index.append(groups)
    own = groups.select("digest", "keep_row", F.col("group_size").alias("n"))
    out = join_groups(rows, own.hint("merge").join(index.entries(), "digest"), "digest", "n")
    return out.select(
        "doc_id",
        "keep_id",
        F.col("n").alias("group_size"),
        ((F.col("batch") == batch) & (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def new_index(spark: SparkSession) -> DigestIndex:
    return DigestIndex(spark, f"{shared_dir(spark)}/digest-index-{uuid.uuid4().hex}")


def keep_first_copies(docs: DataFrame, index: DigestIndex, batch: str) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    keys = [number, null, sha, turn] = free_names(docs, "id", "null", "sha", "turn")
    del keys[-1]
    key = {number: F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)), null: F.col("doc_id").isNull()}
    stay = deduplicate(docs, index, batch).where("kept").select(*[c.alias(k) for k, c in key.items()], F.col("text_sha256").alias(sha))
    rows = docs.withColumns(key | {sha: text_digest(F.col("text"))}).hint("merge").join(stay, keys, "left_semi")
    once = rows.withColumn(turn, F.row_number().over(W.partitionBy(keys).orderBy(number))).where(F.col(turn) == 1)
    return once.select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents"), new_index(spark), "documents")


ORACLE = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
