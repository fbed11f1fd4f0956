"""Fingerprints of ordered rows: one SHA-256 state for each key, carried along sorted partitions.

A hash of a sequence is serial, so a key is one task's work; but rows stream through it in order, sorted
by Spark with spill, and no row ever holds more than one piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chained(rows: DataFrame, key: str, order: list[str], piece: Column, head: bytes = b"", between: bytes = b"", tail: bytes = b"") -> DataFrame:
    """key, fingerprint (lowercase hex) and n (rows) of every key: head, pieces in order with between among them, tail."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, n, began = None, None, 0, False
        for batch in batches:
            out = []
            for k, p in zip(batch["key"], batch["piece"], strict=True):
                k = None if pd.isna(k) else k
                if not began or k != now:
                    if began:
                        out.append((now, finished(state, tail), n))
                    now, state, n, began = k, hashlib.sha256(head), 0, True
                state.update((between if n else b"") + bytes(p))
                n += 1
            yield pd.DataFrame(out, columns=["key", "fingerprint", "n"])
        if began:
            yield pd.DataFrame([(now, finished(state, tail), n)], columns=["key", "fingerprint", "n"])

    taken = rows.select(F.col(key).cast("string").alias("key"), F.coalesce(piece.cast("binary"), F.lit(b"")).alias("piece"), *[F.col(c).alias(f"order{i}") for i, c in enumerate(order)])
    taken = taken.repartition("key").sortWithinPartitions("key", *[f"order{i}" for i in range(len(order))]).select("key", "piece")
    return taken.mapInPandas(run, "key string, fingerprint string, n bigint").withColumnRenamed("key", key)


def finished(state, tail: bytes) -> str:
    state.update(tail)
    return state.hexdigest()
