"""Helpers that several corpus operators share."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir, written

__all__ = ["ascii_lower", "free_names", "given_back", "held_out", "join_groups", "shared_dir", "small_batches", "table", "unit", "written"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x20\x09-\x0D]+"


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, UPPER, UPPER.lower())


def unit(*parts: Column) -> Column:
    """A number in (0, 1) drawn from a 64-bit hash of the parts."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + F.lit(0.5)) * F.lit(2.0**-53)


def held_out(doc_id: Column) -> Column:
    """Rows that no label may be learnt from: crc32 of the id as text leaves no remainder by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


#: At most this many groups can hold more than one part in HOT_PARTS of all rows, so a broadcast of them is bounded.
HOT_PARTS = 2048


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int | None = None) -> DataFrame:
    """Inner join of rows with one row per key, where a few keys may hold most rows (total: how many those are, if known).

    Groups above one part in HOT_PARTS of all rows number HOT_PARTS at most; they are broadcast,
    so that no task gathers a hot key. The others meet in a sort-merge join.
    """
    total = rows.count() if total is None else total
    hot = groups.where(F.col(size) * HOT_PARTS > total).limit(HOT_PARTS)
    cold = groups.where(F.col(size) * HOT_PARTS <= total)
    left = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return left.hint("merge").join(cold, key).unionByName(rows.join(F.broadcast(hot), key))


#: Rows of texts that go to a Python worker at once.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Texts are longer than what Spark's default of rows for an Arrow batch is meant for; a value of the caller's stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def given_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, after which a Python worker, which goes on to other stages, gives free memory back."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            import pyarrow

            pyarrow.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return wrapped


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for columns that df doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
