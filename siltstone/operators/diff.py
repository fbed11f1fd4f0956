"""Differences between two versions of a keyed table, and between sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def changes(a: DataFrame, b: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys, change (added, removed, changed) and each value before and after; equal rows are left out."""
    left = a.select(*keys, *[F.col(v).alias(f"{v}_a") for v in values], F.lit(True).alias("in_a"))
    right = b.select(*keys, *[F.col(v).alias(f"{v}_b") for v in values], F.lit(True).alias("in_b"))
    rows = left.join(right, keys, "full_outer")
    differs = F.lit(False)
    for v in values:
        differs = differs | ~F.col(f"{v}_a").eqNullSafe(F.col(f"{v}_b"))
    change = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(differs, "changed")
    return rows.withColumn("change", change).where("change is not null").drop("in_a", "in_b")


def added(a: Column, b: Column) -> Column:
    """Sorted elements of b that a lacks; swap the arguments for those removed."""
    return F.array_sort(F.array_except(b, a))


def first_difference(a: Column, b: Column, longest: int = 200) -> Column:
    """The first line in which a and b differ, of both sides, cut to longest characters; empty where they are equal."""
    lines = F.arrays_zip(F.split(a, "\n").alias("x"), F.split(b, "\n").alias("y"))
    pair = F.try_element_at(F.filter(lines, lambda z: ~z["x"].eqNullSafe(z["y"])), F.lit(1))
    line = F.when(a == b, "").otherwise(F.concat(F.lit("A:"), F.coalesce(pair["x"], F.lit("<eof>")), F.lit(" -> B:"), F.coalesce(pair["y"], F.lit("<eof>"))))
    return F.when(F.length(line) > longest, F.concat(F.substring(line, 1, longest - 1), F.lit("..."))).otherwise(line)


def version_at_least(version: Column, major: int, minor: int) -> Column:
    parts = F.transform(F.split(version, r"\."), lambda p: p.try_cast("int"))
    first, second = F.try_element_at(parts, F.lit(1)), F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(0))
    return F.coalesce((first > major) | ((first == major) & (second >= minor)), F.lit(False))
