"""Column expressions over texts and numbers that several operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BEFORE, AFTER = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def has_phrase(lowered: Column, alternatives: str) -> Column:
    """Whether one of the alternatives stands between ASCII word boundaries."""
    return lowered.rlike(f"{BEFORE}(?:{alternatives}){AFTER}")


def alnum_tokens(c: Column) -> Column:
    """Distinct runs of a-z and 0-9 of the lower-cased text."""
    return F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda t: t != ""))


def head_bytes(c: Column, n: int = 2048) -> Column:
    """The first n bytes, as text; a character cut in two is dropped by the token patterns that follow."""
    return F.decode(F.substring(F.encode(c, "UTF-8"), 1, n), "ISO-8859-1")


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two arrays, 0 when both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(F.lit(0.0))


def rounded(x: Column, digits: int) -> Column:
    """Half away from zero, on the double itself."""
    scale = float(10**digits)
    return F.floor(F.abs(x) * scale + 0.5) * F.signum(x) / scale


def clamp01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def total(columns: list[Column]) -> Column:
    """A sum in the given order, which fixes its rounding."""
    return reduce(lambda a, b: a + b, columns)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def extension(path: Column) -> Column:
    """With the dot, in lower case; empty without one."""
    return F.lower(F.regexp_extract(basename(path), r"(\.[^.]*)$", 1))


def tokens_heuristic(n_bytes: Column) -> Column:
    """Tokens of so many bytes at 3.5 bytes each."""
    return F.ceil(n_bytes * 2 / F.lit(7)).cast("bigint")
