"""Summaries of files as text columns, for their token costs and for reading.

files: path, language, package_name, size_bytes, imports, side_effects, test_links (arrays of
strings), symbols array<struct<name, kind, receiver, exported>>, parse_error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .pack import size_band

# Fixed value: kinds in the order they are listed.
KINDS = ["type", "interface", "func", "method", "const", "var"]


def listed(title: str, items: Column) -> Column:
    """A titled list, or nothing."""
    lines = F.array_join(F.transform(items, lambda x: F.concat(F.lit("  - "), x, F.lit("\n"))), "")
    return F.when(F.size(F.coalesce(items, F.array().cast("array<string>"))) > 0, F.concat(F.lit(title + ":\n"), lines)).otherwise("")


def named(s: Column) -> Column:
    return F.when(F.coalesce(s["receiver"], F.lit("")) != "", F.concat(s["receiver"], F.lit("."), s["name"])).otherwise(s["name"])


def structural(c=F.col) -> Column:
    """Package, imports, symbols by kind and tests of a Go file; empty for others."""
    of_kind = [
        listed(k, F.transform(F.array_sort(F.transform(F.filter(c("symbols"), kind_is(k)), lambda s: F.struct(s["name"].alias("name"), F.coalesce(s["receiver"], F.lit("")).alias("receiver")))), named))
        for k in KINDS
    ]
    package = F.when(F.coalesce(c("package_name"), F.lit("")) != "", F.concat(F.lit("package "), c("package_name"), F.lit("\n"))).otherwise("")
    text = F.concat(F.lit("# structural summary: "), c("path"), F.lit("\n"), package, listed("imports", c("imports")), *of_kind, listed("tests", c("test_links")))
    return F.when(c("language") == "go", text).otherwise("")


def kind_is(kind: str):
    def test(s: Column) -> Column:
        return s["kind"] == kind

    return test


def behavioral(tokens_full: Column, c=F.col) -> Column:
    """Size, language, imports, side effects, exported names (Go) and tests of a file."""
    head = F.concat(
        F.lit("# behavioral summary: "), c("path"), F.lit("\nsize_band: "), size_band(c("size_bytes"), tokens_full), F.lit("\nsize_bytes: "), c("size_bytes").cast("string"),
        F.lit("\nestimated_tokens_full: "), tokens_full.cast("string"), F.lit("\n"),
    )
    language = F.when(c("language") != "", F.concat(F.lit("language: "), c("language"), F.lit("\n"))).otherwise("")
    broken = F.when(F.coalesce(c("parse_error"), F.lit(False)), "parse_error: true\n").otherwise("")
    ordered = F.array_sort(F.transform(c("symbols"), lambda s: F.struct(s["kind"].alias("kind"), s["name"].alias("name"), s["receiver"].alias("receiver"))))
    api = F.when(c("language") == "go", listed("exported_api", F.transform(ordered, lambda s: F.concat(s["kind"], F.lit(" "), named(s))))).otherwise("")
    return F.concat(head, language, broken, listed("imports", F.array_sort(c("imports"))), listed("side_effects", F.array_sort(c("side_effects"))), api, listed("tests", c("test_links")))
