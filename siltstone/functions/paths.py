"""Predicates and classes of paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import BASE_LANGUAGES, LANGUAGES
from .text import basename, dirname, extension


def lookup(table: dict[str, str], key: Column) -> Column:
    flat = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*flat), key)


def language(path: Column) -> Column:
    base, ext = F.lower(basename(path)), F.substring(F.lower(extension(path)), 2, 20)
    return F.coalesce(lookup(BASE_LANGUAGES, base), lookup(LANGUAGES, ext), F.lit(""))


def tier(lang: Column) -> Column:
    return F.when(lang == "go", "tier1_deep").when(lang.isin("typescript", "javascript", "python"), "tier2_structural").otherwise("tier3_lexical")


def is_test(path: Column) -> Column:
    base = basename(path)
    return base.rlike(r"_test\.go$|\.(test|spec)\.(ts|tsx|js|jsx|mjs|cjs)$|^test_.*\.py$|_test\.py$")


def is_test_for_gap(path: Column) -> Column:
    """The gap rule knows fewer test names than the index does."""
    return path.rlike(r"(_test\.go|\.test\.tsx?|_test\.py)$")


CONFIG_BASE, CONFIG_EXTENSION = r"(?i)^(makefile|go\.mod|go\.sum)$", r"(?i)\.(mk|ya?ml|toml|json)$"


def config_for_score(path: Column) -> Column:
    """A configuration name, at the root or below a folder called config or configs."""
    base = basename(path)
    placed = (F.instr(path, "/") == 0) | F.exists(F.split(dirname(path), "/"), lambda s: s.isin("config", "configs"))
    return (base.rlike(CONFIG_BASE) | base.rlike(CONFIG_EXTENSION)) & placed


def config_for_gap(path: Column) -> Column:
    """The gap rule takes the named files anywhere, and looks at every part of the path."""
    base = basename(path)
    placed = (F.instr(path, "/") == 0) | F.exists(F.split(path, "/"), lambda s: s.isin("config", "configs"))
    return base.rlike(CONFIG_BASE) | (base.rlike(CONFIG_EXTENSION) & placed)


def external_contract(path: Column) -> Column:
    low = F.lower(path)
    return low.rlike(r"\.(proto|graphql)$") | (low.rlike(r"\.(ya?ml|json)$") & low.rlike("openapi|swagger|schema|api"))


def plays_role(path: Column) -> Column:
    low = F.lower(basename(path))
    return low.rlike(r"^(main|config|server|router)\.go$|_(main|config)\.go$|^config_|^handler|\.(md|rst|adoc)$")


def in_scope(path: Column, scope: Column) -> Column:
    return scope.isNull() | (path == scope) | path.startswith(F.concat(scope, F.lit("/")))
