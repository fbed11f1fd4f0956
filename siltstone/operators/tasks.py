"""Parsing task texts into type, objective, anchors and expectations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import has_phrase

#: A backtick after an even number of backslashes, up to the next such one on the line.
SPAN = r"(?<!\\)(?:\\\\)*`((?:[^`\\\n]|\\.)*)`"


def task_id(raw: Column) -> Column:
    return F.concat(F.lit("tsk_"), F.substring(F.sha2(raw.cast("binary"), 256), 1, 16))


def objective(raw: Column) -> Column:
    """The first line that isn't blank, trimmed."""
    lines = F.transform(F.split(raw, "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.coalesce(F.try_element_at(F.filter(lines, lambda x: x != ""), F.lit(1)), F.lit(""))


def action_type(lowered: Column) -> Column:
    found = F.when(F.lit(False), F.lit(""))
    for name, phrases in K.ACTIONS:
        found = found.when(has_phrase(lowered, phrases), name)
    return found.otherwise("unknown")


def anchors(raw: Column, markdown: Column) -> Column:
    """Identifiers, file names, backtick spans (in Markdown) and words of four letters, distinct and sorted."""
    words = F.regexp_extract_all(F.lower(raw), F.lit("[A-Za-z0-9]{4,}"), F.lit(0))
    parts = [
        F.regexp_extract_all(raw, F.lit("[A-Z][A-Za-z0-9_]{2,}"), F.lit(0)),
        F.regexp_extract_all(raw, F.lit(K.FILENAME), F.lit(0)),
        F.when(markdown, F.filter(F.regexp_extract_all(raw, F.lit(SPAN), F.lit(1)), lambda s: s != "")).otherwise(F.array().cast("array<string>")),
        F.array_except(words, F.array(*map(F.lit, K.STOP_WORDS))),
    ]
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def lower_all(anchors: Column) -> Column:
    return F.transform(anchors, F.lower)


def has_anchor(anchors: Column, keywords: list[str]) -> Column:
    return F.arrays_overlap(lower_all(anchors), F.array(*map(F.lit, keywords)))


def parse(tasks: DataFrame) -> DataFrame:
    """tasks (raw_text, markdown, and any key) with type, objective, anchors and the expects_* flags; a null text counts as empty."""
    raw = F.coalesce(F.col("raw_text"), F.lit(""))
    lowered = F.lower(raw)
    words = {k: has_phrase(lowered, "|".join(v)) for k, v in (("test", K.TEST_WORDS), ("doc", K.DOC_WORDS), ("migration", K.MIGRATION_WORDS))}
    out = tasks.withColumns({"type": action_type(lowered), "objective": objective(raw), "anchors": anchors(raw, F.coalesce(F.col("markdown"), F.lit(False)))})
    return out.withColumns(
        {
            "expects_tests": F.col("type").isin("feature", "bugfix", "refactor", "migration", "test-addition") | words["test"],
            "expects_config": has_anchor(F.col("anchors"), K.CONFIG_ANCHORS),
            "expects_docs": (F.col("type") == "documentation") | words["doc"],
            "expects_migration": (F.col("type") == "migration") | words["migration"],
            "expects_api": has_anchor(F.col("anchors"), K.API_ANCHORS),
        }
    )
