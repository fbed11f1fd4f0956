"""Differences of two batches of manifests, section by section, and their JSON and Markdown.

Both sides hold task_id and manifest as operators.manifest.assemble makes them; a task that one side
lacks is left out. A difference is one row: task_id, section, change, item, a, b.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .diff import first_difference

# The sections in order, with their titles.
SECTIONS = {
    "hash": "Hash", "task": "Task", "repo": "Repo", "budget": "Budget", "scope": "Scope", "selections": "Selections",
    "reachable": "Reachable", "gaps": "Gaps", "feasibility": "Feasibility", "generation_metadata": "Generation Metadata",
}


def nothing(name: str) -> Column:
    return F.lit(None).cast("string").alias(name)


def text(c: Column) -> Column:
    return c.cast("string")


def selection_changes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Of selections (task_id, path, load_mode): added, removed and load_mode_changed paths."""
    rows = a.select("task_id", "path", F.col("load_mode").alias("a")).join(b.select("task_id", "path", F.col("load_mode").alias("b")), ["task_id", "path"], "full_outer")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "load_mode_changed")
    return rows.select("task_id", F.lit("selections").alias("section"), change.alias("change"), F.col("path").alias("item"), "a", "b").where("change is not null")


def reachable_changes(a: DataFrame, b: DataFrame, chosen_b: DataFrame) -> DataFrame:
    """Of reachable files (task_id, path): added, removed, and promoted where b selects what a could only reach."""
    chosen = chosen_b.select("task_id", "path", F.lit(True).alias("chosen")).distinct()
    rows = a.select("task_id", "path", F.lit(True).alias("in_a")).join(b.select("task_id", "path", F.lit(True).alias("in_b")), ["task_id", "path"], "full_outer")
    rows = rows.where("in_a is null or in_b is null").join(chosen, ["task_id", "path"], "left")
    change = F.when(F.col("in_a").isNull(), "added").when(F.col("chosen"), "promoted").otherwise("removed")
    return rows.select("task_id", F.lit("reachable").alias("section"), change.alias("change"), F.col("path").alias("item"), nothing("a"), nothing("b"))


def gap_changes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Of gaps (task_id, ordinal, type, severity, description), matched by type and description: added, resolved, severity_changed."""

    def last(rows: DataFrame, side: str) -> DataFrame:
        return rows.groupBy("task_id", "type", "description").agg(F.max(F.struct("ordinal", "severity"))["severity"].alias(side))

    rows = last(a, "a").join(last(b, "b"), ["task_id", "type", "description"], "full_outer")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "resolved").when(F.col("a") != F.col("b"), "severity_changed")
    return rows.select("task_id", F.lit("gaps").alias("section"), change.alias("change"), F.concat_ws(": ", "type", "description").alias("item"), "a", "b").where("change is not null")


def set_changes(a: DataFrame, b: DataFrame, section: str, name: str) -> DataFrame:
    """Of sets (task_id, item): elements added and removed."""
    rows = a.select("task_id", "item", F.lit(True).alias("in_a")).distinct().join(b.select("task_id", "item", F.lit(True).alias("in_b")).distinct(), ["task_id", "item"], "full_outer")
    change = F.when(F.col("in_a").isNull(), f"{name}_added").when(F.col("in_b").isNull(), f"{name}_removed")
    return rows.select("task_id", F.lit(section).alias("section"), change.alias("change"), "item", nothing("a"), nothing("b")).where("change is not null")


def value_changes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Of values (task_id, section, item, value): those that differ; a missing one counts as null."""
    rows = a.withColumnRenamed("value", "a").join(b.withColumnRenamed("value", "b"), ["task_id", "section", "item"], "full_outer")
    return rows.where(~F.col("a").eqNullSafe(F.col("b"))).select("task_id", "section", F.lit("changed").alias("change"), "item", "a", "b")


def values(manifests: DataFrame) -> DataFrame:
    """task_id, section, item, value of what a manifest has once."""
    m = F.col("manifest")
    held = {
        "hash": {"manifest_hash": F.col("manifest_hash"), "config_digest": m["config_digest"]},
        "task": {"type": m["task"]["type"]},
        "repo": {"fingerprint": m["repo"]["fingerprint"]},
        "budget": {"model": m["budget"]["model"], "token_ceiling": m["budget"]["token_ceiling"], "effective_context": m["budget"]["budget"], "estimator": m["budget"]["estimator"]},
        "scope": {"scope": m["scope"]},
        "feasibility": {"score": m["feasibility"]["score"]} | {s: m["feasibility"]["sub_signals"][s] for s in ("coverage", "anchor_resolution", "task_specificity", "budget_headroom", "gap_penalty")},
        "generation_metadata": {"version": m["version"], "selection_logic_version": m["selection_logic_version"]},
    }
    rows = [F.struct(F.lit(s).alias("section"), F.lit(n).alias("item"), text(c).alias("value")) for s, cs in held.items() for n, c in cs.items()]
    return manifests.select("task_id", F.explode(F.array(*rows)).alias("v")).select("task_id", "v.*")


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """All differences of the tasks that both sides have."""
    a, b = a.join(b.select("task_id"), "task_id", "left_semi"), b.join(a.select("task_id"), "task_id", "left_semi")

    def listed(side: DataFrame, column: str) -> DataFrame:
        return side.select("task_id", F.explode(f"manifest.{column}").alias("x")).select("task_id", "x.*")

    def items(side: DataFrame, column: str) -> DataFrame:
        return side.select("task_id", F.explode(f"manifest.{column}").alias("item"))

    def gaps(side: DataFrame) -> DataFrame:
        return side.select("task_id", F.posexplode("manifest.gaps").alias("ordinal", "x")).select("task_id", "ordinal", "x.type", "x.severity", "x.description")

    texts = a.select("task_id", F.col("manifest.task.raw_text").alias("x")).join(b.select("task_id", F.col("manifest.task.raw_text").alias("y")), "task_id").where("x <> y")
    first = texts.select("task_id", F.lit("task").alias("section"), F.lit("text_first_diff").alias("change"), first_difference(F.col("x"), F.col("y")).alias("item"), nothing("a"), nothing("b"))
    return reduce(
        DataFrame.unionByName,
        [
            value_changes(values(a), values(b)),
            set_changes(items(a, "task.anchors"), items(b, "task.anchors"), "task", "anchors"),
            first,
            set_changes(items(a, "repo.language_hints"), items(b, "repo.language_hints"), "repo", "language_hints"),
            selection_changes(listed(a, "selections"), listed(b, "selections")),
            reachable_changes(listed(a, "reachable"), listed(b, "reachable"), listed(b, "selections")),
            gap_changes(gaps(a), gaps(b)),
        ],
    )


def documents(a: DataFrame, b: DataFrame) -> DataFrame:
    """task_id, semantic_equivalent (equal hashes), json and markdown of each task's differences, every section named.

    Differences beside equal hashes are a fault of the emitter, and listed as such.
    """
    rows = differences(a, b)
    same = a.select("task_id", F.col("manifest_hash").alias("x")).join(b.select("task_id", F.col("manifest_hash").alias("y")), "task_id").select("task_id", (F.col("x") == F.col("y")).alias("semantic_equivalent"))
    held = rows.groupBy("task_id").agg(F.sort_array(F.collect_list(F.struct("section", "change", "item", "a", "b"))).alias("all"))
    rows = same.join(held, "task_id", "left").withColumn("all", F.coalesce("all", F.array().cast(rows_type(held))))

    def of(section: str) -> Column:
        return F.filter("all", lambda r: r["section"] == section)

    def detail(r: Column) -> Column:
        return F.struct(r["change"].alias("change"), r["item"].alias("item"), r["a"].alias("a"), r["b"].alias("b"))

    sections = [F.struct((F.size(of(s)) == 0).alias("unchanged"), F.when(F.size(of(s)) > 0, F.transform(of(s), detail)).alias("details")).alias(s) for s in SECTIONS]
    bugs = F.when(F.col("semantic_equivalent"), F.array_distinct(F.transform("all", lambda r: r["section"]))).otherwise(F.array().cast("array<string>"))
    whole = F.struct(F.lit("1.0").alias("schema_version"), "semantic_equivalent", bugs.alias("tool_bug_diagnostic"), *sections)

    def line(r: Column) -> Column:
        sides = F.when(r["a"].isNotNull() | r["b"].isNotNull(), F.concat(F.lit(": "), F.coalesce(r["a"], F.lit("-")), F.lit(" -> "), F.coalesce(r["b"], F.lit("-")))).otherwise("")
        return F.concat(F.lit("- "), r["change"], F.lit(" `"), r["item"], F.lit("`"), sides)

    body = [F.concat(F.lit(f"## {t}\n\n"), F.when(F.size(of(s)) == 0, "_unchanged_").otherwise(F.array_join(F.transform(of(s), line), "\n"))) for s, t in SECTIONS.items()]
    head = F.concat(F.lit("# Manifest Diff\n\n- semantic_equivalent: "), text(F.col("semantic_equivalent")))
    return rows.select("task_id", "semantic_equivalent", F.to_json(whole).alias("json"), F.concat(F.concat_ws("\n\n", head, *body), F.lit("\n")).alias("markdown"))


def rows_type(held: DataFrame) -> str:
    return held.schema["all"].dataType.simpleString()
