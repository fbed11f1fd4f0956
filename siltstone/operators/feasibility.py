"""Feasibility of a plan: five sub-signals, a score, a verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.paths import lookup
from ..functions.text import basename, clamp01

# Fixed values.
SHARE = {"full": 1.0, "structural_summary": 0.5, "behavioral_summary": 0.3}
COVERAGE, RESOLUTION, SPECIFICITY, HEADROOM = 0.40, 0.25, 0.20, 0.15


def coverage(tasks: DataFrame, assigned: DataFrame) -> DataFrame:
    counts = assigned.groupBy("task_id").agg(*[F.sum((F.col("load_mode") == m).cast("int")).alias(m) for m in SHARE])
    expected = F.greatest(F.lit(3), lookup({k: str(v) for k, v in K.EXPECTED_FILES.items()}, F.col("type")).cast("int"))
    n = {m: F.coalesce(m, F.lit(0)) for m in SHARE}
    value = n["full"] + 0.5 * n["structural_summary"] + 0.3 * n["behavioral_summary"]
    return tasks.select("task_id", "type").join(counts, "task_id", "left").select("task_id", F.least(F.lit(1.0), value / expected).alias("coverage"))


def resolution(tasks: DataFrame, assigned: DataFrame, files: DataFrame) -> DataFrame:
    """The share of anchors that a selected path segment, path run or symbol name answers."""
    anchors = tasks.select("task_id", F.size("anchors").alias("n"), F.explode("anchors").alias("anchor"))
    anchors = anchors.select("task_id", "n", "anchor", F.lower("anchor").alias("low"))
    picked = assigned.where("load_mode <> 'reachable'").join(files.select("path", "symbols"), "path").select("task_id", F.lower("path").alias("p"), F.transform("symbols", F.lower).alias("symbols"))
    parts = F.split("p", "/")
    stem = F.regexp_replace(basename(F.col("p")), r"(?<=.)\.[^.]*$", "")
    starts = F.sequence(F.lit(1), F.size(parts))
    runs = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.size(parts) - i + 1), lambda k: F.array_join(F.slice(parts, i, k), "/"))))
    segments = picked.select("task_id", F.explode(F.array_distinct(F.concat(runs, F.array(stem)))).alias("low")).distinct()
    by_path = anchors.join(segments, ["task_id", "low"], "left_semi")
    blob = picked.select("task_id", F.explode("symbols").alias("name")).distinct()
    by_symbol = anchors.join(blob, "task_id").where(F.expr("contains(name, low)")).select(anchors.columns)
    hits = by_path.unionByName(by_symbol).select("task_id", "anchor").distinct().groupBy("task_id").agg(F.count(F.lit(1)).alias("hits"))
    return tasks.select("task_id", F.size("anchors").alias("n")).join(hits, "task_id", "left").select("task_id", F.when(F.col("n") > 0, F.coalesce("hits", F.lit(0)) / F.col("n")).otherwise(0.0).alias("anchor_resolution"))


def specificity(kind: Column, anchors: Column) -> Column:
    endings = "|".join(K.TASK_EXTENSIONS)
    explicit = F.exists(anchors, lambda a: a.contains("/") | F.lower(a).rlike(rf".\.({endings})$"))
    acts = kind.isin("bugfix", "feature", "refactor", "test-addition", "migration")
    n = F.size(anchors)
    return F.when((n >= 3) & acts & explicit, 1.0).when((n >= 2) & (kind != "unknown"), 0.7).when(n >= 1, 0.4).otherwise(0.1)


def assessment(score: Column) -> Column:
    return F.when(score >= 0.85, "high feasibility").when(score >= 0.65, "moderate feasibility").when(score >= 0.40, "weak feasibility").otherwise("poor feasibility")


def reasons(feasible: DataFrame, gaps: DataFrame) -> DataFrame:
    """task_id, positives, negatives (sub-signals of 0.50 on and below, with their values) and blocking_conditions."""
    factors = ("coverage", "anchor_resolution", "task_specificity", "budget_headroom")
    lines = F.array(*[F.struct(F.format_string(f"{f}=%.2f", F.col(f)).alias("line"), (F.col(f) >= 0.5).alias("good")) for f in factors])
    penalty = F.when(F.col("gap_penalty") > 0, F.array(F.format_string("gap_penalty=%.2f", F.col("gap_penalty")))).otherwise(F.array().cast("array<string>"))
    blocking = gaps.where("severity = 'blocking'").groupBy("task_id").agg(F.sort_array(F.collect_list(F.concat_ws(": ", "type", "description"))).alias("blocking_conditions"))
    return feasible.join(blocking, "task_id", "left").select(
        "task_id",
        F.transform(F.filter(lines, lambda x: x["good"]), lambda x: x["line"]).alias("positives"),
        F.concat(F.transform(F.filter(lines, lambda x: ~x["good"]), lambda x: x["line"]), penalty).alias("negatives"),
        F.coalesce("blocking_conditions", F.array().cast("array<string>")).alias("blocking_conditions"),
    )


def compute(tasks: DataFrame, assigned: DataFrame, files: DataFrame, gaps: DataFrame, budgets: DataFrame) -> DataFrame:
    """task_id, the five sub-signals, score and assessment."""
    spent = assigned.groupBy("task_id").agg(F.sum("cost").alias("spent"))
    counts = gaps.groupBy("task_id").agg(F.sum((F.col("severity") == "warning").cast("int")).alias("warn"), F.sum((F.col("severity") == "blocking").cast("int")).alias("block"))
    rows = tasks.select("task_id", specificity(F.col("type"), F.col("anchors")).alias("task_specificity"))
    rows = rows.join(coverage(tasks, assigned), "task_id").join(resolution(tasks, assigned, files), "task_id")
    rows = rows.join(budgets, "task_id").join(spent, "task_id", "left").join(counts, "task_id", "left")
    room = F.when(F.col("budget") > 0, clamp01((F.col("budget") - F.coalesce("spent", F.lit(0))) / F.col("budget"))).otherwise(0.0)
    penalty = F.least(F.lit(0.5), 0.05 * F.coalesce("warn", F.lit(0)) + 0.2 * F.coalesce("block", F.lit(0)))
    rows = rows.withColumns({"budget_headroom": room, "gap_penalty": penalty})
    base = clamp01(COVERAGE * F.col("coverage") + RESOLUTION * F.col("anchor_resolution") + SPECIFICITY * F.col("task_specificity") + HEADROOM * F.col("budget_headroom")) - F.col("gap_penalty")
    capped = F.greatest(F.lit(0.0), F.when(F.coalesce("block", F.lit(0)) > 0, F.least(F.lit(0.4), base)).otherwise(base))
    rows = rows.withColumn("score", capped)
    return rows.select("task_id", "coverage", "anchor_resolution", "task_specificity", "budget_headroom", "gap_penalty", "score", assessment(F.col("score")).alias("assessment"))
