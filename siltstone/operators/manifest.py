"""Plans as nested documents: assembly, canonical hash, Markdown and explanations.

A manifest is one row per task. Hashing needs a JSON text that doesn't depend on the writer:
keys sorted, no spaces, numbers in shortest form without exponent; Spark's to_json has another
number format, so the manifest's own small JSON goes through one Arrow function per batch.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import __version__ as VERSION
from ..functions import constants as K
from ..functions.paths import tier
from ..functions.text import rounded
from . import feasibility
from .rules import with_remedies
from .score import FACTORS, breakdown

# What the hash leaves out, the id's prefix, phrases for factors.
VOLATILE = ["manifest_hash", "manifest_id", "generated_at"]
ID_PREFIX = "apt_"
PHRASES = {
    "mention": "direct task mention", "filename": "filename token match", "symbol": "exported symbol match", "import": "import adjacency",
    "package": "package match", "test": "associated tests", "doc": "documentation overlap", "config": "configuration file",
}


def number(x) -> str:
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, int):
        return str(x)
    if x == int(x) and abs(x) < 1e21:
        return "-0" if x == 0 and str(x)[0] == "-" else str(int(x))
    return format(Decimal(repr(x)), "f")


def canonical(value) -> str:
    """JSON with sorted keys and no spaces; <, >, & and line separators are escaped."""
    if value is None:
        return "null"
    if isinstance(value, dict):
        return "{" + ",".join(f"{canonical(k)}:{canonical(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, str):
        out = json.dumps(value, ensure_ascii=False)
        for c in "<>&  ":
            out = out.replace(c, f"\\u{ord(c):04x}")
        return out
    return number(value)


def digest(value: dict) -> str:
    return "sha256:" + hashlib.sha256(canonical({k: v for k, v in value.items() if k not in VOLATILE}).encode()).hexdigest()


def rationale(rows: DataFrame) -> DataFrame:
    """task_id, path, rationale: phrases of the factors that count, strongest first."""
    parts = F.array(*[F.struct((-F.col(f)).alias("s"), F.lit(f).alias("factor"), F.lit(PHRASES[f]).alias("phrase")) for f in FACTORS])
    kept = F.array_sort(F.filter(parts, lambda p: p["s"] < 0))
    return rows.select("task_id", "path", F.transform(kept, lambda p: p["phrase"]).alias("rationale"))


SUB_SIGNALS = ["coverage", "anchor_resolution", "task_specificity", "budget_headroom", "gap_penalty"]
#: What a task may ask for.
EXPECTS = ["expects_tests", "expects_config", "expects_docs", "expects_migration", "expects_api"]
#: What a manifest says of its run: literals that assemble() takes.
ABOUT = {"model": "", "token_ceiling": 0, "estimator": "heuristic-3.5", "estimator_version": "v1", "reserve": K.RESERVE, "root": "", "source": "", "scope": "", "fingerprint": "", "config_digest": "", "version": VERSION}


def listing(rows: DataFrame, *columns: str) -> DataFrame:
    """One row with all of rows as a sorted list, for what is said once of a repository."""
    return rows.agg(F.sort_array(F.collect_set(F.struct(*columns) if len(columns) > 1 else F.col(columns[0]))).alias("all"))


def assemble(
    tasks: DataFrame, assigned: DataFrame, scores: DataFrame, gaps: DataFrame, feasible: DataFrame, budgets: DataFrame,
    files: DataFrame | None = None, supplemental: DataFrame | None = None, exclusions: DataFrame | None = None, about: dict | None = None, underflow: DataFrame | None = None,
) -> DataFrame:
    """task_id and one nested manifest per task, with manifest_hash and manifest_id.

    files (language), supplemental (category, path) and exclusions (path, reason) are of the whole repository;
    underflow (task_id, underflow) tells which plans are incomplete.
    """
    spark = tasks.sparkSession
    say = ABOUT | (about or {})
    why = assigned.join(rationale(scores), ["task_id", "path"], "left")
    picked = F.struct("path", "load_mode", rounded(F.col("score"), 4).alias("relevance_score"), F.col("cost").alias("estimated_tokens"), "demoted_reason", "rationale")
    plans = why.groupBy("task_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("load_mode") != "reachable", picked))).alias("selections"),
        F.sort_array(F.collect_list(F.when(F.col("load_mode") == "reachable", F.struct("path", rounded(F.col("score"), 4).alias("relevance_score"), F.lit("plausibly_relevant").alias("reason"))))).alias("reachable"),
        F.sum("cost").alias("spent"),
    )
    fields = ["id", "type", "severity", "description", "suggested_remediation"]
    gap_list = with_remedies(gaps).groupBy("task_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", *fields))), lambda g: F.struct(*[g[f].alias(f) for f in fields])).alias("gaps"))
    rows = tasks.select("task_id", F.struct(F.lit(say["source"]).alias("source"), "type", "objective", "anchors", "raw_text", *[c if c in tasks.columns else F.lit(False).alias(c) for c in EXPECTS]).alias("task")).join(budgets, "task_id").join(plans, "task_id", "left").join(gap_list, "task_id", "left")
    parts = breakdown(scores).groupBy("task_id", "path").agg(F.sort_array(F.collect_list(F.struct("factor", rounded(F.col("signal"), 4).alias("signal"), "weight", rounded(F.col("contribution"), 4).alias("contribution")))).alias("breakdown"))
    parts = assigned.where("load_mode <> 'reachable'").select("task_id", "path").join(parts, ["task_id", "path"]).groupBy("task_id").agg(F.sort_array(F.collect_list(F.struct("path", "breakdown"))).alias("breakdowns"))
    rows = rows.join(parts, "task_id", "left")
    short = spark.createDataFrame([], rows.select("task_id").schema).withColumn("underflow", F.lit(True)) if underflow is None else underflow
    rows = rows.join(short.select("task_id", "underflow"), "task_id", "left")
    empty = {"languages": (files, "language string", "language"), "supplementals": (supplemental, "category string, path string", "category", "path"), "exclusions": (exclusions, "path string, reason string", "path", "reason")}
    for name, (frame, schema, *columns) in empty.items():
        rows = rows.join(F.broadcast(listing(spark.createDataFrame([], schema) if frame is None else frame.where(F.col(columns[0]) != ""), *columns).withColumnRenamed("all", name)))
    numbers = F.struct(*[rounded(F.col(c), 4).alias(c) for c in SUB_SIGNALS])
    why = feasibility.reasons(feasible, gaps)
    rows = rows.join(feasible.join(why, "task_id").select("task_id", F.struct(rounded(F.col("score"), 4).alias("score"), "assessment", numbers.alias("sub_signals"), "positives", "negatives", "blocking_conditions").alias("feasibility")), "task_id")
    tiers = F.map_from_entries(F.transform("languages", lambda x: F.struct(x.alias("language"), tier(x).alias("tier"))))
    spent = F.struct("budget", F.coalesce("spent", F.lit(0)).alias("spent"), *[F.lit(say[c]).alias(c) for c in ("model", "token_ceiling", "estimator", "estimator_version")], F.struct(*[F.lit(n).cast("bigint").alias(k) for k, n in say["reserve"].items()]).alias("reserved"))
    empties = {c: F.coalesce(c, F.array().cast(rows.schema[c].dataType)) for c in ("selections", "reachable", "gaps", "breakdowns")}
    rows = rows.withColumns(empties)
    whole = F.struct(
        F.lit("1.0").alias("schema_version"), F.lit("sel-v2").alias("selection_logic_version"), F.lit(say["version"]).alias("version"), F.lit(say["config_digest"]).alias("config_digest"), F.lit(say["scope"]).alias("scope"),
        F.struct(F.lit(say["root"]).alias("root"), F.lit(say["fingerprint"]).alias("fingerprint"), F.col("languages").alias("language_hints")).alias("repo"), tiers.alias("language_tiers"),
        F.coalesce("underflow", F.lit(False)).alias("incomplete"), "task_id", "task", spent.alias("budget"), "selections", "reachable", "supplementals", "exclusions", "gaps", "feasibility", "breakdowns",
    )
    rows = rows.select("task_id", whole.alias("manifest"), hashed(F.to_json(whole)).alias("manifest_hash"))
    return rows.withColumn("manifest_id", F.concat(F.lit(ID_PREFIX), F.substring("manifest_hash", 8, 16)))


def hashed(texts: Column) -> Column:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: digest(json.loads(t)))

    return F.pandas_udf(run, "string")(texts)


def bullets(items: Column, line, none: str = "_(none)_") -> Column:
    lines = F.array_join(F.transform(items, line), "\n")
    return F.when(F.coalesce(F.size(items), F.lit(0)) > 0, lines).otherwise(none)


def four(x: Column) -> Column:
    """A score as it is shown: four digits."""
    return F.format_string("%.4f", x)


def said(text: str, value: Column) -> Column:
    """A line, or nothing where there is no value."""
    return F.when(F.coalesce(F.length(value), F.lit(0)) > 0, F.concat(F.lit(text), value))


def markdown(manifests: DataFrame) -> DataFrame:
    """task_id and the manifest as Markdown."""
    m = F.col("manifest")
    task, budget, repo, feasible = m["task"], m["budget"], m["repo"], m["feasibility"]

    def selection(s: Column, mode: Column) -> Column:
        head = F.concat(F.lit("- `"), s["path"], F.lit("` — "), mode, F.lit("score "), four(s["relevance_score"]), F.lit(", tokens "), s["estimated_tokens"].cast("string"))
        return F.concat_ws("\n", head, said("  - demotion_reason: ", s["demoted_reason"]), said("  - rationale: ", F.array_join(s["rationale"], "; ")))

    def gap(g: Column) -> Column:
        head = F.concat(F.lit("- **"), g["id"], F.lit("** ["), g["type"], F.lit("/"), g["severity"], F.lit("] — "), g["description"])
        return F.array_join(F.concat(F.array(head), F.transform(g["suggested_remediation"], lambda r: F.concat(F.lit("  - remediation: "), r))), "\n")

    expects = F.concat(F.lit("- expects:"), *[F.when(task[c], F.lit(" " + c.removeprefix("expects_"))).otherwise("") for c in EXPECTS])
    full = F.filter(m["selections"], lambda s: s["load_mode"] == "full")
    summaries = F.filter(m["selections"], lambda s: s["load_mode"] != "full")
    reserved = F.concat_ws(" ", *[F.concat(F.lit(f"{k}="), budget["reserved"][k].cast("string")) for k in manifests.schema["manifest"].dataType["budget"].dataType["reserved"].dataType.fieldNames()])
    usage = [
        "1. Load every file under **Selected Full Context** as it is.",
        "2. Use the entries under **Selected Summaries** in place of their files; open a file only where its summary leaves a question open.",
        "3. Take **Reachable Context** as a list to look things up in; fetch its files on demand.",
        "4. Settle every **blocking** gap before doing what can't be undone; pass warnings on.",
    ]
    sections = [
        ("Task Summary", F.concat_ws("\n", F.concat(F.lit("- task_id: "), m["task_id"]), F.concat(F.lit("- type: "), task["type"]), said("- source: ", task["source"]), F.concat(F.lit("- objective: "), task["objective"]), said("- anchors: ", F.array_join(task["anchors"], ", ")), expects)),
        ("Planning Assumptions", F.concat_ws("\n", said("- repo_root: ", repo["root"]), said("- repo_fingerprint: ", repo["fingerprint"]), said("- scope: ", m["scope"]), said("- language_hints: ", F.array_join(repo["language_hints"], ", ")), said("- model: ", budget["model"]), F.concat(F.lit("- token_ceiling: "), budget["token_ceiling"].cast("string")), F.concat(F.lit("- effective_context_budget: "), budget["budget"].cast("string")))),
        ("Selected Full Context", bullets(full, lambda s: selection(s, F.lit("")), "_(none selected as full)_")),
        ("Selected Summaries", bullets(summaries, lambda s: selection(s, F.concat(s["load_mode"], F.lit(", "))), "_(none selected as summaries)_")),
        ("Reachable Context", bullets(m["reachable"], lambda r: F.concat(F.lit("- `"), r["path"], F.lit("` — score "), four(r["relevance_score"]), F.lit(" ("), r["reason"], F.lit(")")))),
        ("Gaps", bullets(m["gaps"], gap)),
        ("Feasibility", F.concat_ws("\n", F.concat(F.lit("- score: "), four(feasible["score"]), F.lit(" ("), feasible["assessment"], F.lit(")")), *[F.concat(F.lit(f"  - {c}: "), four(feasible["sub_signals"][c])) for c in SUB_SIGNALS], said("- positives: ", F.array_join(feasible["positives"], "; ")), said("- negatives: ", F.array_join(feasible["negatives"], "; ")), said("- **blocking**: ", F.array_join(feasible["blocking_conditions"], "\n- **blocking**: ")))),
        ("Supplemental Files", bullets(m["supplementals"], lambda r: F.concat(F.lit("- `"), r["path"], F.lit("` ("), r["category"], F.lit(")")))),
        ("Exclusions", bullets(m["exclusions"], lambda r: F.concat(F.lit("- `"), r["path"], F.lit("`: "), r["reason"]))),
        ("Token Accounting", F.concat_ws("\n", F.concat(F.lit("- estimator: "), budget["estimator"], F.lit(" ("), budget["estimator_version"], F.lit(")")), F.concat(F.lit("- token_ceiling: "), budget["token_ceiling"].cast("string")), F.concat(F.lit("- reserved: "), reserved), F.concat(F.lit("- effective_context_budget: "), budget["budget"].cast("string")), F.concat(F.lit("- estimated_selected_tokens: "), budget["spent"].cast("string")))),
        ("Usage Instructions", F.concat(F.lit("\n".join(usage)), F.when(m["incomplete"], F.lit("\n\n> **Warning:** this plan is `incomplete`: nothing that matters most fits the budget. Plan again with a larger one before going on.")).otherwise(""))),
    ]
    head = F.concat(F.lit("# Plan "), F.col("manifest_id"), F.lit("\n\n- schema_version: "), m["schema_version"], F.lit("\n- manifest_hash: "), F.col("manifest_hash"), F.when(m["incomplete"], "\n- incomplete: true").otherwise(""), F.lit("\n\n"))
    body = F.concat_ws("\n\n", *[F.concat(F.lit(f"## {title}\n\n"), F.coalesce(c, F.lit(""))) for title, c in sections])
    return manifests.select("task_id", F.concat(head, body, F.lit("\n")).alias("markdown"))


def explain(manifests: DataFrame) -> DataFrame:
    """task_id and, as plain text, why each file was taken: its mode, score, phrases, and the factors with what they gave."""
    m = F.col("manifest")
    given = F.map_from_entries(F.transform(m["breakdowns"], lambda b: F.struct(b["path"], b["breakdown"])))

    def factor(b: Column) -> Column:
        return F.concat(F.lit("      "), b["factor"], F.lit(" "), four(b["signal"]), F.lit(" x "), four(b["weight"]), F.lit(" = "), four(b["contribution"]))

    def line(s: Column) -> Column:
        head = F.concat(F.lit("  "), s["path"], F.lit(" ["), s["load_mode"], F.lit("] "), four(s["relevance_score"]), F.lit(" "), F.array_join(s["rationale"], ", "))
        return F.array_join(F.concat(F.array(head), F.transform(F.coalesce(F.try_element_at(given, s["path"]), F.array().cast(BREAKDOWN)), factor)), "\n")

    gaps = F.transform(m["gaps"], lambda g: F.concat(F.lit("  gap "), g["type"], F.lit(" ("), g["severity"], F.lit("): "), g["description"]))
    text = F.concat(F.lit("task "), F.col("task_id"), F.lit(": "), m["task"]["type"], F.lit("\n"), bullets(m["selections"], line), F.when(F.size(gaps) > 0, F.concat(F.lit("\n"), F.array_join(gaps, "\n"))).otherwise(""))
    return manifests.select("task_id", F.concat(text, F.lit("\n  feasibility "), four(m["feasibility"]["score"]), F.lit(" "), m["feasibility"]["assessment"]).alias("explanation"))


BREAKDOWN = "array<struct<factor:string,signal:double,weight:double,contribution:double>>"


def pretty(manifests: DataFrame) -> DataFrame:
    """task_id and the manifest as indented JSON with its hash and id, ending in a line break."""
    whole = F.to_json(F.struct("manifest_id", "manifest_hash", "manifest.*"), {"ignoreNullFields": "false"})

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: json.dumps(json.loads(t), indent=2, ensure_ascii=False) + "\n")

    return manifests.select("task_id", F.pandas_udf(run, "string")(whole).alias("json"))


def gates(manifests: DataFrame, fail_on_gaps: bool = False, least: float | None = None) -> DataFrame:
    """task_id and exit_code: 9 where nothing of the best fits the budget, then 8 for a blocking gap where that fails, 7 below the least feasibility, else 0."""
    m = F.col("manifest")
    blocked = F.exists(F.coalesce(m["gaps"], F.array().cast("array<struct<id:string,type:string,severity:string,description:string,suggested_remediation:array<string>>>")), lambda g: g["severity"] == "blocking")
    code = F.when(m["incomplete"], 9).when(F.lit(fail_on_gaps) & blocked, 8).when(m["feasibility"]["score"] < least if least is not None else F.lit(False), 7).otherwise(0)
    return manifests.select("task_id", code.alias("exit_code"))
