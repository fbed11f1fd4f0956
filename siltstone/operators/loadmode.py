"""Load-mode calibration: what a plan that demotes nothing would change.

Plan A packs as usual; plan B takes every file that may be loaded in full in full, whatever it costs. Both are
one batch: tasks, candidates and budgets are doubled under ids that end in the plan's letter, so one packing,
one pass of the rules and one of feasibility serve both, and differences are joins on the task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import rounded
from ..sources.shared import written
from . import feasibility, pack, rules
from .evaluate import variant_diff
from .report import PER_RUN

A, B = "A", "B"


def doubled(rows: DataFrame) -> DataFrame:
    return rows.withColumn("plan", F.explode(F.array(F.lit(A), F.lit(B)))).withColumn("task_id", F.concat("task_id", "plan"))


def of_plan(rows: DataFrame, plan: str) -> DataFrame:
    """The rows of one plan, under the tasks' own ids (which are text)."""
    return rows.where(F.col("task_id").endswith(plan)).withColumn("task_id", F.expr("substr(task_id, 1, length(task_id) - 1)"))


@dataclass(frozen=True)
class Variants:
    """Tables of both plans: assigned, gaps and feasible by doubled id; overflow by the tasks' ids."""

    assigned: DataFrame
    gaps: DataFrame
    feasible: DataFrame
    overflow: DataFrame


def packed(eligible: DataFrame, budgets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Assignments of both plans by doubled id, and task_id and overflow of plan B."""
    pairs, limits = pack.mode_rows(doubled(eligible)), doubled(budgets)
    forced = (F.col("plan") == B) & (F.col("mode") == "full")
    spent = pairs.where(forced).groupBy("task_id").agg(F.sum("cost").alias("spent"))
    left = limits.join(spent, "task_id", "left").select("task_id", (F.col("budget") - F.coalesce("spent", F.lit(0))).alias("budget"))
    chosen = pack.greedy(pack.full_first(pairs, (F.col("plan") == B) & F.col("full")), limits.select("task_id", "budget"), forced)
    overflow = of_plan(left, B).select("task_id", F.greatest(F.lit(0), -F.col("budget")).cast("bigint").alias("overflow"))
    return pack.assignments(doubled(eligible), chosen), overflow


def demoted(eligible: DataFrame, budgets: DataFrame) -> DataFrame:
    """task_id, path, mode_a of files that plan A selects below full and plan B loads in full.

    Plan B loads in full what may be, whatever else it packs; so plan A's choices, which keep that mark, tell both.
    """
    chosen = pack.greedy(pack.mode_rows(eligible), budgets, keep=("full",))
    return chosen.where("full and mode <> 'full'").select("task_id", "path", F.col("mode").alias("mode_a"))


def variants(tasks: DataFrame, eligible: DataFrame, files: DataFrame, supplemental: DataFrame, budgets: DataFrame, blocking: tuple[str, ...] = ()) -> Variants:
    """Both plans of every task, from its candidates on."""
    assigned, overflow = packed(eligible, budgets)
    assigned = written(assigned, "assigned-both")
    both, limits = doubled(tasks), doubled(budgets)
    gaps = written(rules.gaps(both, assigned, files, supplemental, pack.underflow(doubled(eligible), limits), blocking), "gaps-both")
    return Variants(assigned, gaps, feasibility.compute(both, assigned, files, gaps, limits), overflow)


def report(found: Variants) -> DataFrame:
    """For each task: demoted_in_a (path, score, tokens), tokens_gained, feasibility_delta, gaps in one plan only, overflow_tokens, would_underflow."""
    a, b = of_plan(found.assigned, A), of_plan(found.assigned, B)
    low = variant_diff(a, b).join(a.select("task_id", "path", "score", "cost"), ["task_id", "path"])
    low = low.groupBy("task_id").agg(F.sort_array(F.collect_list(F.struct("path", rounded(F.col("score"), 4).alias("score"), F.col("cost").alias("tokens")))).alias("demoted_in_a"))
    spent = found.assigned.groupBy("task_id").agg(F.sum("cost").alias("spent"))
    spent = of_plan(spent, A).join(of_plan(spent, B).withColumnRenamed("spent", "forced"), "task_id", "full_outer")
    types = found.gaps.select("task_id", "type").distinct()
    held = of_plan(types, A).withColumn("a", F.lit(True)).join(of_plan(types, B).withColumn("b", F.lit(True)), ["task_id", "type"], "full_outer")
    held = held.where("a is null or b is null").groupBy("task_id").agg(*[F.sort_array(F.collect_list(F.when(F.col(other).isNull(), F.col("type")))).alias(f"gaps_{own}_only") for own, other in (("a", "b"), ("b", "a"))])
    feasible = of_plan(found.feasible.select("task_id", "score"), A).join(of_plan(found.feasible.select("task_id", F.col("score").alias("forced_score")), B), "task_id")
    rows = feasible.join(found.overflow, "task_id").join(low, "task_id", "left").join(spent, "task_id", "left").join(held, "task_id", "left")
    none = F.array().cast("array<string>")
    return rows.select(
        "task_id",
        F.coalesce("demoted_in_a", F.array().cast(low.schema["demoted_in_a"].dataType)).alias("demoted_in_a"),
        F.greatest(F.lit(0), F.coalesce("forced", F.lit(0)) - F.coalesce("spent", F.lit(0))).cast("bigint").alias("tokens_gained"),
        (F.col("forced_score") - F.col("score")).alias("feasibility_delta"),
        F.coalesce("gaps_a_only", none).alias("gaps_a_only"),
        F.coalesce("gaps_b_only", none).alias("gaps_b_only"),
        F.col("overflow").alias("overflow_tokens"),
        (F.col("overflow") > 0).alias("would_underflow"),
    )


def markdown(rows: DataFrame, checks: DataFrame | None = None) -> DataFrame:
    """task_id and a section of Markdown for each task; checks (task_id, a_passed, b_passed) adds the outcome of a check of both plans."""
    checks = rows.sparkSession.createDataFrame([], "task_id string, a_passed boolean, b_passed boolean") if checks is None else checks
    delta = F.when(~F.col("a_passed") & F.col("b_passed"), "IMPROVEMENT").when(F.col("a_passed") & ~F.col("b_passed"), "REGRESSION").when(F.col("a_passed"), "NO_CHANGE_PASS").otherwise("NO_CHANGE_FAIL")

    def line(text: str, value: Column) -> Column:
        return F.concat(F.lit(text), value, F.lit("\n"))

    entries = F.array_join(F.transform("demoted_in_a", lambda d: F.concat(F.lit("  - `"), d["path"], F.format_string("` (score=%.4f, tokens=%d)\n", d["score"], d["tokens"]))), "")
    body = F.concat(
        F.lit("### "), F.col("task_id"), F.lit("\n\n"),
        line("- Tokens gained by forcing: ", F.col("tokens_gained").cast("string")),
        line("- Budget overflow: ", F.format_string("%d tokens", "overflow_tokens")),
        line("- Forced-full would underflow: ", F.col("would_underflow").cast("string")),
        line("- Feasibility delta: ", F.format_string("%+.4f", "feasibility_delta")),
        F.when(F.size("demoted_in_a") > 0, F.concat(F.lit("- Demoted in A (held at full in B):\n"), entries)).otherwise(""),
        *[F.when(F.size(f"gaps_{p}_only") > 0, line(f"- Gaps fired in {p.upper()} only: ", F.array_join(f"gaps_{p}_only", ", "))).otherwise("") for p in ("a", "b")],
        F.when(F.col("a_passed").isNotNull(), line("- Delta: **", F.concat(delta, F.lit("**")))).otherwise(""),
    )
    return rows.join(checks, "task_id", "left").select("task_id", body.alias("markdown"))


def document(sections: DataFrame, advice: str | None, per_run: dict[str, str]) -> DataFrame:
    """One row: the report of a bounded set of cases, what changes from run to run last."""
    head = "# Load-Mode Calibration\n\n## Advisory\n\n" + (advice or "_no recommendation: plan A does not pass materially less often than plan B._") + "\n\n## Fixtures\n\n"
    tail = f"\n{PER_RUN}\n\n" + "".join(f"- {k}: {v}\n" for k, v in per_run.items())
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("task_id", "markdown"))), lambda s: s["markdown"]), "\n")
    return sections.agg(F.concat(F.lit(head), whole, F.lit(tail)).alias("markdown"))
