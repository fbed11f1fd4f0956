"""Costs, bands, eligibility and packing under a token budget.

Candidates: task_id, path, score, mentioned, size_bytes, cost_full, cost_structural,
cost_behavioral, language, n_symbols, side_effects array<string>.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.paths import plays_role
from ..functions.text import rounded, tokens_heuristic


# Tokens that a whole file and a summary cost beyond their text.
FULL, SUMMARY = 32, 24
#: Pairs whose costs are compared with what is left at once.
BLOCK = 1024


def full_tokens(n_bytes: Column) -> Column:
    return tokens_heuristic(n_bytes) + FULL


def summary_tokens(n_bytes: Column) -> Column:
    return tokens_heuristic(n_bytes) + SUMMARY


def score_band(score: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, least in K.BANDS:
        out = out.when(score >= least, name)
    return out.otherwise("low")


def size_band(n_bytes: Column, tokens: Column) -> Column:
    small, medium = (n_bytes <= 8 << 10) & (tokens <= 2000), (n_bytes <= 32 << 10) & (tokens <= 8000)
    return F.when(small, "small").when(medium, "medium").otherwise("large")


def with_eligibility(candidates: DataFrame) -> DataFrame:
    """Candidates with band, size_band and the modes they may be loaded in (reachable aside)."""
    rows = candidates.withColumns({"band": score_band(F.col("score")), "size_band": size_band(F.col("size_bytes"), F.col("cost_full"))})
    near = F.col("band").isin("highly_relevant", "moderately_relevant")
    full = ((F.col("band") == "highly_relevant") | F.col("mentioned")) & (F.col("size_band") != "large")
    structural = near & (F.col("language") == "go") & (F.col("n_symbols") > 0)
    tags = F.size(F.filter("side_effects", lambda t: t.startswith("io:")))
    behavioral = near & (~structural | (tags >= 2) | plays_role(F.col("path")))
    return rows.withColumns({"full": full, "structural_summary": structural, "behavioral_summary": behavioral})


def mode_rows(eligible: DataFrame) -> DataFrame:
    """One row for each candidate and mode it may have, with cost, quantised efficiency and priority."""
    cost = {"full": "cost_full", "structural_summary": "cost_structural", "behavioral_summary": "cost_behavioral"}
    modes = [F.when(F.col(m), F.struct(F.lit(m).alias("mode"), F.col(c).cast("bigint").alias("cost"), F.lit(K.MODE_WEIGHT[m]).alias("weight"), F.lit(K.MODE_PRIORITY[m]).alias("priority"))) for m, c in cost.items()]
    rows = eligible.withColumn("m", F.explode(F.array(*modes))).where("m is not null").select("*", "m.*").drop("m")
    return rows.withColumn("efficiency", rounded(F.col("score") * F.col("weight") / F.greatest(F.lit(1), F.col("cost")), 9))


def taken(batches: Iterator[pd.DataFrame], limits: tuple[str, ...] = ("budget",), keep: tuple[str, ...] = ()) -> Iterator[pd.DataFrame]:
    """The pairs that are chosen under each limit, of a stream in order of tasks and of efficiency within each.

    Forced pairs come first and are taken whatever they cost. What a task has left only falls, so pairs that exceed
    it are passed over together. Held are the paths taken so far, each of which cost something: their number is
    bounded by the budgets, not by the candidates.
    """
    task, left, paths = None, [], []
    for batch in batches:
        out = [[] for _ in limits]
        ids = batch["task_id"].to_numpy()
        for first, last in runs(ids):
            if task is None or ids[first] != task:
                task, left, paths = ids[first], [int(batch[n].iat[first]) for n in limits], [set() for _ in limits]
            cost, path = batch["cost"].to_numpy()[first:last], batch["path"].to_numpy()[first:last]
            free = int(batch["forced"].to_numpy()[first:last].sum())
            for k, rows in enumerate(out):
                rows.extend(range(first, first + free))
                left[k] -= int(cost[:free].sum())
                at = free
                while at < len(cost):
                    # the next that fits, found among those of one block at a time
                    fits = np.flatnonzero(cost[at : at + BLOCK] <= left[k])
                    for i in (fits + at).tolist():
                        if cost[i] <= left[k] and path[i] not in paths[k]:
                            left[k] -= int(cost[i])
                            paths[k].add(path[i])
                            rows.append(first + i)
                    at += BLOCK
        yield pd.concat([batch.iloc[rows][["task_id", "path", "mode", "cost", *keep]].assign(plan=n) for n, rows in zip(limits, out, strict=True)])


def runs(values: np.ndarray) -> list[tuple[int, int]]:
    """First and last places of each run of equal values."""
    cut = np.flatnonzero(values[1:] != values[:-1]) + 1
    return list(zip([0, *cut], [*cut, len(values)], strict=True)) if len(values) else []


def greedy(pairs: DataFrame, budgets: DataFrame, forced: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """task_id, path, mode, cost chosen in order of efficiency while the budget lasts, with columns of pairs to keep.

    A pair that doesn't fit is skipped and later ones are still tried, so no running sum can express
    it; sorted partitions are streamed instead, and no task's pairs are ever gathered. Pairs that exceed the
    whole budget are dropped before the shuffle. budgets: task_id, budget. Forced pairs are taken first, whatever
    they cost and whether or not the task has a budget; no path of theirs may have another pair.
    """
    return greedy_each(pairs, budgets, ("budget",), forced, keep).drop("plan")


def greedy_each(pairs: DataFrame, budgets: DataFrame, limits: tuple[str, ...], forced: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """What greedy gives under each of several limits (columns of budgets, whose name is the plan's), in one pass over the pairs."""
    held = budgets.select("task_id", *[F.col(n).cast("bigint").alias(n) for n in limits])
    if forced is None:
        rows = pairs.withColumn("forced", F.lit(False)).join(held, "task_id")
    else:
        rows = pairs.withColumn("forced", F.coalesce(forced, F.lit(False))).join(held, "task_id", "left").fillna(-1, list(limits))
    rows = rows.where(F.col("forced") | (F.col("cost") <= (F.greatest(*limits) if len(limits) > 1 else F.col(limits[0]))))
    order = [F.col("forced").desc(), F.col("efficiency").desc(), "cost", "path", F.col("priority").desc(), "mode"]
    rows = rows.repartition("task_id").sortWithinPartitions("task_id", *order).select("task_id", "path", "mode", "cost", "forced", *limits, *keep)
    kind = {n: rows.schema[n].dataType.simpleString() for n in ("task_id", "path", *keep)}
    schema = ", ".join(["task_id " + kind["task_id"], "path " + kind["path"], "mode string", "cost bigint", *[f"{n} {kind[n]}" for n in keep], "plan string"])
    return rows.mapInPandas(lambda batches: taken(batches, limits, keep), schema)


def full_first(pairs: DataFrame, full: Column) -> DataFrame:
    """pairs without the summaries of those files that are taken in full."""
    return pairs.where((F.col("mode") == "full") | ~F.coalesce(full, F.lit(False)))


def forced_full(pairs: DataFrame, budgets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The plan that demotes nothing: every full-eligible file in full whatever it costs, the rest as usual.

    pairs as mode_rows gives them, which say of each whether its file may be taken in full: so forced files and the
    rest are packed in one pass. Gives the choices, and task_id with overflow (what the forced files exceed the budget by).
    """
    forced = F.col("mode") == "full"
    spent = pairs.where(forced).groupBy("task_id").agg(F.sum("cost").alias("spent"))
    left = budgets.join(spent, "task_id", "left").select("task_id", (F.col("budget") - F.coalesce("spent", F.lit(0))).alias("budget"))
    overflow = left.select("task_id", F.greatest(F.lit(0), -F.col("budget")).cast("bigint").alias("overflow"))
    return greedy(full_first(pairs, F.col("full")), budgets, forced), overflow


def assignments(eligible: DataFrame, chosen: DataFrame) -> DataFrame:
    """The chosen files with demotions, and all others of a band as reachable at no cost."""
    rows = eligible.join(chosen, ["task_id", "path"], "left").where("mode is not null or band <> 'low'")
    lowered = (F.col("band") == "highly_relevant") & F.col("mode").isNotNull() & (F.col("mode") != "full")
    reason = F.when(lowered, F.when((F.col("size_band") != "large") & F.col("full"), "budget_insufficient").otherwise("size_band=large"))
    return rows.select("task_id", "path", F.coalesce("mode", F.lit("reachable")).alias("load_mode"), "score", F.coalesce("cost", F.lit(0)).cast("bigint").alias("cost"), reason.alias("demoted_reason"))


def underflow(eligible: DataFrame, budgets: DataFrame) -> DataFrame:
    """task_id, underflow: the best candidate (0.30 at least) has a mode, and none that fits the budget."""
    top = eligible.withColumn("place", F.rank().over(W.partitionBy("task_id").orderBy(F.col("score").desc()))).where("place = 1 and score >= 0.3")
    least = mode_rows(top).groupBy("task_id").agg(F.min("cost").alias("least"))
    return budgets.join(least, "task_id", "left").select("task_id", F.coalesce(F.col("budget") < F.col("least"), F.lit(False)).alias("underflow"))


def effective_budget(ceiling: Column) -> Column:
    return F.greatest(F.lit(0), ceiling - sum(K.RESERVE.values()))
