"""Evaluation of plans: set metrics, regressions, term counts, plan variants, percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import rounded


def metrics(cases: DataFrame, expected: DataFrame, actual: DataFrame, weighted: bool = True) -> DataFrame:
    """name, n_expected, n_actual, precision, recall, f1.

    cases: name; expected: name, path, load_mode (null: any); actual: name, path, load_mode. A hit in
    another mode counts half. Nothing selected has precision 1, nothing expected recall 1.
    """
    hit = expected.join(actual.select("name", "path", F.col("load_mode").alias("got")), ["name", "path"])
    worth = F.when(F.lit(not weighted) | F.col("load_mode").isNull() | (F.col("load_mode") == F.col("got")), 1.0).otherwise(0.5)
    hits = hit.groupBy("name").agg(F.sum(worth).alias("hits"))
    rows = cases.select("name").distinct()
    for table, column in ((expected, "n_expected"), (actual, "n_actual")):
        rows = rows.join(table.groupBy("name").agg(F.count(F.lit(1)).alias(column)), "name", "left")
    rows = rows.join(hits, "name", "left").fillna({"n_expected": 0, "n_actual": 0, "hits": 0.0})
    p = F.when(F.col("n_actual") == 0, 1.0).otherwise(F.col("hits") / F.greatest(F.lit(1), F.col("n_actual")))
    r = F.when(F.col("n_expected") == 0, 1.0).otherwise(F.col("hits") / F.greatest(F.lit(1), F.col("n_expected")))
    rows = rows.withColumns({"precision": p, "recall": r})
    both = F.col("precision") + F.col("recall")
    f1 = F.when(both == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / F.when(both == 0, 1.0).otherwise(both))
    return rows.select("name", "n_expected", "n_actual", "precision", "recall", f1.alias("f1"))


def regressions(current: DataFrame, baseline: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """name and status of every case: regressed (F1 fell by more than tolerance), orphaned (only in the baseline), unreferenced (only in the run), ok; with both F1."""
    b = baseline.select("name", F.col("f1").alias("baseline_f1"), F.lit(True).alias("in_b"))
    rows = current.select("name", "f1", F.lit(True).alias("in_c")).join(b, "name", "full_outer")
    worse = F.col("baseline_f1") - F.col("f1") > tolerance
    status = F.when(F.col("in_c").isNull(), "orphaned").when(F.col("in_b").isNull(), "unreferenced").when(worse, "regressed").otherwise("ok")
    return rows.select("name", status.alias("status"), "f1", "baseline_f1")


def variant_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """task_id, path of files that plan A selects below full and plan B loads in full, whatever their scores (a, b: task_id, path, load_mode)."""
    low = a.where("load_mode not in ('full', 'reachable')").select("task_id", "path", F.col("load_mode").alias("mode_a"))
    return low.join(b.where("load_mode = 'full'").select("task_id", "path"), ["task_id", "path"])


def check_delta(a: Column, b: Column) -> Column:
    return F.when(a & b, "both_pass").when(a & ~b, "a_only").when(~a & b, "b_only").otherwise("both_fail")


def advisory(rows: DataFrame, least: float = 10.0) -> DataFrame:
    """name, rate_a, rate_b, advise: whether plan B passes at least least percentage points more (rows: name, a, b booleans)."""
    rate = {c: F.avg(F.col(c).cast("int")) * 100 for c in ("a", "b")}
    out = rows.groupBy("name").agg(rate["a"].alias("rate_a"), rate["b"].alias("rate_b"))
    return out.select("name", rounded(F.col("rate_a"), 4).alias("rate_a"), rounded(F.col("rate_b"), 4).alias("rate_b"), (F.col("rate_b") - F.col("rate_a") >= least).alias("advise"))


def percentiles(samples: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """key, cold (first sample), warm (median of the rest) and nearest-rank p95."""
    # values are counted before ranks are taken, so that a key's samples are never gathered
    first = samples.groupBy(key).agg(F.min(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))).alias("t")).select(key, F.col("t.v").alias("cold"))
    counts = samples.groupBy(key, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    rows = counts.join(first, key).withColumn("later", F.col("n") - (F.col("v") == F.col("cold")).cast("int"))
    upto, whole = W.partitionBy(key).orderBy("v"), W.partitionBy(key)
    rows = rows.withColumns({c: F.sum(c).over(upto) for c in ("n", "later")} | {f"all_{c}": F.sum(c).over(whole) for c in ("n", "later")})

    def at(c: str, p: float) -> Column:
        return F.min(F.when(F.col(c) >= F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col(f"all_{c}"))), F.col("v")))

    return rows.groupBy(key).agg(F.first("cold").alias("cold"), at("later", 0.5).alias("warm"), at("n", 0.95).alias("p95"))
