"""From evaluation cases to a verdict: plans of every case, metrics, hard failures, comparison with a baseline."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators import evaluate, report
from ..sources import files, fixtures
from ..sources.shared import written
from .repository import plan_repository

#: From this score on a forbidden file fails its case.
FORBIDDEN = 0.30


@dataclass(frozen=True)
class Run:
    """metrics and failures (name, reason) of all cases, results against the baseline, and the verdict (one row)."""

    metrics: DataFrame
    failures: DataFrame
    results: DataFrame
    verdict: DataFrame


def planned(spark: SparkSession, cases: fixtures.Fixtures) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Assigned files (name, path, load_mode, score), gaps (name, type) and errors (name, reason) of every case.

    A case is a repository of its own, so each is a plan of its own: one after the other, as what they
    give is written.
    """
    assigned, gaps, errors = [], [], [spark.createDataFrame([], "name string, reason string")]
    for case in cases.cases.orderBy("name").toLocalIterator():
        root = f"{case.dir}/repo"
        try:
            files.verify_tree(spark, root, case.repo_fingerprint)
            text, markdown = fixtures.task_text(spark, case.dir, case.task, case.task_file)
        except (ValueError, files.NotPlain) as e:
            errors.append(spark.createDataFrame([(case.name, str(e))], "name string, reason string"))
            continue
        texts = spark.createDataFrame([(case.name, text, markdown)], "task_id string, raw_text string, markdown boolean")
        plan, _ = plan_repository(spark, root, texts, Config.of({"budget": case.budget, "model": case.model}), manifests=False)
        assigned.append(plan.assigned.select(F.col("task_id").alias("name"), "path", "load_mode", "score"))
        gaps.append(plan.gaps.select(F.col("task_id").alias("name"), "type"))
    empty = (spark.createDataFrame([], "name string, path string, load_mode string, score double"), spark.createDataFrame([], "name string, type string"))
    return tuple(written(reduce(DataFrame.unionByName, rows, first), "evaluated") for rows, first in zip((assigned, gaps), empty, strict=True)) + (reduce(DataFrame.unionByName, errors),)


def hard_failures(cases: fixtures.Fixtures, assigned: DataFrame, gaps: DataFrame) -> DataFrame:
    """name and reason of forbidden files that score too well, and of expected gaps that aren't there."""
    found = assigned.where(F.col("score") >= FORBIDDEN).join(cases.forbidden, "name").where(F.expr("path rlike regex"))
    where = F.when(F.col("load_mode") == "reachable", "reachable").otherwise("selections")
    forbidden = found.select("name", F.concat(F.lit("forbidden path "), "path", F.lit(" appears in "), where, F.lit(" at score >= 0.30")).alias("reason")).distinct()
    missing = cases.gaps.join(gaps.distinct(), ["name", "type"], "left_anti")
    return forbidden.unionByName(missing.select("name", F.concat(F.lit("expected gap "), "type", F.lit(" not present")).alias("reason")))


def run(spark: SparkSession, folder: str, baseline: str | None = None, tolerance: float = 0.02) -> Run:
    """The verdict over all cases below folder; without a baseline (or where its path holds none) it is a first run."""
    cases = fixtures.load(spark, folder)
    assigned, gaps, errors = planned(spark, cases)
    picked = assigned.where("load_mode <> 'reachable'")
    metrics = written(evaluate.metrics(cases.cases, cases.selections, picked), "metrics")
    failures = hard_failures(cases, assigned, gaps).unionByName(errors)
    held = report.load_baseline(spark, baseline) if baseline else None
    results = report.results(metrics, held, failures, tolerance)
    return Run(metrics, failures, results, report.verdict(results, held is None))
