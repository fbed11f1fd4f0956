"""Baselines and reports of evaluation runs.

metrics: name, precision, recall, f1 (operators.evaluate.metrics); failures: name, reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .evaluate import regressions

# The version of baselines, and the heading that starts what differs from run to run.
BASELINE_VERSION, PER_RUN = "1.0", "## Per-Run Metadata"
METRICS = ["precision", "recall", "f1"]


def write_baseline(metrics: DataFrame, path: str, logic: str, generated_at: str, force: bool = False) -> None:
    """One JSON row for each case, with the versions, in place of what path held.

    A case whose F1 would fall below the one that is held is an error, unless forced.
    """
    held = load_baseline(metrics.sparkSession, path)
    if held is not None and not force:
        lower = metrics.select("name", "f1").join(held.select("name", F.col("f1").alias("held")), "name").where("f1 < held").orderBy("name").select("name").take(20)
        if lower:
            raise ValueError(f"F1 would fall: {', '.join(r.name for r in lower)}")
    stamps = [F.lit(BASELINE_VERSION).alias("schema_version"), F.lit(logic).alias("selection_logic_version"), F.lit(generated_at).alias("generated_at")]
    metrics.select(*stamps, "name", *METRICS).write.mode("overwrite").json(path)


def load_baseline(spark: SparkSession, path: str) -> DataFrame | None:
    """name and metrics of a written baseline, None where there is none (a first run); another version is an error."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None
    rows = spark.read.schema("schema_version string, selection_logic_version string, generated_at string, name string, precision double, recall double, f1 double").json(path)
    other = rows.where(~F.col("schema_version").eqNullSafe(F.lit(BASELINE_VERSION))).select("schema_version").first()
    if other:
        raise ValueError(f"baseline version {other[0]!r} is not supported (expected {BASELINE_VERSION!r})")
    return rows.select("name", *METRICS)


def results(metrics: DataFrame, baseline: DataFrame | None, failures: DataFrame | None = None, tolerance: float = 0.02) -> DataFrame:
    """name, metrics, status, baseline_f1, drop, failures (reasons) of every case, orphaned ones of the baseline included."""
    spark = metrics.sparkSession
    baseline = spark.createDataFrame([], "name string, precision double, recall double, f1 double") if baseline is None else baseline
    failures = spark.createDataFrame([], "name string, reason string") if failures is None else failures
    status = regressions(metrics, baseline, tolerance).select("name", "status", "baseline_f1")
    why = failures.groupBy("name").agg(F.sort_array(F.collect_list("reason")).alias("failures"))
    rows = status.join(metrics.select("name", *METRICS), "name", "left").join(why, "name", "left")
    drop = F.when(F.col("status") == "regressed", F.col("baseline_f1") - F.col("f1"))
    return rows.select("name", *METRICS, "status", "baseline_f1", drop.alias("drop"), F.coalesce("failures", F.array().cast("array<string>")).alias("failures"))


def verdict(rows: DataFrame, bootstrap: bool = False) -> DataFrame:
    """One row: passed, and how many cases failed, regressed, are orphaned or unreferenced (which a first run without baseline may be)."""
    counts = {s: F.count_if(F.col("status") == s) for s in ("regressed", "orphaned", "unreferenced")} | {"failed": F.count_if(F.size("failures") > 0)}
    out = rows.agg(*[c.alias(n) for n, c in counts.items()])
    return out.withColumn("passed", (F.col("regressed") == 0) & (F.col("failed") == 0) & ((F.col("orphaned") == 0) | F.lit(bootstrap)))


def markdown(rows: DataFrame, fixtures: str, baseline: str, tolerance: float, logic: str, per_run: dict[str, str]) -> DataFrame:
    """One row with the report as Markdown; all that changes from run to run comes last, under PER_RUN."""
    all_rows = rows.agg(F.sort_array(F.collect_list(F.struct("name", *METRICS, "status", "baseline_f1", "drop", "failures"))).alias("all"))

    def of(status: str) -> Column:
        return F.filter("all", lambda r: r["status"] == status)

    def four(c: Column) -> Column:
        return F.format_string("%.4f", c)

    def section(title: str, items: Column, line, none: str | None = None) -> Column:
        shown = F.concat(F.lit(f"\n## {title}\n\n"), F.array_join(F.transform(items, line), "\n"), F.lit("\n"))
        return F.when(F.size(items) > 0, shown).otherwise(f"\n## {title}\n\n{none}\n" if none else "")

    ran = F.filter("all", lambda r: r["status"] != "orphaned")
    table = F.transform(ran, lambda r: F.concat(F.lit("| "), F.concat_ws(" | ", r["name"], four(r["precision"]), four(r["recall"]), four(r["f1"]), F.when(F.size(r["failures"]) > 0, "yes").otherwise("")), F.lit(" |")))
    head = f"# Eval Report\n\n- Fixtures dir: `{fixtures}`\n- Baseline path: `{baseline}`\n- Tolerance: `{tolerance:.3f}`\n- Selection logic: `{logic}`\n\n## Summary\n\n| Fixture | Precision | Recall | F1 | Hard fail |\n|---------|-----------|--------|----|-----------|\n"
    body = F.concat(
        F.lit(head), F.array_join(table, "\n"), F.lit("\n"),
        section("Regressions", of("regressed"), lambda r: F.concat(F.lit("- **"), r["name"], F.lit("**: F1 "), four(r["baseline_f1"]), F.lit(" → "), four(r["f1"]), F.lit(" (drop "), four(r["drop"]), F.lit(f", tolerance {tolerance:.4f})")), "_none_"),
        section("Orphaned baseline entries", of("orphaned"), lambda r: F.concat(F.lit("- "), r["name"])),
        section("Current-run fixtures missing from baseline", of("unreferenced"), lambda r: F.concat(F.lit("- "), r["name"])),
        section("Fixture details", F.filter("all", lambda r: F.size(r["failures"]) > 0), lambda r: F.concat(F.lit("### "), r["name"], F.lit("\n\n"), F.array_join(F.transform(r["failures"], lambda x: F.concat(F.lit("- Hard fail: "), x)), "\n"), F.lit("\n"))),
        F.lit(f"\n{PER_RUN}\n\n" + "".join(f"- {k}: {v}\n" for k, v in per_run.items())),
    )
    return all_rows.select(body.alias("markdown"))


def without_per_run(report: Column) -> Column:
    """The report up to what changes from run to run."""
    return F.substring_index(report, PER_RUN, 1)


def as_json(rows: DataFrame, fixtures: str, baseline: str, tolerance: float, logic: str, per_run: dict[str, str]) -> DataFrame:
    """One row with the report as JSON; what changes from run to run is the last field, per_run_metadata."""
    cases = F.sort_array(F.collect_list(F.struct("name", *METRICS, "status", "baseline_f1", "drop", "failures")))
    about = [F.lit(v).alias(k) for k, v in {"schema_version": BASELINE_VERSION, "selection_logic_version": logic, "fixtures_dir": fixtures, "baseline_path": baseline, "tolerance": tolerance}.items()]
    made = F.struct(*[F.lit(v).alias(k) for k, v in per_run.items()]) if per_run else F.create_map()
    return rows.agg(cases.alias("fixtures")).select(F.to_json(F.struct(*about, "fixtures", made.alias("per_run_metadata"))).alias("json"))


def json_without_per_run(report: Column) -> Column:
    return F.regexp_replace(report, r',"per_run_metadata":\{[^{}]*\}\}$', "}")
