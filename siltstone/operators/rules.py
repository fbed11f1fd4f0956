"""Gap rules over a batch of tasks, and their numbering.

tasks: task_id, type, anchors; assigned: task_id, path, load_mode, score, demoted_reason; files:
path, language, package, symbols, side_effects; supplemental: category, path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.paths import config_for_gap, external_contract, is_test_for_gap
from .tasks import has_anchor

# Fixed value: the order in which gaps are numbered.
ORDER = [
    "missing_spec", "missing_tests", "missing_config_context", "unresolved_symbol_dependency", "ambiguous_ownership",
    "missing_runtime_path", "missing_external_contract", "oversized_primary_context", "task_underspecified",
]
REMEDIES = {
    "missing_spec": ["Write down what the change must do.", "Point the task at an existing specification."],
    "missing_tests": ["Name the tests that cover the change.", "Add tests beside the files that change."],
    "missing_config_context": ["Name the configuration files concerned."],
    "unresolved_symbol_dependency": ["Check the spelling of the symbol.", "Name the package that declares it."],
    "ambiguous_ownership": ["Say which file of the package owns the behaviour."],
    "missing_runtime_path": ["Name the entry point that the change runs through."],
    "missing_external_contract": ["Add the schema or interface description to the context."],
    "oversized_primary_context": ["Raise the budget.", "Narrow the task to part of the files."],
    "task_underspecified": ["Name files, symbols or packages in the task."],
}


def without(tasks: DataFrame, assigned: DataFrame, condition: Column) -> DataFrame:
    """Tasks none of whose assignments meets the condition."""
    return tasks.join(assigned.where(condition).select("task_id").distinct(), "task_id", "left_anti")


def gap(rows: DataFrame, kind: str, detail: Column, severity: str = "warning") -> DataFrame:
    return rows.select("task_id", F.lit(kind).alias("type"), F.lit(severity).alias("severity"), detail.alias("description"))


def unresolved_symbols(tasks: DataFrame, files: DataFrame) -> DataFrame:
    """Up to five capitalised anchors of a task that no Go file declares, in order of their lower case."""
    declared = files.where("language = 'go'").select(F.explode(F.transform("symbols", F.lower)).alias("low")).distinct()
    names = tasks.select("task_id", F.explode("anchors").alias("name")).where(F.col("name").rlike("^[A-Z][A-Za-z0-9_]{2,}$")).withColumn("low", F.lower("name"))
    place = F.row_number().over(W.partitionBy("task_id").orderBy("low", "name"))
    return names.join(declared, "low", "left_anti").withColumn("place", place).where("place <= 5").select("task_id", "name")


def ambiguous(tasks: DataFrame, assigned: DataFrame, files: DataFrame) -> DataFrame:
    """Tasks whose best file's package has two other files of 0.60 and none of 0.80."""
    place = F.row_number().over(W.partitionBy("task_id").orderBy(F.col("score").desc(), "path"))
    top = assigned.withColumn("place", place).where("place = 1").select("task_id", F.col("path").alias("top"), F.col("score").alias("best"))
    own = files.where("language = 'go'").select("path", "package")
    top = top.join(own.withColumnRenamed("path", "top"), "top").where("best < 0.8")
    peers = assigned.join(own, "path").join(top, ["task_id", "package"]).where("path <> top")
    return peers.groupBy("task_id", "package").agg(F.sum((F.col("score") >= 0.6).cast("int")).alias("near"), F.max("score").alias("most")).where("near >= 2 and most < 0.8")


def gaps(tasks: DataFrame, assigned: DataFrame, files: DataFrame, supplemental: DataFrame, underflow: DataFrame, blocking: tuple[str, ...] = ()) -> DataFrame:
    """task_id, ordinal, id, type, severity, description of every gap, numbered by rule and description."""
    kinds = F.col("type")
    about = assigned.join(files.select("path", "language", "side_effects"), "path")
    go = files.where("language = 'go'").select(F.lit(True).alias("has_go")).limit(1)
    with_go = tasks.join(F.broadcast(go))
    said = supplemental.where("category in ('spec', 'agents')").select(F.lit(True).alias("said")).limit(1)
    over = underflow.where("underflow")
    demoted = assigned.where("demoted_reason is not null").groupBy("task_id").agg(F.min(F.struct("path", "demoted_reason")).alias("d"))
    best = assigned.groupBy("task_id").agg(F.max("score").alias("best"))
    found = [
        gap(tasks.where(kinds.isin("feature", "refactor", "migration", "investigation")).join(F.broadcast(said), F.lit(True), "left_anti"), "missing_spec", F.lit("no specification is present")),
        gap(without(tasks.where(kinds.isin("feature", "bugfix", "refactor", "migration")), assigned, (F.col("score") >= 0.5) & is_test_for_gap(F.col("path"))), "missing_tests", F.lit("no relevant test is selected")),
        gap(without(tasks.where(has_anchor(F.col("anchors"), K.CONFIG_GAP)), assigned, config_for_gap(F.col("path"))), "missing_config_context", F.lit("no configuration is selected")),
        gap(unresolved_symbols(with_go, files), "unresolved_symbol_dependency", F.concat(F.lit("symbol not found: "), F.col("name"))),
        gap(ambiguous(tasks.where(kinds.isin("bugfix", "feature", "refactor")), assigned.join(tasks.where(kinds.isin("bugfix", "feature", "refactor")).select("task_id"), "task_id"), files), "ambiguous_ownership", F.concat(F.lit("several files could own this: "), F.col("package")), "info"),
        gap(without(with_go.where(kinds.isin("feature", "bugfix", "migration") & has_anchor(F.col("anchors"), K.RUNTIME_GAP)), about, (F.col("language") == "go") & F.exists("side_effects", lambda t: t.startswith("io:"))), "missing_runtime_path", F.lit("no file with side effects is selected")),
        gap(without(tasks.where(has_anchor(F.col("anchors"), K.CONTRACT_GAP)), assigned, external_contract(F.col("path"))), "missing_external_contract", F.lit("no external contract is selected")),
        gap(demoted.join(over, "task_id", "left_anti"), "oversized_primary_context", F.concat(F.lit("not loaded in full: "), F.col("d.path"))),
        gap(tasks.join(best, "task_id", "left").where(F.coalesce("best", F.lit(0.0)) < 0.6), "task_underspecified", F.lit("no file scores 0.60")),
        gap(over, "oversized_primary_context", F.lit("the best file exceeds the budget"), "blocking"),
    ]
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    if blocking:
        rows = rows.withColumn("severity", F.when(F.col("type").isin(*blocking), "blocking").otherwise(F.col("severity")))
    rank = F.array_position(F.array(*map(F.lit, ORDER)), F.col("type"))
    first = F.when((F.col("type") == "oversized_primary_context") & (F.col("severity") == "blocking"), 0).otherwise(1)
    place = F.row_number().over(W.partitionBy("task_id").orderBy(first, rank, "description"))
    return rows.withColumn("ordinal", place).select("task_id", "ordinal", F.concat(F.lit("gap-"), "ordinal").alias("id"), "type", "severity", "description")


def with_remedies(gaps: DataFrame) -> DataFrame:
    table = F.create_map(*[c for k, v in REMEDIES.items() for c in (F.lit(k), F.array(*map(F.lit, v)))])
    return gaps.withColumn("suggested_remediation", F.try_element_at(table, F.col("type")))
