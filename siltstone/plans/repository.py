"""From a folder and task texts to manifests: the walk, the analysers, the index and the plan together."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from ..config import Config
from ..functions import constants as K
from ..operators import index, manifest, schema_check
from ..operators import tasks as parsing
from ..sources import analyze, files
from ..sources.cache import AnalysisCache
from ..sources.shared import written
from .plan import Plan


def indexed(spark: SparkSession, root: str, config: Config, scope: str | None = None, cache: AnalysisCache | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """files as Plan takes them, imports (path, import) and exclusions (path, reason) of a folder; a cache gives results of files that haven't changed."""
    kept, out = files.walk(spark, root, config.exclude, [] if config.disable_defaults else K.EXCLUSIONS)
    rows = index.scoped(kept, index.supplementals(kept), index.scope_of(scope))
    rows = written(analyze.analyze(rows) if cache is None else cache.analyze(rows).drop("key"), "analysed")
    package = F.when(F.col("language") == "go", F.regexp_extract("text", r"(?m)^package (\w+)", 1)).otherwise("")
    exported = F.filter("symbols", lambda s: s["exported"])
    made = rows.withColumnRenamed("size", "size_bytes").withColumns({"details": exported, "package_name": package, "symbols": F.transform(exported, lambda s: s["name"])})
    return made.drop("content", "imports"), rows.select("path", F.explode("imports").alias("import")).distinct(), out


def plan_repository(spark: SparkSession, root: str, texts: DataFrame, config: Config = Config(), scope: str | None = None, cache: AnalysisCache | None = None, manifests: bool = True) -> tuple[Plan, DataFrame | None]:  # noqa: B008
    """The plan of all texts (task_id, raw_text, markdown) over a folder, and its manifests (or None, if they aren't wanted)."""
    made, imports, out = indexed(spark, root, config, scope, cache)
    budgets = texts.select("task_id", F.lit(config.effective_budget()).cast("bigint").alias("budget"))
    plan = Plan(parsing.parse(texts), made, imports, budgets, config.scoring(), config.blocking, estimator=config.estimator())
    if not manifests:
        return plan, None
    digest = files.fingerprint(made.withColumnRenamed("size_bytes", "size"), __version__).first()["fingerprint"]
    about = {"model": config.model, "estimator": config.estimator().identity, "estimator_version": config.estimator().version, "reserve": config.reserve, "root": root, "token_ceiling": config.budget, "scope": scope or "", "fingerprint": digest, "config_digest": config.digest()}
    return plan, plan.manifests(out, about)


def write_artifacts(manifests: DataFrame, folder: str) -> None:
    """Manifests as JSON and Markdown, a row for each task, below folder."""
    manifests.select("task_id", "manifest_id", "manifest_hash", F.to_json("manifest").alias("manifest")).write.mode("overwrite").json(f"{folder}/manifests")
    manifest.markdown(manifests).write.mode("overwrite").json(f"{folder}/markdown")


def write_files(manifests: DataFrame, folder: str) -> DataFrame:
    """Three files for each manifest below folder, named by its hash or id; task_id and their paths.

    They are the manifest as indented JSON and as Markdown, and a run document: the Markdown, a rule, the task's
    text. A manifest that breaks its schema is an error. Names and contents depend on the manifest alone, so a
    task that runs again writes the same.
    """
    bad = schema_check.violations(manifests, "manifest", schema_check.MANIFEST).where(F.size("violations") > 0).select("task_id", "violations").take(5)
    if bad:
        raise ValueError("; ".join(f"{r.task_id}: {', '.join(r.violations[:5])}" for r in bad))
    rows = manifests.select("task_id", "manifest_id", "manifest_hash", F.col("manifest.task.raw_text").alias("text"))
    rows = rows.join(manifest.pretty(manifests), "task_id").join(manifest.markdown(manifests), "task_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base, _ = files.store_of(folder)
        store.create_dir(base, recursive=True)
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                name = r.manifest_hash.removeprefix("sha256:")
                held = {f"manifest-{name}.json": r.json, f"manifest-{name}.md": r.markdown, f"run-{r.manifest_id}.md": f"{r.markdown}\n---\n\n{r.text}"}
                for path, body in held.items():
                    with store.open_output_stream(f"{base}/{path}") as f:
                        f.write(body.encode("utf-8", "replace"))
                out.append((r.task_id, *held))
            yield pd.DataFrame(out, columns=["task_id", "json", "markdown", "run"])

    return written(rows.mapInPandas(run, "task_id string, json string, markdown string, run string"), "artefacts")


def read_manifests(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    """Manifests that write_artifacts wrote, with the columns of like; those of another major version are an error."""
    rows = spark.read.schema("task_id string, manifest_id string, manifest_hash string, manifest string").json(f"{folder}/manifests")
    rows = rows.withColumn("manifest", F.from_json("manifest", like.schema["manifest"].dataType))
    if rows.where(F.col("manifest").isNull() | ~F.col("manifest.schema_version").startswith("1.")).select("task_id").first():
        raise ValueError("a manifest can't be read, or is of another version")
    return rows.select(like.columns)
