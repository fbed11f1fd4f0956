"""From tasks and files to manifests, for a batch of tasks at once.

tasks: task_id and what operators.tasks.parse adds; files: path, extension, language, package,
is_test, size_bytes, symbols (names), text, and for the summaries' costs details
(array<struct<name, kind, receiver, exported>>), package_name and parse_error; imports: path,
import; budgets: task_id, budget (effective tokens). Tables that several others read are written
once in the shared folder.
"""

from __future__ import annotations

import copy

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.estimator import Estimator
from ..operators import feasibility, index, manifest, pack, rules, score, summary
from ..sources.shared import written


def with_costs(files: DataFrame, imports: DataFrame, links: DataFrame, estimator: Estimator = Estimator()) -> DataFrame:  # noqa: B008
    """files with side_effects and the tokens of the whole file and of its two summaries."""
    lists = {
        "imports": imports.groupBy("path").agg(F.sort_array(F.collect_set("import")).alias("imports")),
        "side_effects": index.side_effects(imports).groupBy("path").agg(F.sort_array(F.collect_set("tag")).alias("side_effects")),
        "test_links": links.groupBy("path").agg(F.sort_array(F.collect_set("link")).alias("test_links")),
    }
    rows = files
    for name, part in lists.items():
        rows = rows.join(part, "path", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))

    def of(name: str) -> F.Column:
        return F.col("details" if name == "symbols" else name)

    rows = rows.withColumn("cost_full", estimator.tokens(F.col("text"), F.col("size_bytes")) + pack.FULL)
    costs = {
        "cost_structural": estimator.tokens(summary.structural(of)) + pack.SUMMARY,
        "cost_behavioral": estimator.tokens(summary.behavioral(F.col("cost_full"), of)) + pack.SUMMARY,
    }
    return rows.withColumns(costs).drop("imports", "test_links", "details", "package_name", "parse_error")


class Plan:
    def __init__(self, tasks: DataFrame, files: DataFrame, imports: DataFrame, budgets: DataFrame, settings: score.Settings | None = None, blocking: tuple[str, ...] = (), force_full: bool = False, estimator: Estimator = Estimator()):  # noqa: B008
        self.tasks = written(tasks, "tasks")
        settings = settings or score.Settings()
        links = written(index.test_links(files), "links")
        self.files = written(with_costs(files, imports, links, estimator), "files")
        # files are read only if they are relevant by their names and links; their texts then count for all scores
        self.scores = written(score.Scores(self.tasks, self.files, imports, links, settings).viable(K.BANDS[-1][1]), "scores")
        about = self.files.select("path", "size_bytes", "language", "symbols", "side_effects", "cost_full", "cost_structural", "cost_behavioral")
        rows = self.scores.join(about, "path").select("task_id", "path", "score", (F.col("mention") == 1).alias("mentioned"), "size_bytes", "cost_full", "cost_structural", "cost_behavioral", "language", F.size("symbols").alias("n_symbols"), "side_effects")
        self.eligible = written(pack.with_eligibility(rows), "candidates")
        self.supplemental = index.supplementals(self.files)
        self.blocking, self.force_full = blocking, force_full
        self.pack(budgets)

    def pack(self, budgets: DataFrame) -> None:
        """What depends on the budgets: choices, gaps and feasibility."""
        self.budgets = budgets
        pairs = pack.mode_rows(self.eligible)
        chosen = pack.forced_full(pairs, budgets)[0] if self.force_full else pack.greedy(pairs, budgets)
        self.assigned = written(pack.assignments(self.eligible, chosen), "assigned")
        self.underflow = pack.underflow(self.eligible, budgets)
        self.gaps = written(rules.gaps(self.tasks, self.assigned, self.files, self.supplemental, self.underflow, self.blocking), "gaps")
        self.feasibility = feasibility.compute(self.tasks, self.assigned, self.files, self.gaps, budgets)

    def under(self, budgets: DataFrame) -> Plan:
        """The same tasks, files and scores under other budgets."""
        other = copy.copy(self)
        other.pack(budgets)
        return other

    def manifests(self, exclusions: DataFrame | None = None, about: dict | None = None) -> DataFrame:
        """task_id, manifest (nested), manifest_hash, manifest_id."""
        return manifest.assemble(self.tasks, self.assigned, self.scores, self.gaps, self.feasibility, self.budgets, self.files, self.supplemental, exclusions, about, self.underflow)
