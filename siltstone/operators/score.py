"""Scoring of files for tasks.

Scores are kept for the pairs that any signal reaches: mention, filename, symbol, package, doc and
config at first, then those that only an import or a tested file reaches. In all other pairs every
signal and the score are 0; everywhere() adds them where a result lists every file for every task.

Tables: tasks (task_id, raw_text, type, anchors); files (path, extension, language, package,
is_test, symbols array<string>, text); imports (path, import).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.paths import config_for_score
from ..functions.text import alnum_tokens, basename, clamp01, dirname, head_bytes, total
from ..sources.shared import written
from .graph import package_edges, resolve_imports
from .tasks import lower_all

FACTORS = list(K.WEIGHTS)
#: Extensions of files whose text counts.
DOCS = [".md", ".markdown", ".rst", ".adoc"]
LEXICAL = ["mention", "filename", "symbol", "package", "doc"]


@dataclass(frozen=True)
class Settings:
    weights: dict[str, float] = field(default_factory=lambda: dict(K.WEIGHTS))
    floor: float = K.DAMPENER_FLOOR
    slope: float = K.DAMPENER_SLOPE
    dampen: bool = True

    def __post_init__(self):
        if abs(sum(self.weights.values()) - 1) > 1e-3 or set(self.weights) != set(K.WEIGHTS):
            raise ValueError("weights must cover all factors and sum to 1")
        if not (0 <= self.floor <= 1 and 0 <= self.slope <= 1):
            raise ValueError("floor and slope must lie in [0, 1]")


def word_runs(text: Column, names: bool) -> Column:
    """Every two words in a row with what stands between them; of names, or single words where a name has no more; of texts both."""
    words, between = F.regexp_extract_all(text, F.lit("[a-z0-9_]+"), F.lit(0)), F.split(text, "[a-z0-9_]+")
    two = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat(F.element_at(words, i), F.element_at(between, i + 1), F.element_at(words, i + 1)))
    two = F.when(F.size(words) > 1, two).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(words) > 1, two).otherwise(words) if names else F.concat(words, two)


def gaps_of(text: Column) -> Column:
    """What stands between words, each once."""
    return F.array_distinct(F.filter(F.split(text, "[a-z0-9_]+"), lambda g: g != ""))


def mention(tasks: DataFrame, files: DataFrame) -> DataFrame:
    """task_id, path of files whose path or base name the task text has between word boundaries.

    Each name is indexed by its rarest run of two words (or its only word), and meets the texts that
    have that run by equality; names without a word meet parts of what stands between words. The rest of
    the name is compared in the texts it has met.
    """
    names = files.select("path", F.explode(F.array_distinct(F.array(F.lower("path"), F.lower(basename(F.col("path")))))).alias("phrase"))
    texts = tasks.select("task_id", F.lower("raw_text").alias("t")).where("t is not null")
    distinct = names.select("phrase").distinct()
    runs = distinct.select("phrase", F.explode(F.array_distinct(word_runs(F.col("phrase"), True))).alias("run"))
    common = runs.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    rarest = runs.join(common, "run").groupBy("phrase").agg(F.min(F.struct("n", "run")).alias("r")).select("phrase", F.col("r.run").alias("run"))
    asked = texts.select("task_id", F.explode(F.array_distinct(word_runs(F.col("t"), False))).alias("run"))
    bare = distinct.where("phrase not rlike '[a-z0-9_]' and phrase <> ''").select("phrase", F.length("phrase").alias("k"))
    gaps = texts.select("task_id", F.explode(gaps_of(F.col("t"))).alias("gap"))
    lengths = bare.agg(F.sort_array(F.collect_set("k")).alias("lengths"))
    parts = gaps.select("gap").distinct().join(F.broadcast(lengths)).select("gap", F.explode(F.filter("lengths", lambda k: k <= F.length("gap"))).alias("k"))
    parts = parts.select("gap", F.explode(F.transform(F.sequence(F.lit(1), F.length("gap") - F.col("k") + 1), lambda i: F.col("gap").substr(i, F.col("k")))).alias("phrase")).distinct()
    met = rarest.join(asked, "run").select("phrase", "task_id").unionByName(bare.join(parts, "phrase").join(gaps, "gap").select("phrase", "task_id").distinct())
    before, after = "(?:^|[^a-z0-9_])", "(?:$|[^a-z0-9_])"
    found = met.join(texts, "task_id").where(F.expr("contains(t, phrase)")).where(F.expr(f"t rlike concat('{before}\\\\Q', phrase, '\\\\E{after}')"))
    return found.select("task_id", "phrase").join(names, "phrase").select("task_id", "path").distinct()


def anchor_rows(tasks: DataFrame) -> DataFrame:
    return tasks.select("task_id", F.explode(F.array_distinct(lower_all(F.col("anchors")))).alias("anchor"))


def overlap(tasks: DataFrame, tokens: DataFrame) -> DataFrame:
    """task_id, path, signal: Jaccard similarity of a file's tokens (path, tokens) and the task's anchors."""
    sized = tokens.select("path", F.size("tokens").alias("n"), F.explode("tokens").alias("anchor"))
    anchors = anchor_rows(tasks)
    counts = anchors.groupBy("task_id").agg(F.count(F.lit(1)).alias("m"))
    both = sized.join(anchors, "anchor").groupBy("task_id", "path").agg(F.count(F.lit(1)).alias("both"), F.first("n").alias("n"))
    return both.join(counts, "task_id").select("task_id", "path", (F.col("both") / (F.col("n") + F.col("m") - F.col("both"))).alias("signal"))


def filename(tasks: DataFrame, files: DataFrame) -> DataFrame:
    return overlap(tasks, files.select("path", alnum_tokens(basename(F.col("path"))).alias("tokens")))


def doc(tasks: DataFrame, files: DataFrame) -> DataFrame:
    docs = files.where(F.col("extension").isin(*DOCS))
    return overlap(tasks, docs.select("path", alnum_tokens(head_bytes(F.col("text"))).alias("tokens")))


def symbol(tasks: DataFrame, files: DataFrame) -> DataFrame:
    """task_id, path, signal: the share of anchors (copies in other case count) found within the file's symbol names.

    Parts of distinct names, of the lengths that anchors have, meet anchors by equality.
    """
    names = files.select("path", F.explode(F.array_distinct(lower_all(F.col("symbols")))).alias("name"))
    anchors = tasks.select("task_id", F.size("anchors").alias("all"), F.explode(lower_all(F.col("anchors"))).alias("anchor"))
    anchors = anchors.groupBy("task_id", "anchor").agg(F.count(F.lit(1)).alias("times"), F.first("all").alias("all"))
    lengths = anchors.agg(F.collect_set(F.length("anchor")).alias("lengths"))
    starts = lambda k: F.sequence(F.lit(1), F.length("name") - k + 1)
    fitting = F.filter("lengths", lambda k: (k > 0) & (k <= F.length("name")))
    parts = F.flatten(F.transform(fitting, lambda k: F.transform(starts(k), lambda i: F.col("name").substr(i, k))))
    parts = names.select("name").distinct().join(F.broadcast(lengths)).select("name", F.explode(F.array_distinct(parts)).alias("anchor"))
    hits = parts.join(anchors, "anchor").join(names, "name").select("task_id", "path", "anchor", "times", "all").distinct()
    return hits.groupBy("task_id", "path").agg(F.least(F.lit(1.0), F.sum("times") / F.first("all")).alias("signal"))


def package(tasks: DataFrame, files: DataFrame) -> DataFrame:
    """task_id, path, signal: 1 where an anchor names the file's package, 0.7 where it names one beside it."""
    anchors = anchor_rows(tasks)
    dirs = files.where("package <> ''").select("package").distinct().select("package", dirname(F.col("package")).alias("parent"), F.lower("package").alias("whole"), F.lower(basename(F.col("package"))).alias("base"))
    named = dirs.select("package", "parent", F.explode(F.array_distinct(F.array("whole", "base"))).alias("anchor")).join(anchors, "anchor").select("task_id", "package").distinct()
    based = dirs.select("package", "parent", F.col("base").alias("anchor")).join(anchors, "anchor").select("task_id", "parent", F.col("package").alias("other")).distinct()
    beside = dirs.select("package", "parent").join(based, "parent").where("package <> other").select("task_id", "package").distinct()
    found = named.withColumn("signal", F.lit(1.0)).unionByName(beside.withColumn("signal", F.lit(0.7))).groupBy("task_id", "package").agg(F.max("signal").alias("signal"))
    return files.where("package <> ''").select("path", "package").join(found, "package").select("task_id", "path", "signal")


def dampener(signals: list[Column], settings: Settings) -> Column:
    """How far other signals let a mention count."""
    if not settings.dampen:
        return F.lit(1.0)
    return F.least(F.lit(1.0), F.lit(settings.floor) + F.lit(settings.slope) * clamp01(F.greatest(*signals)))


def combined(column: dict[str, Column], damp: Column, settings: Settings) -> Column:
    """The weighted sum in fixed order."""
    return clamp01(total([F.lit(settings.weights[f]) * column[f] * (damp if f == "mention" else F.lit(1.0)) for f in FACTORS]))


def lexical(tasks: DataFrame, files: DataFrame) -> DataFrame:
    """task_id, path and the five lexical signals, for the pairs that any of them reaches."""
    parts = {
        "mention": mention(tasks, files).withColumn("signal", F.lit(1.0)),
        "filename": filename(tasks, files),
        "symbol": symbol(tasks, files),
        "package": package(tasks, files),
        "doc": doc(tasks, files),
    }
    rows = None
    for name, part in parts.items():
        part = part.select("task_id", "path", F.lit(name).alias("factor"), F.col("signal").cast("double").alias("signal"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("task_id", "path").agg(*[F.max(F.when(F.col("factor") == n, F.col("signal")).otherwise(0.0)).alias(n) for n in parts])


def with_facts(rows: DataFrame, tasks: DataFrame, files: DataFrame, settings: Settings) -> DataFrame:
    """Pairs with the lexical signals, with config and the first reading of test, and the score they give."""
    outside = F.col("out_of_scope") if "out_of_scope" in files.columns else F.lit(False)
    about = files.select("path", F.col("package").alias("dir"), "is_test", config_for_score(F.col("path")).alias("is_config"), outside.alias("outside"))
    known = tasks.select("task_id", "type", lower_all(F.col("anchors")).alias("low"))
    rows = rows.join(about, "path").join(known, "task_id")
    config = F.when(~F.col("is_config"), 0.0).when(F.col("type").isin("feature", "migration", "refactor"), 1.0).otherwise(0.5)
    named = F.col("is_test") & F.array_contains("low", F.lower(basename(F.col("dir"))))
    rows = rows.withColumns({"config": config, "named": F.when(named, 0.5).otherwise(0.0), "import": F.lit(0.0)})
    rows = rows.withColumns({c: F.when(F.col("outside"), 0.0).otherwise(F.col(c)) for c in ("symbol", "package")})
    rows = rows.withColumn("test", F.when(F.col("outside"), 0.0).otherwise(F.col("named")))
    return rows.withColumn("pass1", scored(settings, imported=False)[1])


def first_pass(tasks: DataFrame, files: DataFrame, settings: Settings) -> DataFrame:
    """Every pair that has a signal before imports and tested files are known (a test of a named package has package too)."""
    configs = files.where(config_for_score(F.col("path"))).select("path")
    pairs = tasks.select("task_id").crossJoin(configs).withColumns({c: F.lit(0.0) for c in LEXICAL})
    rows = lexical(tasks, files).unionByName(pairs).groupBy("task_id", "path").agg(*[F.max(c).alias(c) for c in LEXICAL])
    return with_facts(rows, tasks, files, settings)


def scored(settings: Settings, imported: bool = True) -> tuple[Column, Column]:
    """Dampener and score from signal columns."""
    others = ["symbol", "filename", "package"] + ["import"] * imported
    damp = dampener([F.col(c) for c in others], settings)
    return damp, combined({f: F.col(f) for f in FACTORS}, damp, settings)


def reachable(files: DataFrame, imports: DataFrame) -> DataFrame:
    """path, dir, near: the packages that a file imports (near), and those that these import; the same for all tasks."""
    dirs = files.where("package <> ''").select(F.col("package").alias("dir")).distinct()
    resolved = resolve_imports(imports, dirs)
    direct = imports.join(resolved, "import").select("path", "dir").distinct()
    edges = package_edges(files, imports, resolved)
    onward = direct.join(edges.select(F.col("src").alias("dir"), "dst"), "dir").select("path", F.col("dst").alias("dir"))
    both = direct.withColumn("near", F.lit(True)).unionByName(onward.withColumn("near", F.lit(False)))
    return both.groupBy("path", "dir").agg(F.max("near").alias("near"))


def late_signals(rows: DataFrame, reach: DataFrame, links: DataFrame, files: DataFrame) -> DataFrame:
    """task_id, path, reached, tested of pairs whose imports or tested files score well in the first pass.

    reached is 1, 0.7 or 0.4 by the best score among packages a file imports, or those import.
    """
    best = rows.where("dir <> ''").groupBy("task_id", "dir").agg(F.max("pass1").alias("best")).where("best >= 0.6")
    signal = F.when(~F.col("near"), 0.4).when(F.col("best") >= 0.8, 1.0).otherwise(0.7)
    reached = reach.join(best, "dir").select("task_id", "path", signal.alias("reached"), F.lit(False).alias("tested"))
    good = rows.where("pass1 >= 0.5").select("task_id", F.col("path").alias("link"))
    tests = links.join(files.where("is_test").select("path"), "path", "left_semi")
    tested = tests.join(good, "link").select("task_id", "path", F.lit(0.0).alias("reached"), F.lit(True).alias("tested"))
    return reached.unionByName(tested).groupBy("task_id", "path").agg(F.max("reached").alias("reached"), F.max("tested").alias("tested"))


class Scores:
    """Scores of a batch of tasks over files from one pass over names, links and texts.

    What differs between the first scores (no file is read) and the last ones (texts of viable
    files count) is the doc signal alone, so the last ones are the first ones with that term put back.
    Only where texts could raise a package or a tested file across a threshold are imports and tests looked at again.
    """

    def __init__(self, tasks: DataFrame, files: DataFrame, imports: DataFrame, links: DataFrame, settings: Settings = Settings()):  # noqa: B008
        self.tasks, self.files, self.links, self.settings = tasks, files, links, settings
        self.rows = written(first_pass(tasks, files, settings), "first-pass")
        self.reach = written(reachable(files, imports), "reach")

    def of(self, rows: DataFrame) -> DataFrame:
        """Scores from first-pass rows; the columns of rows stay."""
        late = written(late_signals(rows, self.reach, self.links, self.files), "late-signals")
        new = late.select("task_id", "path").join(rows.select("task_id", "path"), ["task_id", "path"], "left_anti")
        empty = with_facts(new.withColumns({c: F.lit(0.0) for c in LEXICAL}), self.tasks, self.files, self.settings)
        rows = rows.unionByName(empty, allowMissingColumns=True).join(late, ["task_id", "path"], "left")
        test = F.when(F.col("is_test") & F.coalesce("tested", F.lit(False)), 1.0).otherwise(F.col("named"))
        return self.last(rows.withColumns({"test": test, "import": F.when(F.col("outside"), 0.0).otherwise(F.coalesce("reached", F.lit(0.0)))}))

    def last(self, rows: DataFrame) -> DataFrame:
        damp, final = scored(self.settings)
        return rows.withColumns({"dampener": damp}).withColumn("score", final)

    def all(self) -> DataFrame:
        """Every text counts."""
        return self.of(self.rows).select(COLUMNS)

    def viable(self, least: float) -> DataFrame:
        """Scores of the pairs that reach least without a file being read; their texts then count."""
        held = self.rows.withColumnRenamed("doc", "read").withColumn("doc", F.lit(0.0))
        first = self.of(held.withColumn("pass1", scored(self.settings, imported=False)[1])).where(F.col("score") >= least)
        if self.texts_reach_others():
            first = written(first.select("task_id", "path"), "viable")
            seen = self.rows.join(first.withColumn("seen", F.lit(True)), ["task_id", "path"], "left")
            seen = seen.withColumn("doc", F.when(F.col("seen"), F.col("doc")).otherwise(0.0)).drop("seen")
            rows = self.of(seen.withColumn("pass1", scored(self.settings, imported=False)[1]))
            return rows.join(first, ["task_id", "path"], "left_semi").select(COLUMNS)
        first = first.withColumn("doc", F.coalesce("read", F.lit(0.0)))
        pass1 = combined({f: F.lit(0.0) if f == "import" else F.col("named") if f == "test" else F.col(f) for f in FACTORS}, first_dampener(self.settings), self.settings)
        pass1 = F.when(F.col("outside"), combined({f: F.lit(0.0) if f in ("import", "test") else F.col(f) for f in FACTORS}, first_dampener(self.settings), self.settings)).otherwise(pass1)
        return self.last(first.withColumn("pass1", pass1)).select(COLUMNS)

    def texts_reach_others(self) -> bool:
        """Whether a file whose text counts is in a package or tested by another."""
        texts = self.files.where(F.col("extension").isin(*DOCS))
        return not (texts.where("package <> ''").select("path").isEmpty() and texts.join(self.links, F.col("link") == texts["path"], "left_semi").isEmpty())


def first_dampener(settings: Settings) -> Column:
    return dampener([F.col(c) for c in ("symbol", "filename", "package")], settings)


COLUMNS = ["task_id", "path", *FACTORS, "dampener", "pass1", "score"]


def score(tasks: DataFrame, files: DataFrame, imports: DataFrame, links: DataFrame, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """task_id, path, the eight signals, dampener, pass1 and score, where every text counts."""
    return Scores(tasks, files, imports, links, settings).all()


def everywhere(rows: DataFrame, tasks: DataFrame, files: DataFrame, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """Scores of every file for every task: those of score() and, with all signals 0, the rest."""
    damp = dampener([F.lit(0.0)] * 2, settings)
    none = {c: F.coalesce(c, F.lit(0.0)) for c in [*FACTORS, "pass1", "score"]} | {"dampener": F.coalesce("dampener", damp)}
    return tasks.select("task_id").crossJoin(files.select("path")).join(rows, ["task_id", "path"], "left").withColumns(none).select(rows.columns)


def breakdown(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """task_id, path, factor, signal, weight, contribution of every factor that isn't 0."""
    parts = [F.struct(F.lit(f).alias("factor"), F.col(f).alias("signal"), F.lit(settings.weights[f]).alias("weight")) for f in FACTORS]
    out = rows.select("task_id", "path", "dampener", F.explode(F.array(*parts)).alias("p")).where("p.signal <> 0")
    gain = F.col("p.signal") * F.col("p.weight") * F.when(F.col("p.factor") == "mention", F.col("dampener")).otherwise(1.0)
    return out.select("task_id", "path", "p.factor", "p.signal", "p.weight", gain.alias("contribution"))
