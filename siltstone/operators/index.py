"""Operators over the file index: packages, test links, supplementals, side effects, scope, tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import globs
from ..functions.paths import in_scope, is_test, language, tier
from ..functions.text import basename, dirname, extension


def describe(files: DataFrame) -> DataFrame:
    """files (path and others) with extension, language, language_tier, is_test and package (folders of Go files)."""
    out = files.withColumns({"extension": extension(F.col("path")), "language": language(F.col("path")), "is_test": is_test(F.col("path"))})
    return out.withColumns({"language_tier": tier(F.col("language")), "package": F.when(F.col("language") == "go", dirname(F.col("path"))).otherwise("")})


def packages(files: DataFrame) -> DataFrame:
    """dir and sorted files of each folder of Go files."""
    return files.where("language = 'go'").groupBy(F.col("package").alias("dir")).agg(F.sort_array(F.collect_list("path")).alias("files"))


def pattern_reason(path: Column, user: list[str], default: list[str] = K.EXCLUSIONS) -> Column:
    """Why a file or folder (without a slash at its end) is left out; the user's patterns are named first."""
    return F.when(globs.any_of(path, user), "user_pattern").when(globs.any_of(path, default), "default_pattern")


def exclusions(paths: DataFrame, user: list[str]) -> DataFrame:
    """path and reason of every path that a pattern leaves out; the user's patterns are named first."""
    return paths.withColumn("reason", pattern_reason(F.col("path"), user)).where("reason is not null").select("path", "reason")


def supplementals(paths: DataFrame) -> DataFrame:
    """category and path of every supplemental file."""
    found = [F.when(globs.any_of(F.lower(F.col("path")), p, globs.supplemental), F.lit(c)) for c, p in K.SUPPLEMENTAL.items()]
    rows = paths.select("path", F.explode(F.array(*found)).alias("category")).where("category is not null")
    return rows.select("category", "path").distinct()


def scoped(files: DataFrame, supplemental: DataFrame, scope: str | None) -> DataFrame:
    """Files in scope, and supplementals wherever they are, marked out_of_scope."""
    known = supplemental.select("path").distinct().withColumn("known", F.lit(True))
    rows = files.join(known, "path", "left").withColumn("out_of_scope", ~in_scope(F.col("path"), F.lit(scope).cast("string")))
    return rows.where(~F.col("out_of_scope") | F.col("known")).drop("known")


def scope_of(given: str | None) -> str | None:
    """A scope as given, below the root and with forward slashes; None for the whole repository.

    Empty and "." are the whole; absolute paths and parts that go up are refused.
    """
    if given in (None, "", "."):
        return None
    scope = given.replace("\\", "/").removeprefix("./").removesuffix("/")
    while "/./" in scope:
        scope = scope.replace("/./", "/")
    if not scope or scope.startswith("/") or "\0" in scope or ".." in scope.split("/"):
        raise ValueError(f"{given!r} is no folder below the root")
    return scope


def test_links(files: DataFrame) -> DataFrame:
    """path and link, both ways between tests and what they test, for Go, TypeScript/JavaScript and Python."""
    base, ext = basename(F.col("path")), F.col("extension")
    family = F.when(ext == ".go", "go").when(ext.isin(".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"), "script").when(ext == ".py", "py")
    stem = F.regexp_replace(base, r"\.[^.]*$", "")
    stem = F.when(family == "py", F.regexp_replace(stem, r"^test_|_test$", "")).when(family == "go", F.regexp_replace(stem, "_test$", "")).otherwise(F.regexp_replace(stem, r"\.(test|spec)$", ""))
    order = F.array_position(F.array(*map(F.lit, [".tsx", ".ts", ".mjs", ".cjs", ".jsx", ".js"])), ext)
    rows = files.select("path", "is_test", dirname(F.col("path")).alias("dir"), family.alias("family"), stem.alias("stem"), order.alias("order")).where("family is not null")
    tests = rows.where("is_test").select(F.col("path").alias("test"), "dir", "family", "stem")
    code = rows.where("not is_test").select(F.col("path").alias("code"), "dir", "family", "stem", "order")
    pairs = tests.join(code, ["dir", "family", "stem"])
    # of several scripts with one name the best extension is the one tested
    best = F.row_number().over(W.partitionBy("test").orderBy("order", "code"))
    pairs = pairs.withColumn("best", best).where("family in ('go', 'py') or best = 1").select("test", "code")
    return pairs.select(F.col("test").alias("path"), F.col("code").alias("link")).unionByName(pairs.select(F.col("code").alias("path"), F.col("test").alias("link"))).distinct()


def side_effects(imports: DataFrame) -> DataFrame:
    """path and tag, from path and import; prefixes of an import meet the rules by equality."""
    rules = [F.struct(F.lit(p).alias("prefix"), F.lit(t).alias("tag")) for t, ps in K.SIDE_EFFECTS.items() for p in ps]
    parts = F.split("import", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    # a few dozen rules: a literal map from prefix to tag
    tags = F.map_from_entries(F.array(*rules))
    rows = imports.select("path", "import", F.explode(prefixes).alias("prefix")).withColumn("tag", F.try_element_at(tags, F.col("prefix"))).where("tag is not null")
    below = (F.col("import") == K.NOT_FILESYSTEM) | F.col("import").startswith(K.NOT_FILESYSTEM + "/")
    return rows.where(~((F.col("prefix") == "os") & below)).select("path", "tag").distinct()
