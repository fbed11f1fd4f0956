"""A virtual repository and task list built from the driver tables, the same in Spark and in SQL.

nation gives tasks, part gives files (Go, tests, TypeScript, YAML, Markdown) with symbols and
imports, lineitem gives packing candidates by supplier. Expressions are plain SQL that both
engines read, so each is stated once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import basename
from ..operators import index, tasks

BRAND = "replace(lower(p_brand), '#', '')"
NAME = "replace(p_name, ' ', '_')"
CAMEL = "concat(upper(substr(split_part(p_name, ' ', 1), 1, 1)), substr(split_part(p_name, ' ', 1), 2), upper(substr(split_part(p_name, ' ', 2), 1, 1)), substr(split_part(p_name, ' ', 2), 2))"
PATH = f"""CASE p_type WHEN 'PROMO' THEN concat('config/', {BRAND}, '/', {NAME}, '.yaml') WHEN 'LARGE' THEN concat('docs/', {BRAND}, '/', {NAME}, '.md')
 WHEN 'MEDIUM' THEN concat('web/', {BRAND}, '/', {NAME}, '.ts') WHEN 'STANDARD' THEN concat('internal/', {BRAND}, '/', {NAME}, '_test.go')
 ELSE concat('internal/', {BRAND}, '/', {NAME}, '.go') END"""
MODULE = "concat('example.com/app/internal/brand', CAST(p_size % 25 + 1 AS STRING))"
LIBRARY = """CASE p_size % 9 WHEN 0 THEN 'os' WHEN 1 THEN 'net/http' WHEN 2 THEN 'time' WHEN 3 THEN 'fmt' WHEN 4 THEN 'math/rand'
 WHEN 5 THEN 'database/sql' WHEN 6 THEN 'log/slog' WHEN 7 THEN 'os/exec' ELSE 'strings' END"""
ADJECTIVE = "CASE n_nationkey % 4 WHEN 0 THEN 'small' WHEN 1 THEN 'red' WHEN 2 THEN 'blue' ELSE 'large' END"
NOUN = "CASE n_nationkey % 3 WHEN 0 THEN 'ring' WHEN 1 THEN 'widget' ELSE 'bolt' END"
VERB = """CASE n_nationkey % 9 WHEN 0 THEN 'Fix' WHEN 1 THEN 'Add tests for' WHEN 2 THEN 'Document' WHEN 3 THEN 'Migrate' WHEN 4 THEN 'Refactor'
 WHEN 5 THEN 'Investigate' WHEN 6 THEN 'Implement' WHEN 7 THEN 'Review' ELSE 'Support' END"""
TASK = f"""concat({VERB}, ' the ', {ADJECTIVE}, ' ', {NOUN}, ' handler of brand', CAST(n_nationkey + 1 AS STRING),
 CASE n_nationkey % 3 WHEN 0 THEN concat(' in `', {ADJECTIVE}, '_', {NOUN}, '.go`') WHEN 1 THEN concat(' in internal/brand', CAST(n_nationkey + 1 AS STRING), '/', {ADJECTIVE}, '_', {NOUN}, '.go') ELSE '' END,
 CASE n_nationkey % 5 WHEN 0 THEN '\\nThe config schema must follow NewSettings and the API contract.' WHEN 1 THEN '\\nSee docs/guide.md; server reads the database.' ELSE '' END, ' ', n_name)"""
TEXT = f"concat(p_name, ' guide for ', {BRAND}, ' config server handler')"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def task_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "nation").select(F.concat(F.lit("task-"), "n_nationkey").alias("task_id"), F.expr(TASK).alias("raw_text"), F.lit(True).alias("markdown"), F.col("n_nationkey").alias("n"))
    return tasks.parse(rows)


def budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "nation").select(F.concat(F.lit("task-"), "n_nationkey").alias("task_id"), (F.lit(300) * (F.col("n_nationkey") + 1)).cast("bigint").alias("budget"))


def file_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "part").select(F.expr(PATH).alias("path"), (F.col("p_size") * 40).cast("bigint").alias("size"), F.expr(CAMEL).alias("camel"), F.expr(TEXT).alias("text"))
    rows = index.describe(rows.groupBy("path").agg(F.sum("size").alias("size_bytes"), F.min("camel").alias("camel"), F.min("text").alias("text")))
    plain = F.array("camel", F.concat(F.lit("New"), "camel"))
    code = (F.col("language") == "go") & ~F.col("is_test")
    kind = lambda n: F.when(n.startswith("New"), "func").otherwise("type")
    rows = rows.withColumn("symbols", F.when(code, plain).when(F.col("language") == "typescript", F.array(F.concat("camel", F.lit("View")))).otherwise(F.array().cast("array<string>")))
    details = F.transform("symbols", lambda n: F.struct(n.alias("name"), kind(n).alias("kind"), F.lit("").alias("receiver"), F.lit(True).alias("exported")))
    return rows.withColumns({"details": details, "package_name": F.when(F.col("package") != "", basename(F.col("package"))).otherwise(""), "parse_error": F.lit(False)})


def import_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "part").select(F.expr(PATH).alias("path"), F.explode(F.array(F.expr(MODULE), F.expr(LIBRARY))).alias("import"))
    return rows.where(F.col("path").rlike(r"\.(go|ts)$")).distinct()


def candidate_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packing candidates: the lines of a supplier, with scores that cover all bands."""
    li = load(spark, sf_dir, "lineitem")
    path = F.concat(F.when(F.col("l_linestatus") == "F", "src/handler_").otherwise("src/part_"), "l_orderkey", F.lit("_"), "l_linenumber", F.lit("_"), "l_partkey", F.when(F.col("l_returnflag") == "A", ".go").otherwise(".ts"))
    n_bytes = (F.col("l_quantity") * 900).cast("bigint")
    rows = li.select(F.col("l_suppkey").cast("string").alias("task_id"), path.alias("path"), (F.col("l_discount") * 10 - F.col("l_tax")).alias("score"), n_bytes.alias("size_bytes"), F.col("l_partkey"), F.col("l_returnflag"), F.col("l_tax"))
    rows = rows.groupBy("task_id", "path").agg(F.max("score").alias("score"), F.max("size_bytes").alias("size_bytes"), F.max("l_partkey").alias("k"), F.max("l_returnflag").alias("flag"), F.max("l_tax").alias("tax"))
    tags = F.array_except(F.array(F.when(F.col("k") % 2 == 0, "io:network").otherwise("none"), F.when(F.col("k") % 3 == 0, "io:time").otherwise("none")), F.array(F.lit("none")))
    full = F.ceil(F.col("size_bytes") * 2 / F.lit(7)).cast("bigint") + 32
    return rows.select(
        "task_id", "path", F.greatest(F.lit(0.0), "score").alias("score"), (F.col("tax") >= 0.08).alias("mentioned"), "size_bytes",
        full.alias("cost_full"), (F.floor(full / 5) + 24).cast("bigint").alias("cost_structural"), (F.floor(full / 4) + 24).cast("bigint").alias("cost_behavioral"),
        F.when(F.col("flag") == "A", "go").otherwise("typescript").alias("language"), (F.col("k") % 4).cast("int").alias("n_symbols"), tags.alias("side_effects"),
    )


def candidate_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("task_id"), ((F.col("l_suppkey") % 7) * 4000 + 200).cast("bigint").alias("budget")).distinct()
