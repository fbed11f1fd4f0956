"""Import resolution and reach over the package graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def resolve_imports(imports: DataFrame, dirs: DataFrame) -> DataFrame:
    """import and dir: the longest package folder that is a whole-segment suffix of the import.

    Suffixes of distinct imports meet folders by equality, so no pair of import and folder is tried in vain.
    """
    parts = F.split("import", "/")
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/")))
    rows = imports.select("import").distinct().select("import", suffix.alias("dir")).join(dirs.select("dir").distinct(), "dir")
    best = F.row_number().over(W.partitionBy("import").orderBy(F.length("dir").desc(), "dir"))
    return rows.withColumn("best", best).where("best = 1").select("import", "dir")


def package_edges(files: DataFrame, imports: DataFrame, resolved: DataFrame) -> DataFrame:
    """src and dst folders, from the imports of a package's files."""
    rows = files.where("package <> ''").select("path", F.col("package").alias("src")).join(imports, "path").join(resolved, "import")
    return rows.select("src", F.col("dir").alias("dst")).distinct()


def reach(edges: DataFrame) -> DataFrame:
    """src, dst, hops: one step, or two where one doesn't do."""
    one = edges.select("src", "dst").distinct()
    two = one.select("src", F.col("dst").alias("mid")).join(one.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").distinct()
    return one.withColumn("hops", F.lit(1)).unionByName(two.join(one, ["src", "dst"], "left_anti").withColumn("hops", F.lit(2)))
