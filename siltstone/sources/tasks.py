"""Task files as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from .files import lossy_text


def is_markdown(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(md|markdown|mdx)$")


def read_tasks(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """source, raw_text and markdown of task files, and source and reason of those that aren't text.

    Names that start with a dot or an underscore have to be given in full; a missing path is an error.
    """
    rows = spark.read.format("binaryFile").load(paths)
    nul = F.instr(F.decode(F.substring("content", 1, K.PROBE_BYTES), "ISO-8859-1"), "\x00") > 0
    rows = rows.select(F.col("path").alias("source"), "content", nul.alias("nul"))
    good = rows.where("not nul").select("source", lossy_text(F.col("content")).alias("raw_text"), is_markdown(F.col("source")).alias("markdown"))
    return good, rows.where("nul").select("source", F.lit("binary").alias("reason"))


def inline_tasks(texts: DataFrame) -> DataFrame:
    """The same columns for texts (raw_text) given as such."""
    return texts.select(F.lit("<inline>").alias("source"), "raw_text", F.lit(False).alias("markdown"))
