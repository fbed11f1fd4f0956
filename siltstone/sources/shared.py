"""Tables written once in the folder that driver and executors share, to cut lineage or to be read several times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset and all runs on this machine, a folder of our own."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        place = held.get() if held.isDefined() else None
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="siltstone-shared-")
        spark.sparkContext.setCheckpointDir(place)
    return place.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder, and read from there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
