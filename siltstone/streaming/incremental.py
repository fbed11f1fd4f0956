"""Keeping the analysis cache current from a stream of file versions.

Each micro-batch meets the cache by key; only versions it lacks are analysed. Replayed batches add
nothing, since their keys are held already.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.cache import AnalysisCache


def follow(versions: DataFrame, cache: AnalysisCache, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Starts the query over a streaming table of path, size, mtime, language, text."""

    def put(batch: DataFrame, number: int) -> None:
        cache.analyze(batch.dropDuplicates(["path", "size", "mtime"]))

    writer = versions.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
