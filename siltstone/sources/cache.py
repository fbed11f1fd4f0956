"""A keyed cache of analysis results in immutable generations.

What one call adds is a Parquet folder of its own that is never changed. Which folders are live is a
pointer, a small JSON file with a number; the one of the highest number counts, and creating the next fails
where another writer was first, who is then read and tried again. A reader holds on to the folders of the
pointer it has read, so additions, clearing and compaction beside it change nothing for it. Above
COMPACT live generations they are merged to one, without what analysers of other versions have left.
Folders that no pointer names any more go with vacuum().

Each analyser has a version of its own, which is part of the keys of its files alone.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .analyze import ANALYZERS, SYMBOL, analyze

COMPACT = 8
SCHEMA = f"key string, language string, version string, path string, symbols {SYMBOL}, imports array<string>, parse_error boolean"
RESULTS = ["symbols", "imports", "parse_error"]


def key(path: Column, size: Column, mtime: Column, version: Column | str) -> Column:
    version = F.lit(version) if isinstance(version, str) else version
    return F.sha2(F.concat_ws("\x00", path, size.cast("string"), mtime, version), 256)


class AnalysisCache:
    """versions: of the analysers by language; files of other languages have the version of ''."""

    def __init__(self, spark: SparkSession, folder: str, versions: dict[str, str] | None = None):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.versions = {"": "none", **ANALYZERS, **(versions or {})}
        self.paths = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.paths(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self, language: Column) -> Column:
        out = F.lit(self.versions[""])
        for name, version in self.versions.items():
            out = F.when(language == name, version).otherwise(out) if name else out
        return out

    def pointer(self) -> tuple[int, list[str]]:
        """The number of the newest pointer (0: none) and the generations it names."""
        place = self.paths(f"{self.folder}/pointers")
        if not self.fs.exists(place):
            return 0, []
        numbers = [int(f.getPath().getName().removesuffix(".json")) for f in self.fs.listStatus(place) if f.getPath().getName().endswith(".json")]
        if not numbers:
            return 0, []
        stream = self.fs.open(self.paths(f"{self.folder}/pointers/{max(numbers):012d}.json"))
        try:
            return max(numbers), json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def commit(self, number: int, generations: list[str]) -> bool:
        """Whether pointer number + 1 is ours: only one writer can create it."""
        place = self.paths(f"{self.folder}/pointers/.{uuid.uuid4().hex}")
        stream = self.fs.create(place, False)
        stream.write(bytearray(json.dumps(generations).encode()))
        stream.close()
        target = self.paths(f"{self.folder}/pointers/{number + 1:012d}.json")
        try:
            # a pointer appears whole or not at all, and never replaces another
            won = not self.fs.exists(target) and self.fs.rename(place, target)
        except Py4JJavaError:
            won = False
        if not won:
            self.fs.delete(place, False)
        return won

    def update(self, change) -> list[str]:
        """The generations that change makes of those of the newest pointer, once they are the newest."""
        while True:
            number, held = self.pointer()
            wanted = change(held)
            if wanted == held or self.commit(number, wanted):
                return wanted

    def read(self, generations: list[str]) -> DataFrame:
        """The entries of some generations, one row for each key."""
        if not generations:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*[f"{self.folder}/generations/{g}" for g in generations])
        return rows if len(generations) == 1 else rows.dropDuplicates(["key"])

    def entries(self) -> DataFrame:
        """What is held by keys of current analysers and others, a row for each key."""
        return self.read(self.pointer()[1])

    def keyed(self, files: DataFrame) -> DataFrame:
        return files.withColumn("key", key(F.col("path"), F.col("size"), F.col("mtime"), self.version(F.coalesce("language", F.lit("")))))

    def lookup(self, files: DataFrame, generations: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
        """Hits (with their results) and misses of files (path, size, mtime, language, text)."""
        held = self.read(self.pointer()[1] if generations is None else generations)
        keyed = self.keyed(files)
        return keyed.join(held.select("key", *RESULTS), "key"), keyed.join(held.select("key"), "key", "left_anti")

    def put(self, rows: DataFrame) -> str | None:
        """The generation that holds rows (of SCHEMA), one for each key; None if there are none."""
        name = uuid.uuid4().hex
        rows.dropDuplicates(["key"]).select([c.split()[0] for c in SCHEMA.split(", ")]).write.parquet(f"{self.folder}/generations/{name}")
        return None if self.read([name]).isEmpty() else name

    def analyze(self, files: DataFrame) -> DataFrame:
        """files with their results; only misses are analysed, and are added as one generation."""
        before = self.pointer()[1]
        misses = self.lookup(files, before)[1]
        fresh = self.put(analyze(misses).withColumn("version", self.version(F.coalesce("language", F.lit("")))))
        read = [*before, fresh] if fresh else before
        if fresh:
            live = self.update(lambda held: [*held, fresh])
            if len(live) > COMPACT:
                self.compact()
        return self.keyed(files).join(self.read(read).select("key", *RESULTS), "key")

    def compact(self) -> None:
        """One generation instead of all live ones; entries of other versions of an analyser go."""
        live = self.pointer()[1]
        current = F.col("version") == self.version(F.coalesce("language", F.lit("")))
        merged = self.put(self.read(live).where(current))
        self.update(lambda held: ([merged] if merged else []) + [g for g in held if g not in live] if set(live) <= set(held) else held)

    def clear(self) -> None:
        self.update(lambda held: [])

    def vacuum(self) -> int:
        """Deletes generations that the newest pointer doesn't name (no reader may hold an older one); how many."""
        live, place = set(self.pointer()[1]), self.paths(f"{self.folder}/generations")
        gone = [f.getPath() for f in self.fs.listStatus(place) if f.getPath().getName() not in live] if self.fs.exists(place) else []
        for path in gone:
            self.fs.delete(path, True)
        return len(gone)
