"""Repositories as tables: a walk that prunes folders level by level, and contents of what stays."""

from __future__ import annotations

import hashlib
import os
import unicodedata
from collections.abc import Iterator
from datetime import UTC
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators.fingerprint import chained
from ..operators.index import describe, pattern_reason
from .shared import written

# Fixed value: what digests of trees begin with.
TREE = "fixture-fingerprint-v1"
#: Bytes of content that leave a task at once.
PART = 16 << 20


def store_of(root: str):
    """The file system that root names, its path there, and whether that is this machine's own."""
    from pyarrow import fs

    if root.startswith("file:/"):
        # as Spark names local files, with one slash or three
        root = "/" + root.removeprefix("file:").lstrip("/")
    if "://" not in root:
        return fs.LocalFileSystem(), root.rstrip("/"), True
    store, place = fs.FileSystem.from_uri(root)
    return store, place.rstrip("/"), isinstance(store, fs.LocalFileSystem)


def entries(folders: DataFrame, root: str) -> DataFrame:
    """path (below root), kind (file, folder, symlink, error), size and mtime of what the folders (path) hold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base, local = store_of(root)
        kinds = {fs.FileType.File: "file", fs.FileType.Directory: "folder"}
        for pdf in batches:
            rows = []
            for folder in pdf["path"]:
                try:
                    found = store.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/")))
                except OSError:
                    rows.append((folder, "error", 0, None))
                    continue
                for x in found:
                    kind = "symlink" if local and os.path.islink(x.path) else kinds.get(x.type, "error")
                    time = x.mtime.astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%SZ") if x.mtime else None
                    rows.append((f"{folder}/{x.base_name}".lstrip("/"), kind, x.size or 0, time))
            yield pd.DataFrame(rows, columns=["path", "kind", "size", "mtime"])

    return folders.mapInPandas(run, "path string, kind string, size bigint, mtime string")


def contents(files: DataFrame, root: str) -> DataFrame:
    """files (path, size, mtime) with content, sha256 and reason: read_error, binary (a NUL in the first bytes) or null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base, _ = store_of(root)
        for pdf in batches:
            rows, held = [], 0
            for path, size, mtime in pdf.itertuples(index=False):
                try:
                    with store.open_input_stream(f"{base}/{path}") as f:
                        raw = f.read()
                    out = (None, None, "binary") if b"\0" in raw[: K.PROBE_BYTES] else (raw, hashlib.sha256(raw).hexdigest(), None)
                except OSError:
                    out = (None, None, "read_error")
                rows.append((path, size, mtime, *out))
                held += len(out[0] or b"")
                if held > PART:
                    yield pd.DataFrame(rows, columns=NAMES)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=NAMES)

    return files.select("path", "size", "mtime").mapInPandas(run, "path string, size bigint, mtime string, content binary, sha256 string, reason string")


NAMES = ["path", "size", "mtime", "content", "sha256", "reason"]


def lossy_text(content: Column) -> Column:
    """Bytes as text; what isn't UTF-8 becomes replacement characters, as no file may end the job."""
    return F.make_valid_utf8(content.cast("string"))


def walk(spark: SparkSession, root: str, user: tuple[str, ...] = (), default: list[str] = K.EXCLUSIONS) -> tuple[DataFrame, DataFrame]:
    """Files that stay, described, hashed and with their text, and exclusions (path, reason).

    One job lists all folders of a level; hidden folders and those that a pattern names are not entered
    and logged once, with a slash. Size and patterns are decided before any content is read. Symbolic
    links are not followed, and what can't be read is logged. root is a local folder that all
    executors see, or an address that pyarrow's file systems read.
    """
    folders, files, out = spark.createDataFrame([("",)], "path string"), [], []
    while True:
        found = written(entries(folders, root), "listing")
        name = F.element_at(F.split("path", "/"), -1)
        hidden = F.when((F.col("kind") == "folder") & name.startswith(".") & ~name.isin(K.HIDDEN_ALLOWED), "hidden_dir")
        odd = F.when(F.col("kind") == "error", "read_error").when(F.col("kind") == "symlink", "symlink")
        size = F.when((F.col("kind") == "file") & (F.col("size") > K.MAX_BYTES), "oversize_cutoff")
        rows = found.withColumn("reason", F.coalesce(odd, hidden, pattern_reason(F.col("path"), list(user), default), size))
        files.append(rows.where("kind = 'file' and reason is null"))
        out.append(rows.where("reason is not null").select(F.concat("path", F.when(F.col("kind") == "folder", "/").otherwise("")).alias("path"), "reason"))
        folders = rows.where("kind = 'folder' and reason is null").select("path")
        if folders.isEmpty():
            break
        folders = folders.repartition("path")
    read = written(contents(reduce(DataFrame.unionByName, files).repartition("path"), root), "contents")
    kept = describe(read.where("reason is null").drop("reason")).withColumn("text", lossy_text(F.col("content")))
    return kept, reduce(DataFrame.unionByName, out).unionByName(read.where("reason is not null").select("path", "reason"))


def fingerprint(files: DataFrame, version: str) -> DataFrame:
    """One row: a digest of all paths, digests, sizes and times in order of path."""
    line = F.to_json(F.struct("path", "sha256", "size", "mtime"))
    rows = chained(files.withColumn("repo", F.lit("")), "repo", ["path"], line, f"{version}[".encode(), b",", b"]")
    empty = "sha256:" + hashlib.sha256(f"{version}[]".encode()).hexdigest()
    return rows.agg(F.coalesce(F.concat(F.lit("sha256:"), F.max("fingerprint")), F.lit(empty)).alias("fingerprint"))


class NotPlain(Exception):
    """A tree of files holds a symbolic link, another thing than a file, or what can't be read."""


def composed(path: Column) -> Column:
    """The path in composed form (NFC); most are plain and stay in the JVM."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda p: unicodedata.normalize("NFC", p))

    return F.when(path.rlike(r"[^\x00-\x7F]"), F.pandas_udf(run, "string")(path)).otherwise(path)


def hashes(files: DataFrame, root: str) -> DataFrame:
    """path and sha256 of whole files, read in parts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base, _ = store_of(root)
        for pdf in batches:
            rows = []
            for path in pdf["path"]:
                state = hashlib.sha256()
                with store.open_input_stream(f"{base}/{path}") as f:
                    while part := f.read(1 << 20):
                        state.update(part)
                rows.append((path, state.hexdigest()))
            yield pd.DataFrame(rows, columns=["path", "sha256"])

    return files.select("path").mapInPandas(run, "path string, sha256 string")


def tree_fingerprint(spark: SparkSession, root: str) -> str:
    """The digest of a tree of files: composed paths and digests of everything below root, in order of path.

    Nothing is left out. What isn't a plain file or folder is an error, a missing root too.
    """
    folders, files = spark.createDataFrame([("",)], "path string"), []
    while True:
        found = written(entries(folders, root), "listing")
        odd = found.where("kind not in ('file', 'folder')").select("path", "kind").first()
        if odd:
            raise NotPlain(f"{odd.kind}: {odd.path or root}")
        files.append(found.where("kind = 'file'").select("path"))
        folders = found.where("kind = 'folder'").select("path")
        if folders.isEmpty():
            break
        folders = folders.repartition("path")
    rows = hashes(reduce(DataFrame.unionByName, files).repartition("path"), root).withColumns({"path": composed(F.col("path")), "repo": F.lit("")})
    held = chained(rows, "repo", ["path"], F.concat("path", F.lit("\0"), "sha256", F.lit("\0")), TREE.encode() + b"\0").first()
    return "sha256:" + (held.fingerprint if held else hashlib.sha256(TREE.encode() + b"\0").hexdigest())


def verify_tree(spark: SparkSession, root: str, expected: str) -> None:
    """An error unless the tree's digest is the expected one."""
    got = tree_fingerprint(spark, root)
    if got != expected:
        raise ValueError(f"fingerprint of {root}: expected {expected}, got {got}")
