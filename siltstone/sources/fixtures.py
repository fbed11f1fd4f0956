"""Evaluation cases from folders: a YAML file beside a repository, read strictly, as tables."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import globs
from .files import lossy_text
from .shared import written
from .tasks import is_markdown

# The keys of a case, and units of durations in seconds.
KEYS = {"name": str, "task": str, "task_file": str, "budget": int, "model": str, "repo_fingerprint": str, "expected": dict, "agent_check": dict}
EXPECTED = {"selections": ("path", "load_mode"), "forbidden": ("path",), "gaps": ("type",)}
UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}
SCHEMA = """file string, error string, name string, task string, task_file string, budget bigint, model string, repo_fingerprint string, agent_command string, agent_seconds double,
 selections array<struct<path:string,load_mode:string>>, forbidden array<struct<pattern:string,regex:string>>, gaps array<string>"""
NAMES = [c.split()[0] for c in re.split(r",\s(?![^<]*>)", SCHEMA)]


def normal(path: str) -> str:
    """Forward slashes, no ./ at the start."""
    return path.replace("\\", "/").removeprefix("./")


def seconds(text: str) -> float:
    """A duration with units, such as 1m30s."""
    parts = re.findall(r"(\d+(?:\.\d*)?|\.\d+)(ns|us|µs|ms|s|m|h)", str(text))
    if not parts or "".join(a + b for a, b in parts) != str(text):
        raise ValueError(f"agent_check.timeout: {text!r} is no duration")
    return sum(float(n) * UNITS[u] for n, u in parts)


def strict(held: dict, known, where: str) -> None:
    if not isinstance(held, dict):
        raise ValueError(f"{where} must hold keys")
    if more := sorted(set(map(str, held)) - set(known)):
        raise ValueError(f"unknown keys in {where}: {', '.join(more)}")


def case(text: str) -> tuple:
    """The values of one case from name on; what breaks a rule is a ValueError."""
    import yaml

    try:
        raw = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ValueError(f"parse yaml: {' '.join(str(e).split())}") from None
    if raw is None:
        raise ValueError("empty fixture file")
    strict(raw, KEYS, "the case")
    for key, kind in KEYS.items():
        if raw.get(key) is not None and (not isinstance(raw[key], kind) or isinstance(raw[key], bool)):
            raise ValueError(f"{key} is of another type")
    if not (raw.get("name") or "").strip():
        raise ValueError("name is required")
    given = [k for k in ("task", "task_file") if raw.get(k) is not None]
    if len(given) != 1:
        raise ValueError("exactly one of task and task_file must be set")
    if not raw[given[0]].strip():
        raise ValueError(f"{given[0]} is set but empty")
    if (raw.get("budget") or 0) <= 0:
        raise ValueError("budget must be > 0")
    if not (raw.get("model") or "").strip():
        raise ValueError("model is required")
    if not re.fullmatch(r"sha256:.{64}", raw.get("repo_fingerprint") or ""):
        raise ValueError("repo_fingerprint must be sha256:<64-hex>")
    expected = raw.get("expected") or {}
    strict(expected, EXPECTED, "expected")
    for kind, keys in EXPECTED.items():
        for entry in expected.get(kind) or []:
            strict(entry, keys, f"expected.{kind}")
            if not str(entry.get(keys[0]) or "").strip():
                raise ValueError(f"expected.{kind}[*].{keys[0]} is required")
    check = raw.get("agent_check")
    if check is not None:
        strict(check, ("command", "timeout"), "agent_check")
        if not str(check.get("command") or "").strip():
            raise ValueError("agent_check.command is required")
        if seconds(check.get("timeout") or "") <= 0:
            raise ValueError("agent_check.timeout must be > 0")
    of = {kind: expected.get(kind) or [] for kind in EXPECTED}
    return (
        raw["name"], raw.get("task"), raw.get("task_file"), raw["budget"], raw["model"], raw["repo_fingerprint"], check and check["command"], check and seconds(check["timeout"]),
        [{"path": normal(s["path"]), "load_mode": s.get("load_mode") or None} for s in of["selections"]], [{"pattern": p, "regex": globs.forbidden(p)} for p in dict.fromkeys(normal(f["path"]) for f in of["forbidden"])], [g["type"] for g in of["gaps"]],
    )


@dataclass(frozen=True)
class Fixtures:
    """cases (name, dir, task, task_file, budget, model, repo_fingerprint, agent_command, agent_seconds), selections (name, path, load_mode), forbidden (name, pattern, regex), gaps (name, type)."""

    cases: DataFrame
    selections: DataFrame
    forbidden: DataFrame
    gaps: DataFrame


def load(spark: SparkSession, folder: str) -> Fixtures:
    """All cases below folder but those within their repositories; a broken file or a name given twice is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for file, text in zip(pdf["file"], pdf["text"], strict=True):
                try:
                    rows.append((file, None, *case(text)))
                except ValueError as e:
                    rows.append((file, str(e), *[None] * (len(NAMES) - 2)))
            yield pd.DataFrame(rows, columns=NAMES).astype({"budget": "Int64"})

    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.eval.yaml").load(folder)
    inside = F.substring_index(F.col("path"), folder.rstrip("/").split("://")[-1] + "/", -1)
    found = found.where(~F.array_contains(F.split(inside, "/"), "repo"))
    rows = written(found.select(F.col("path").alias("file"), lossy_text(F.col("content")).alias("text")).mapInPandas(run, SCHEMA), "fixtures")
    if bad := rows.where("error is not null").orderBy("file").select("file", "error").take(20):
        raise ValueError("; ".join(f"{r.file}: {r.error}" for r in bad))
    if twice := rows.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy("name").select("name").take(20):
        raise ValueError(f"names declared twice: {', '.join(r.name for r in twice)}")
    cases = rows.select(F.regexp_replace("file", "/[^/]*$", "").alias("dir"), *NAMES[2:10])
    return Fixtures(
        cases,
        rows.select("name", F.inline("selections")),
        rows.select("name", F.inline("forbidden")),
        rows.select("name", F.explode("gaps").alias("type")).distinct(),
    )


def task_text(spark: SparkSession, folder: str, task: str | None, task_file: str | None) -> tuple[str, bool]:
    """The text of a case's task and whether it is Markdown; a task file must lie in the case's repository."""
    if task is not None:
        return task, False
    place = posixpath.normpath(posixpath.join("/repo", normal(task_file)))
    if not place.startswith("/repo/"):
        raise ValueError(f"task_file {task_file!r} escapes the repository")
    row = spark.read.format("binaryFile").load(folder + place).select(lossy_text(F.col("content")).alias("text"), is_markdown(F.col("path")).alias("markdown")).first()
    return row.text, row.markdown
