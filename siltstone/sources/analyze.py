"""Symbols and imports of source files.

Go, TypeScript and JavaScript are read by small recursive-descent readers, Python by the standard
parser, a batch of files at a time. A file that can't be read has no symbols, and of its imports
those of Go alone. Files whose language has no analyser, or one that isn't enabled, have neither
symbols nor imports.
"""

from __future__ import annotations

import ast
import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import go_grammar, script_grammar

SYMBOL = "array<struct<name:string,kind:string,receiver:string,exported:boolean>>"


def python_module(text: str) -> tuple[list[dict], list[str], bool]:
    """Module-level names and imports; a syntax error leaves both empty."""
    try:
        body = ast.parse(text).body
    except (SyntaxError, ValueError):
        return [], [], True
    names, imports = [], set()
    for node in body:
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            names.append((node.name, "func"))
        elif isinstance(node, ast.ClassDef):
            names.append((node.name, "type"))
        elif isinstance(node, ast.Assign | ast.AnnAssign):
            kind = "func" if isinstance(node.value, ast.Lambda) else "var"
            names += [(t.id, kind) for t in (node.targets if isinstance(node, ast.Assign) else [node.target]) if isinstance(t, ast.Name)]
        elif isinstance(node, ast.Import):
            imports |= {a.name for a in node.names}
        elif isinstance(node, ast.ImportFrom):
            imports.add("." * node.level + (node.module or ""))
    return [{"name": n, "kind": k, "receiver": "", "exported": not n.startswith("_")} for n, k in names], sorted(imports), False


#: The version of each analyser; results of another are not reused.
ANALYZERS = {"go": "go-2", "typescript": "script-2", "javascript": "script-2", "python": "python-1"}
FACTS = f"package_name string, symbols {SYMBOL}, imports array<string>, parse_error boolean"


def go_file(path: str, text: str) -> tuple:
    package, symbols, imports, broken = go_grammar.read(text)
    return package, [{"name": n, "kind": k, "receiver": r, "exported": True} for n, k, r in symbols], imports, broken


def script_file(path: str, text: str) -> tuple:
    typed = path.lower().endswith((".ts", ".tsx", ".mts", ".cts"))
    symbols, imports, broken = script_grammar.read(text, typed, not typed or path.lower().endswith(".tsx"))
    return "", [{"name": n, "kind": k, "receiver": "", "exported": e} for n, k, e in symbols], imports, broken


def python_file(path: str, text: str) -> tuple:
    return "", *python_module(text)


READERS = {"go": go_file, "typescript": script_file, "javascript": script_file, "python": python_file}
#: Texts that a worker remembers, and the longest of them; equal ones are read once.
HELD, LONGEST = 2048, 4096
#: Tasks that the copies of one text are dealt to.
SPREAD = 16


@functools.lru_cache(maxsize=HELD)
def held_file(language: str, ending: str, text: str) -> tuple:
    return READERS[language](ending, text)


def read_file(language: str, path: str, text: str) -> tuple:
    """What the analyser of a language says of a file: of its path, the ending alone counts."""
    path = path or ""
    return held_file(language, path[path.rfind(".") :], text) if len(text) <= LONGEST else READERS[language](path, text)


def dealt(files: DataFrame) -> DataFrame:
    """files in as many tasks as their texts are worth: a small table of many files may come as one partition.

    Copies of a text meet in a few tasks, where they are read once.
    """
    return files.repartition(F.xxhash64("text"), F.pmod(F.xxhash64("path"), F.lit(SPREAD)))


def facts(language: Column, path: Column, text: Column) -> Column:
    """package_name, symbols, imports and parse_error of each file, by the analyser of its language."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for languages, paths, texts in batches:
            rows = [read_file(name, where, what or "") for name, where, what in zip(languages, paths, texts, strict=True)]
            yield pd.DataFrame(rows, columns=["package_name", "symbols", "imports", "parse_error"])

    return F.pandas_udf(run, FACTS)(language, path, text)


def analyze(files: DataFrame, enabled: tuple[str, ...] = tuple(READERS)) -> DataFrame:
    """files (path, language and text) with symbols, imports and parse_error.

    enabled: languages whose files are read; all others have neither symbols nor imports.
    """
    read = F.col("language").isin(*enabled)
    columns = [c for c in files.columns if c not in ("symbols", "imports", "parse_error")]
    (name,) = [n for n in ("facts", "facts_", "facts__") if n not in files.columns][:1]
    known = dealt(files.where(read)).withColumn(name, facts(F.col("language"), F.col("path"), F.col("text")))
    rest = files.where(~read | F.col("language").isNull()).select(
        *columns, F.array().cast(SYMBOL).alias("symbols"), F.array().cast("array<string>").alias("imports"), F.lit(False).alias("parse_error")
    )
    return known.select(*columns, f"{name}.symbols", f"{name}.imports", f"{name}.parse_error").unionByName(rest)
