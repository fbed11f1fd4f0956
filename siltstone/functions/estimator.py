"""Token estimates by model: bytes alone, or byte-pair ranks of the model's encoding.

A model's prefix names its encoding, whose rank table is a file given as a parameter (a line for each token:
base64 and rank). Words are split by the encoding's pattern and merged by rank, each distinct word once in
a worker. Models that aren't known, and those that publish no table, are estimated by bytes; a known
model without a table is an error.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import tokens_heuristic

# Encodings by prefix of the model's name, the first that fits counts.
ENCODINGS = {"gpt-4o": "o200k_base", "gpt-4": "cl100k_base", "gpt-3.5-turbo": "cl100k_base", "codex-": "p50k_base", "o1": "o200k_base", "o3": "o200k_base", "o4": "o200k_base"}
# How the encodings split texts into words.
ENDINGS = r"(?i:'s|'t|'re|'ve|'m|'ll|'d)?"
UPPER, LOWER = r"[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]", r"[\p{Ll}\p{Lm}\p{Lo}\p{M}]"
PATTERNS = {
    "p50k_base": r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s",
    "cl100k_base": r"'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}++|\p{N}{1,3}+| ?[^\s\p{L}\p{N}]++[\r\n]*+|\s++$|\s*[\r\n]|\s+(?!\S)|\s",
    "o200k_base": rf"[^\r\n\p{{L}}\p{{N}}]?{UPPER}*{LOWER}+{ENDINGS}|[^\r\n\p{{L}}\p{{N}}]?{UPPER}+{LOWER}*{ENDINGS}|\p{{N}}{{1,3}}| ?[^\s\p{{L}}\p{{N}}]+[\r\n/]*|\s*[\r\n]+|\s+(?!\S)|\s+",
}
HEURISTIC = "heuristic-3.5"
#: Words whose counts a worker remembers.
MEMORY = 1 << 20


@functools.lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def pieces(word: bytes, of: dict[bytes, int]) -> int:
    """Into how many tokens a word merges: always the pair of lowest rank first, the leftmost of equals."""
    if word in of:
        return 1
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        best = min(((of[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in of), default=None)
        if best is None:
            break
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return len(parts)


def counter(path: str, pattern: str) -> Callable[[str], int]:
    import regex

    find, of, known = regex.compile(pattern).findall, ranks(path), {}

    def count(text: str) -> int:
        if len(known) > MEMORY:
            known.clear()
        total = 0
        for word in find(text):
            n = known.get(word)
            if n is None:
                n = known[word] = pieces(word.encode("utf-8", "replace"), of)
            total += n
        return total

    return count


@dataclass(frozen=True)
class Estimator:
    """identity and version as manifests name them; without a table, bytes decide."""

    identity: str = HEURISTIC
    version: str = "v1"
    table: str | None = None
    pattern: str = ""

    def tokens(self, text: Column, n_bytes: Column | None = None) -> Column:
        """Tokens of a text; its bytes may be given where they are known."""
        if self.table is None:
            return tokens_heuristic(F.octet_length(text) if n_bytes is None else n_bytes)
        table, pattern = self.table, self.pattern

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            count = counter(table, pattern)
            for batch in batches:
                yield batch.fillna("").map(count).astype("int64")

        return F.pandas_udf(run, "bigint")(text)


class NoTable(ValueError):
    """A known model whose encoding has no table here."""


def resolve(model: str, tables: dict[str, str] | None = None) -> Estimator:
    """The estimator of a model; tables: paths of rank tables by encoding, which all executors see."""
    name = model.strip().lower()
    encoding = next((e for prefix, e in ENCODINGS.items() if name.startswith(prefix)), None)
    if encoding is None:
        return Estimator()
    if encoding not in (tables or {}):
        raise NoTable(f"no rank table of {encoding} is given for {model!r}")
    return Estimator(f"tiktoken:{encoding}", encoding, tables[encoding], PATTERNS[encoding])
