"""The three path pattern dialects, each compiled to a regular expression that the JVM evaluates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NEVER = r"(?!)"


def char_class(pattern: str, at: int) -> tuple[str, int]:
    """The class that begins at a bracket, for the JVM, and where it ends; NEVER if it doesn't."""
    out, i = "", at + 1
    if pattern[i : i + 1] == "^":
        out, i = "^", i + 1
    first = i
    while i < len(pattern):
        c = pattern[i]
        if c == "]" and i > first:
            return f"[{out}]", i
        if c == "\\":
            # an escaped character is itself
            i += 1
            c = pattern[i : i + 1]
            if not c:
                break
            out += re.escape(c) if not c.isalnum() else c
        else:
            out += "-" if c == "-" and first < i else re.escape(c) if not c.isalnum() else c
        i += 1
    return NEVER, len(pattern)


def part(pattern: str) -> str:
    """Wildcards that don't cross a slash; a pattern with an open class or a backslash at its end matches nothing."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[":
            held, i = char_class(pattern, i)
            out += held
        elif c == "\\":
            i += 1
            out += re.escape(pattern[i]) if i < len(pattern) else NEVER
        else:
            out += re.escape(c)
        i += 1
    return out


def ignore(pattern: str) -> str:
    """Exclusion patterns: without a slash they match a base name or the path, with one ** a subtree from the root."""
    n = pattern.count("**")
    if n > 1:
        return NEVER
    if n:
        before, after = (x.strip("/") for x in pattern.split("**"))
        head = re.escape(before)
        if not after:
            return f"^{head}(/.*)?$" if before else "^.*$"
        tail = part(after)
        return f"^{head}/(.*/)?{tail}$" if before else f"^(.*/)?{tail}$"
    return f"^(.*/)?{part(pattern)}$" if "/" not in pattern else f"^{part(pattern)}$"


def supplemental(pattern: str) -> str:
    """Supplemental patterns: lower-cased; what stands before one ** is a plain prefix, which may end within a name; without a slash they match base names anywhere."""
    p = pattern.lower()
    if p.count("**") > 1:
        return NEVER
    if "**" in p:
        before, after = p.split("**")
        return f"^{re.escape(before.removesuffix('/'))}" + (f"/?(.*/)?{part(after.removeprefix('/'))}$" if after else "")
    return f"^(.*/)?{part(p)}$" if "/" not in p else f"^{part(p)}$"


def forbidden(pattern: str) -> str:
    """Patterns of forbidden selections: a literal, dir/**, dir/**/name, or wildcards over the whole path."""
    if pattern.endswith("/**"):
        return f"^{re.escape(pattern[:-3])}(/.*)?$"
    if "/**/" in pattern:
        before, after = pattern.split("/**/", 1)
        return f"^{re.escape(before)}/(.*/)?{re.escape(after)}$"
    return f"^({re.escape(pattern)}|{part(pattern)})$"


def any_of(path: Column, patterns: list[str], dialect=ignore) -> Column:
    """Whether one of the patterns matches: one alternation, one pass."""
    compiled = [dialect(p) for p in patterns]
    return path.rlike("|".join(f"(?:{c})" for c in compiled)) if compiled else F.lit(False)
