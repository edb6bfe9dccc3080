"""Glob patterns as regular expressions, built on the driver."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is ignored by default, and the extensions of text files.
IGNORED = ("**/.git/**", "**/node_modules/**", "**/__pycache__/**", "**/.venv/**", "**/venv/**", "**/*.log", "**/.DS_Store", "**/Thumbs.db", "**/target/**", "**/build/**", "**/dist/**", "**/.vscode/**", "**/.idea/**")
TEXT_EXTENSIONS = (".txt", ".md", ".rst", ".py", ".js", ".ts", ".tsx", ".jsx", ".cs", ".java", ".go", ".rs", ".cpp", ".c", ".h", ".hpp", ".sql", ".json", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".conf", ".html", ".css", ".scss", ".xml", ".sh", ".bash", ".ps1")


def to_regex(pattern: str) -> str:
    """A glob in which * also crosses separators, as an anchored expression for Java and RE2."""
    out = []
    i = 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            body = pattern[i:end]
            out.append("[" + ("^" + body[1:] if body[:1] == "!" else body).replace("\\", "\\\\") + "]")
            i = end + 1
        else:
            out.append(re.escape(c))
    return "^(?s:" + "".join(out) + ")$"


def regexes(patterns=IGNORED) -> tuple[str, str]:
    """(on the whole path, on the last name): both together decide whether a path is ignored."""
    names = []
    for p in patterns:
        bare = p
        while bare.startswith("**/"):
            bare = bare[3:]
        names += {to_regex(p), to_regex(bare)} if bare != p else {to_regex(p)}
    return "|".join(to_regex(p) for p in patterns), "|".join(sorted(names))


def is_ignored(path: Column, patterns=IGNORED) -> Column:
    whole, name = regexes(patterns)
    return path.rlike(whole) | F.element_at(F.split(path, "/"), -1).rlike(name)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def rule_regex(pattern: str) -> str:
    """A rule's pattern: alternatives by |, and one ** for any depth."""
    parts = []
    for p in pattern.split("|"):
        halves = p.split("**")
        if len(halves) == 2:
            parts.append("^" + re.escape(halves[0].rstrip("/")) + to_regex("*" + halves[1])[1:])
        else:
            parts.append(to_regex(p))
    return "|".join(parts)
