"""Globs, path patterns and query text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPECIAL = set(r"\.^$+{}()|*?[]")
GLOB_CHARS = frozenset("*?[")


def glob_regex(pattern: str) -> str:
    """Whole-string regular expression of a glob; ``*`` and ``?`` also match a slash, ``[!x]`` negates.

    A bracket that is never closed stands for itself.
    """
    out, i = ["(?s)^"], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            while i < len(pattern) and pattern[i] == "*":
                i += 1
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := pattern.find("]", i + 1 + (pattern[i : i + 1] == "!"))) > 0:
            inner = pattern[i:end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            i = end + 1
            out.append("[^" + inner[1:] + "]" if inner.startswith("!") else "[" + ("\\" if inner.startswith("^") else "") + inner + "]")
        else:
            out.append("\\" + c if c in _SPECIAL else c)
    return "".join(out) + "$"


def literal_prefix(pattern: str) -> str:
    """The part of a glob that every match begins with, cut back to a whole directory."""
    plain = re.split(r"[*?\[]", pattern, maxsplit=1)[0]
    return pattern if plain == pattern else plain[: plain.rfind("/") + 1]


def path_matches(path: Column, pattern: str) -> Column:
    """Without glob characters: the path itself or anything below it. With them: the whole path as a glob."""
    if not GLOB_CHARS & set(pattern):
        below = pattern.rstrip("/") + "/"
        return (path == pattern.rstrip("/")) | path.startswith(below)
    return path.startswith(literal_prefix(pattern)) & path.rlike(glob_regex(pattern))


def allowed_path(path: Column, suffixes: list[str], denied_parts: list[str]) -> Column:
    """Whether a path ends in one of the suffixes and has none of the parts."""
    ends = F.lit(False)
    for suffix in suffixes:
        ends = ends | path.endswith(suffix)
    return ends & ~F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(p) for p in denied_parts])) if denied_parts else ends


_COLUMN_TERM = re.compile(r"(\w+):(\S)")


def normalise_query(text: str | None, columns: frozenset[str] = frozenset({"content", "docstring", "name"})) -> str | None:
    """Query text with slashes and hyphens as spaces and terms of unknown columns split; nothing left: ``None``."""
    cleaned = (text or "").strip().replace("/", " ")
    cleaned = _COLUMN_TERM.sub(lambda m: m.group() if m.group(1) in columns else f"{m.group(1)} {m.group(2)}", cleaned)
    cleaned = " ".join(cleaned.replace("-", " ").split())
    return cleaned or None


def prefix_terms(text: str | None) -> list[str]:
    """Lower-cased words of a normalised query, each to be matched as a prefix."""
    return [w.lower() for w in re.findall(r"\w+", normalise_query(text) or "")]
