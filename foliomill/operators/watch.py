"""Watchlist patterns over file paths."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str:
    """Regular expression of an absolute glob: ``**`` any depth, ``*`` and ``?`` within a name, no hidden names."""
    if not pattern.startswith("/"):
        raise ValueError("pattern must be absolute")
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + r"(?:(?!\.)[^/]+/)*", i + 3
        elif pattern.startswith("**", i):
            out, i = out + r"(?:(?!\.)[^/]+/)*(?!\.)[^/]+", i + 2
        elif pattern[i] == "*":
            out, i = out + (r"(?!\.)[^/]*" if pattern[i - 1] == "/" else "[^/]*"), i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return f"^{out}$"


def checked_pattern(pattern: str) -> str:
    """The pattern with the home folder for ``~``; it must be absolute."""
    found = os.path.expanduser(pattern.strip())
    glob_regex(found)
    return found


def selected(paths: DataFrame, include: list[str], exclude: list[str]) -> DataFrame:
    """Distinct ``file_path`` that an include pattern selects and no exclude pattern does; exclusion always wins.

    A pattern in both lists is an error; no include pattern selects nothing.
    """
    if both := set(include) & set(exclude):
        raise ValueError(f"patterns both included and excluded: {sorted(both)}")
    any_of = lambda ps: F.greatest(F.lit(False), F.lit(False), *[F.col("file_path").rlike(glob_regex(p)) for p in ps])
    return paths.select("file_path").distinct().where(any_of(include) & ~any_of(exclude))


def move_pattern(patterns: dict[str, str], pattern: str, kind: str | None) -> dict[str, str]:
    """Include, exclude or (kind None) remove a pattern; it is in one list at most."""
    rest = {p: k for p, k in patterns.items() if p != pattern}
    return dict(sorted((rest | ({pattern: kind} if kind else {})).items()))
