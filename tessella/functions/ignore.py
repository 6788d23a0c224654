"""Ignore files (gitignore syntax): patterns become one Column, so that filtering needs no Python on the executors."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _glob(part: str) -> str:
    """A regular expression for one path component."""
    out, i = [], 0
    while i < len(part):
        c = part[i]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and (end := part.find("]", i + 2)) > 0:
            inner = part[i + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]")
            i = end
        elif c == "\\" and i + 1 < len(part):
            i += 1
            out.append(re.escape(part[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return "".join(out)


def pattern_regex(pattern: str) -> tuple[str, bool] | None:
    """(regular expression over a relative path, whether it re-includes); None for blank lines and comments."""
    line = pattern.rstrip("\n")
    line = re.sub(r"(?<!\\)\s+$", "", line)
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[negated:]
    line = line[1:] if line.startswith("\\") and line[1:2] in "#!" else line
    only_dir = line.endswith("/")
    parts = line.strip("/").split("/")
    if not any(parts):
        return None
    anchored = line.startswith("/") or len(parts) > 1
    out = "^" if anchored else "^(?:.*/)?"
    for n, part in enumerate(parts):
        last = n == len(parts) - 1
        if part == "**":
            out += ".*" if last else "(?:.*/)?"
        else:
            out += _glob(part) + ("" if last else "/")
    if parts[-1] != "**":
        out += "/.*$" if only_dir else "(?:/.*)?$"
    return out, negated


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether a relative path is ignored; the last pattern that matches decides."""
    known = [x for x in map(pattern_regex, patterns) if x]
    out = F.lit(False)
    for regex, negated in known:
        out = F.when(path.rlike(regex), F.lit(not negated)).otherwise(out)
    return out
