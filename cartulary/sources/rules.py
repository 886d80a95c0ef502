"""Ignore rules: lines of ignore files and rules that a caller hands in."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


def ignored(root_rules: Iterable[str]) -> Column:
    """Rules handed in by a caller as one predicate: patterns by fnmatch; the last rule
    that matches decides, and ``!`` takes back, below an ignored directory too."""
    out, path = F.lit(False), F.col("path")
    for line in root_rules:
        rule = line.strip()
        if not rule or rule.startswith("#"):
            continue
        keep, rule = rule.startswith("!"), rule.lstrip("!")
        anchored, rule = "/" in rule.rstrip("/"), rule.strip("/")
        body = fnmatch.translate(rule).removeprefix("(?s:").removesuffix(r")\Z").removesuffix(r")\z").replace(".*", "[^/]*")
        hit = path.rlike(("^" if anchored else "(^|/)") + f"(?:{body})(/|$)")
        out = F.when(hit, F.lit(not keep)).otherwise(out)
    return out


class Rule(NamedTuple):
    """A line of an ignore file: what it matches, and if it takes back."""

    lead: str  # where the corpus lies below the file's directory, for files above it
    pattern: str
    keep: bool
    dirs_only: bool


def glob(rule: str) -> str:
    """An ignore file's pattern as a regular expression over a whole relative path."""
    out, i = "", 0
    while i < len(rule):
        rest = rule[i:]
        if rest.startswith("**/") and (i == 0 or rule[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif rest == "**" and (i == 0 or rule[i - 1] == "/"):
            out, i = out + ".+", i + 2
        elif rest[0] == "*":
            out, i = out + "[^/]*", i + 1
        elif rest[0] == "?":
            out, i = out + "[^/]", i + 1
        elif rest[0] == "[" and "]" in rest[2:]:
            end = rest.index("]", 2)
            inner = rest[1:end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out, i = out + "[" + ("^/" + inner[1:] if inner[0] in "!^" else inner) + "]", i + end + 1
        elif rest[0] == "\\" and len(rest) > 1:
            out, i = out + re.escape(rest[1]), i + 2
        else:
            out, i = out + re.escape(rest[0]), i + 1
    return out


def rules_of(text: str, base: str = "", lead: str = "") -> list[Rule]:
    """The rules of an ignore file in directory ``base``, in their order."""
    out = []
    for line in text.splitlines():
        rule = re.sub(r"(?<!\\) +$", "", line)
        if not rule or rule.startswith("#"):
            continue
        keep, rule = rule.startswith("!"), rule.removeprefix("!")
        dirs_only, rule = rule.endswith("/"), rule.rstrip("/")
        anywhere, rule = "/" not in rule, rule.removeprefix("/")
        if rule:
            below = re.escape(base) + ("(?:.*/)?" if anywhere else "")
            out.append(Rule(lead, f"(?s)^{below}{glob(rule)}$", keep, dirs_only))
    return out
