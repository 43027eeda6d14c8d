"""Ignore files: each line a glob, compiled to one regular expression over lower-case paths; the last line that matches decides.

A pattern without a slash is matched with every segment of a path; one with a slash with the whole path from the root, where ``*`` crosses slashes, or as a
folder above it. A slash at the end keeps a pattern to folders, ``!`` takes back, ``#`` is a comment. Case does not count.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob(pattern: str, across: bool) -> str:
    """A glob as a Java regular expression. ``across``: wild cards match slashes too."""
    one, many = (".", ".*") if across else ("[^/]", "[^/]*")
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2 + (pattern[i + 1 : i + 2] == "!")) if c == "[" else -1
        if c == "*":
            out.append(many)
        elif c == "?":
            out.append(one)
        elif end > 0:
            negated = pattern[i + 1] == "!"
            chars = re.sub(r"([\\\[\]&^~])", r"\\\1", pattern[i + 1 + negated : end])
            out.append(("" if across else "(?!/)") + f"[{'^' if negated else ''}{chars}]")
            i = end
        else:
            out.append(re.sub(r"([^\w\s])", r"\\\1", c))
        i += 1
    return re.sub(r"(?:\.\*)+", ".*", "".join(out))


def rules(lines: Iterable[str], folders: bool = False) -> list[tuple[str, bool]]:
    """(regular expression, ignore) of the lines of an ignore file, for paths of files, or of ``folders``. Match them with ``normal_path``."""
    found = []
    for line in lines:
        text = line.strip()
        ignore = not text.startswith("!")
        text = text if ignore or text.startswith("#") else text[1:].strip()
        if not text or line.strip().startswith("#"):
            continue
        folder = text.endswith("/")
        name = text.rstrip("/").replace("\\", "/").rstrip("/").lower()
        if "/" not in name:
            found.append((f"(?s)(^|/){glob(name, False)}{'/' if folder and not folders else '(/|$)'}", ignore))
        else:
            name = name.lstrip("/")
            literal = re.sub(r"([^\w\s])", r"\\\1", name)
            found.append((f"(?s)^(?:{glob(name, True)}|{literal}{'(?:/.*)?' if folder else '/.*'})$", ignore))
    return found


def normal_path(path: Column) -> Column:
    """A path with forward slashes, none at its ends, in lower case."""
    return F.lower(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^/+|/+$", ""))


def is_ignored(path: Column, lines: Iterable[str], folders: bool = False) -> Column:
    """Whether the last rule that matches says so; false without one, and for a null or empty path. The rules are a configured list, so they are one expression."""
    verdict = F.lit(False)
    for pattern, ignore in rules(lines, folders):
        verdict = F.when(normal_path(path).rlike(pattern), F.lit(ignore)).otherwise(verdict)
    return F.when(normal_path(path) != "", verdict).otherwise(False)
