"""Text expressions. Query text is a driver literal; column text stays in generated code."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Two-letter words that are no acronyms unless written in capitals.
STOP_WORDS = frozenset("a an at be by do go he if in is it me my no of on or so to up we us am".split())

_PIECE = re.compile(r"\w+")
_LATIN_OR_HAN = re.compile("[A-Za-z0-9_]+|[一-鿿]+")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _runs(query: str) -> tuple[list[list[str]], list[list[str]]]:
    """Per piece of word characters, its ASCII words and its Han runs. Other scripts carry no query terms."""
    found = [_LATIN_OR_HAN.findall(p) for p in _PIECE.findall(query)]
    return [[x for x in f if x.isascii()] for f in found], [[x for x in f if not x.isascii()] for f in found]


def query_terms(query: str) -> list[str]:
    """Terms to count in a text: ASCII words in lower case, Han runs as pairs of characters. Repeats count again."""
    out: list[str] = []
    for words, runs in zip(*_runs(query), strict=True):
        out += [w.lower() for w in words]
        for r in runs:
            out += [r] if len(r) == 1 else [r[i : i + 2] for i in range(len(r) - 1)]
    return out


def phrase_groups(query: str) -> list[list[str]]:
    """What a text must hold: of each group any phrase. Words and Han runs of three characters or more; longer runs by threes."""
    out: list[list[str]] = []
    for words, runs in zip(*_runs(query), strict=True):
        out += [[w.lower()] for w in words if len(w) >= 3]
        out += [[r[i : i + 3] for i in range(len(r) - 2)] for r in runs if len(r) >= 3]
    return out


def split_acronyms(query: str) -> tuple[list[str], list[str]]:
    """(regular terms, acronyms): ASCII terms of one or two letters are acronyms, except stop words not written in capitals.

    Such a stop word is left out if anything else is in the query, and regular if not.
    """
    capitals = {p.lower() for p in _PIECE.findall(query) if p.isupper()}
    kinds: dict[str, list[str]] = {"stop": [], "acronym": [], "word": []}
    for t in query_terms(query):
        kinds["stop" if t in STOP_WORDS - capitals else "acronym" if re.fullmatch("[a-z0-9]{1,2}", t) else "word"].append(t)
    return kinds["word"] if kinds["word"] or kinds["acronym"] else kinds["stop"], kinds["acronym"]


def occurrences(text: str | Column, term: str) -> Column:
    """How often ``term`` occurs in the text, without overlaps: by how many bytes are gone without it."""
    t = col(text)
    return ((F.octet_length(t) - F.octet_length(F.replace(t, F.lit(term), F.lit("")))) / F.lit(len(term.encode()))).cast("long")


def overlapping(text: str | Column, term: str) -> Column:
    """How often ``term`` occurs in the text, overlaps included."""
    if all(term[:k] != term[-k:] for k in range(1, len(term))):
        return occurrences(text, term)
    return F.regexp_count(col(text), F.lit(f"(?={re.escape(term)})"))


def haystack(content: str | Column, aliases: Column | None = None) -> Column:
    """Lower-case content, and the aliases that are not blank behind it."""
    low = F.lower(col(content))
    if aliases is None:
        return low
    parts = F.filter(F.transform(aliases, lambda a: F.lower(F.trim(a))), lambda a: a.isNotNull() & (a != ""))
    return F.concat_ws(" ", low, parts)


def chunk_id(source: str | Column, index: str | Column, content: str | Column) -> Column:
    """sha1 of source, index and content with NUL between."""
    nul = F.char(F.lit(0))
    return F.sha1(F.concat(col(source), nul, col(index).cast("string"), nul, col(content)))


def content_hash(content: str | Column) -> Column:
    """The first 16 hex digits of sha256."""
    return F.substring(F.sha2(col(content), 256), 1, 16)


def collapsed(text: str | Column) -> Column:
    """White space runs as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(col(text), r"\s+", " "))


def snippet(content: str | Column, terms: Sequence[str], width: int = 150) -> Column:
    """About ``width`` characters around the first term that occurs; the beginning where none does. Ellipses mark cuts."""
    clean = collapsed(content)
    low = F.lower(clean)
    useful = [t for t in (x.strip().lower() for x in terms) if len(t) >= 2 or "一" <= t <= "鿿"]
    at = F.coalesce(*[F.nullif(F.locate(t, low), F.lit(0)) for t in useful], F.lit(0)) - 1
    size = F.length(clean)
    start = F.greatest(F.lit(0), at - width // 2)
    end = F.least(size, start + width)
    start = F.when(end - start < width, F.greatest(F.lit(0), end - width)).otherwise(start)
    cut = F.trim(F.substring(clean, start + 1, end - start))
    found = F.concat(F.when(start > 0, "...").otherwise(""), cut, F.when(end < size, "...").otherwise(""))
    plain = F.concat(F.rtrim(F.substring(clean, 1, width)), F.lit("..."))
    return F.when(size <= width, clean).when(at < 0, plain).otherwise(found)


def normalised_markdown(text: str | Column) -> Column:
    """No byte-order mark, \\n line ends, one \\n at the end of a text that is not empty."""
    t = F.regexp_replace(F.regexp_replace(col(text), "^﻿", ""), "\r\n?", "\n")
    return F.when(F.length(t) == 0, t).when(t.endswith("\n"), t).otherwise(F.concat(t, F.lit("\n")))


def trigrams(text: str | Column) -> Column:
    """Every three characters in a row of the lower-case text; none of a text of fewer than three."""
    # the characters are bound once, and each gram reads three of them: linear in the text
    chars = F.transform(F.array(F.split(F.lower(col(text)), "")), lambda c: F.transform(F.slice(c, 3, F.greatest(F.size(c), F.lit(1))), lambda z, i: F.concat(F.get(c, i), F.get(c, i + 1), z)))[0]
    return F.when(F.length(col(text)) >= 3, chars).otherwise(F.array().cast("array<string>"))
