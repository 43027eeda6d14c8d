"""Markdown as expressions: front matter as a map of lists, and what each line of a text is. All of it stays in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# What opens a heading, a fence, an ignored block, and a chapter of a book; truth words.
HEADING = r"^(#{1,6})\s+(.+?)\s*$"
FENCE = r"^\s*(`{3,}|~{3,})"
IGNORE_BEGIN = r"(?i)^\s*<!--\s*(?:rag-ignore|rag:ignore|no-rag|norag)\s*-->"
IGNORE_END = r"(?i)^\s*<!--\s*(?:/rag-ignore|/rag:ignore|/no-rag|/norag|end-rag-ignore)\s*-->"
CHAPTER = r"(?i)^(第[0-9一二三四五六七八九十百千]+[章回节卷]|Chapter\s+[0-9]+)\s*(.*)$"
CHAPTER_ENDS, CHAPTER_NEVER, CHAPTER_LENGTH = "。！？!?；;…", "，,；;“”\"", 60
NO_WORDS, YES_WORDS = ("false", "no", "off", "0"), ("true", "yes", "on", "1")

#: Ends of lines; \r\n is one.
BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
_BLANK = r"^[\s\x{3000}\x{A0}]+|[\s\x{3000}\x{A0}]+$"


def bare(s: Column) -> Column:
    """Without white space at the ends, then without quotes."""
    return F.regexp_replace(F.regexp_replace(s, _BLANK, ""), "^['\"]+|['\"]+$", "")


def lines_of(text: Column) -> Column:
    """The lines of a text; a line end at the end of the text begins no further line. None of a null or empty text."""
    parts = F.split(F.coalesce(text, F.lit("")), BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def front_size(lines: Column) -> Column:
    """How many lines the block between two --- lines at the top takes; 0 without one."""
    rest = F.transform(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), lambda x: F.trim(x))
    end = F.array_position(rest, "---").cast("int")
    return F.when((F.trim(F.get(lines, F.lit(0))) == "---") & (end > 0), end + 1).otherwise(0)


def front_matter(lines: Column, size: Column) -> Column:
    """Properties of the block as a map of lower-case keys to lists of strings; of repeated keys the last counts.

    Comments and blank lines are taken out first. What is then left is cut before every line that is no list item, so that a property comes with its
    items. A value in the property's own line is a list of one; [a, b] is cut at commas; items count only where there is no such value.
    """
    block = F.filter(F.transform(F.slice(lines, 2, F.greatest(size - 2, F.lit(0))), lambda x: F.regexp_replace(x, _BLANK, "")), lambda x: ~x.rlike("^(#|$)"))
    entries = F.filter(F.split(F.array_join(block, "\n"), r"\n(?!- )"), lambda e: e.rlike(r"^(?!- )[^\n:]*:"))

    def entry(e: Column) -> Column:
        value = F.trim(F.regexp_extract(e, r"^[^\n:]*:([^\n]*)", 1))
        items = F.transform(F.slice(F.split(e, "\n- "), 2, F.length(e) + 1), bare)
        flow = F.transform(F.filter(F.split(F.regexp_extract(value, r"^\[(.*)\]$", 1), ","), lambda x: F.trim(x) != ""), bare)
        values = F.when(value == "", items).when(value.rlike(r"^\[.*\]$"), flow).otherwise(F.array(bare(value)))
        return F.struct(F.lower(F.trim(F.substring_index(e, ":", 1))).alias("key"), values.alias("value"))

    pairs = F.transform(entries, entry)
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs) + 1), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def listed(values: Column) -> Column:
    """A list property; a single text is cut at commas. Empty without one."""
    one = F.transform(F.split(F.get(values, F.lit(0)), ","), bare)
    return F.coalesce(F.filter(F.when(F.size(values) == 1, one).otherwise(values), lambda x: F.trim(x) != ""), F.array().cast("array<string>"))


def exempt(found: Column, keys: Sequence[str] = (), tags: Sequence[str] = ()) -> Column:
    """The property ``rag`` says no, or one of ``keys`` says yes, or the document has one of ``tags``; case and # do not count."""

    def says(key: str, words: Sequence[str]) -> Column:
        v = found[key.lower()]
        return F.coalesce((F.size(v) == 1) & F.lower(F.get(v, F.lit(0))).isin(*words), F.lit(False))

    out = says("rag", NO_WORDS)
    for key in keys:
        out |= says(key, YES_WORDS)
    if tags:
        own = F.transform(listed(found["tags"]), lambda t: F.ltrim(F.lower(t), F.lit("#")))
        out |= F.coalesce(F.arrays_overlap(own, F.array(*[F.lit(t.lower().lstrip("#")) for t in tags])), F.lit(False))
    return out


def ignore_mark(line: Column) -> Column:
    """2 if the line ends an ignored block, 1 if it begins one, 3 if it does both, else 0."""
    return (line.rlike(IGNORE_BEGIN).cast("int") + line.rlike(IGNORE_END).cast("int") * 2).cast("tinyint")


def fence_mark(line: Column) -> Column:
    """The marks of a fence line; empty for another line."""
    return F.regexp_extract(line, FENCE, 1)


def chapter(line: Column) -> Column:
    """The heading of a chapter line; empty for any other line, such as a sentence that begins like one."""
    s = F.regexp_replace(line, _BLANK, "")
    sentence = s.rlike(f"[{CHAPTER_NEVER}]|[{CHAPTER_ENDS}]$") | (F.length(s) > CHAPTER_LENGTH)
    return F.when(sentence, "").otherwise(F.trim(F.regexp_replace(F.regexp_extract(s, CHAPTER, 0), CHAPTER, "$1 $2")))


def heading(line: Column) -> Column:
    """(level, text) of a line that looks like a heading; chapters have level 0, other lines -1."""
    marks = F.regexp_extract(line, HEADING, 1)
    name = F.trim(F.regexp_replace(F.regexp_extract(line, HEADING, 2), r"\s+#*$", ""))
    other = F.when(line.rlike(r"(?i)^\s*(第|chapter)"), chapter(line)).otherwise("")
    is_heading = marks != ""
    level = F.when(is_heading, F.length(marks)).when(other != "", 0).otherwise(-1)
    return F.struct(level.cast("tinyint").alias("level"), F.when(is_heading, name).otherwise(other).alias("name"))
