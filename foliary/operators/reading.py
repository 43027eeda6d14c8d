"""Reading parts of documents: by heading, by lines with a cursor, by the id of a chunk, by the name of a link."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.functions import markdown as md
from foliary.operators import facts
from foliary.operators.chunking import Lines, fenced_lines, line_table


def headings(docs: DataFrame, source_col: str, text_col: str) -> DataFrame:
    """source, name, level, line, end_line, total of every heading outside front matter, fences and tables: a section reaches to the next heading that is no deeper.

    Chapter lines are of level 1. Sections are nested intervals of lines. Which lines are in a fence or table is folded document by document; the ends are
    running minima over a document's headings.
    """
    names = ["source", "name", "level", "line", "total"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i in range(b.num_rows):
                row = {c: b.column(c)[i].as_py() for c in b.schema.names if c != "kept"}
                if row["lines"]:
                    doc = Lines(row | {"ignore": [0] * len(row["lines"])})
                    open_ = ~fenced_lines(doc.fence, doc.hidden)
                    for a, z in doc.tables(0, len(doc.text)):
                        open_[a : z + 1] = False
                    total = row["used"] + len(row["lines"])
                    out += [(row["source"], doc.name[k], max(1, int(doc.level[k])), row["used"] + k + 1, total) for k in np.flatnonzero((doc.level >= 0) & open_).tolist()]
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()), strict=True)], names)

    rows = line_table(docs, source_col, text_col, exempted=True).withColumn("cost", F.expr("array_repeat(0L, size(lines))"))
    found = rows.mapInArrow(run, "source string, name string, level int, line int, total int")
    ends = facts.next_at_most(found, "source", "line", "level", range(1, 7))
    return ends.select("source", "name", "level", "line", F.coalesce(F.col("next_at") - 1, F.col("total")).alias("end_line"), "total")


def read_heading(docs: DataFrame, source_col: str, text_col: str, requests: DataFrame) -> DataFrame:
    """``requests`` (source, heading) with state, start_line, end_line, content, lines: the section of the heading with that very name.

    States: ``found``; ``ambiguous``, where ``lines`` has the first five places; ``no heading``; ``no source``. Only a found one has content. A request
    is a row of its own; a source comes once in ``docs``.
    """
    asked = requests.select("source", "heading", F.trim("heading").alias("__name"), F.monotonically_increasing_id().alias("__rid"))
    text = docs.select(F.col(source_col).cast("string").alias("__source"), F.col(text_col).alias("__text"))
    wanted = text.join(asked.select("source").distinct(), F.col("__source") == F.col("source"), "left_semi")
    heads = headings(wanted, "__source", "__text").select(F.col("source").alias("__s"), "name", "line", "end_line")
    met = asked.join(heads, (F.col("source") == F.col("__s")) & (F.col("__name") == F.col("name")), "left")
    one = met.groupBy("__rid").agg(F.first("source").alias("source"), F.first("heading").alias("heading"), F.count("line").alias("n"), F.min("line").alias("start_line"), F.min("end_line").alias("end_line"), F.slice(F.sort_array(F.collect_list("line")), 1, 5).alias("lines"))
    both = one.join(wanted, F.col("source") == F.col("__source"), "left")
    state = F.when(F.col("__source").isNull(), "no source").when(F.col("n") == 0, "no heading").when(F.col("n") > 1, "ambiguous").otherwise("found")
    found = both.withColumn("state", state)
    only = lambda c: F.when(F.col("state") == "found", c)
    part = F.array_join(F.slice(md.lines_of(F.col("__text")), F.coalesce("start_line", F.lit(1)), F.coalesce(F.col("end_line") - F.col("start_line") + 1, F.lit(0))), "\n")
    return found.select("source", "heading", "state", only(F.col("start_line")).alias("start_line"), only(F.col("end_line")).alias("end_line"), only(part).alias("content"), "lines")


def read_lines(text: Column, start: int = 1, end: int | None = None, start_char: int = 0, most: int | None = None) -> Column:
    """content, end_line, truncated, next_line, next_char of lines [start, end] of a text, from a character of the first, at most ``most`` characters of it.

    The cursor is where reading goes on: at the beginning of a line if the content ends with a line end. Null where the text has no such line or character, as
    for a null text.
    """
    lines = md.lines_of(text)
    last = F.least(F.size(lines), F.lit(end if end is not None else 2**31 - 1))
    first = F.get(lines, F.lit(start - 1))
    whole = F.substring(F.array_join(F.slice(lines, start, F.greatest(last - start + 1, F.lit(0))), "\n"), start_char + 1, 2**31 - 1)
    content = whole if most is None else F.substring(whole, 1, most)
    cut = F.length(whole) > F.length(content)
    breaks = F.regexp_count(content, F.lit("\n"))
    tail = F.length(F.substring_index(content, "\n", -1)) + F.when(breaks == 0, start_char).otherwise(0)
    at = F.when(cut, start + breaks)
    seen = F.when(cut, start + breaks - F.when(content.endswith("\n"), 1).otherwise(0)).otherwise(last)
    told = F.struct(content.alias("content"), seen.cast("int").alias("end_line"), cut.alias("truncated"), at.cast("int").alias("next_line"), F.when(cut, tail).cast("int").alias("next_char"))
    return F.when(text.isNotNull() & (F.size(lines) >= start) & (last >= start) & (F.length(first) >= start_char), told)


def locate(ids: DataFrame, chunks: DataFrame) -> DataFrame:
    """``ids`` (chunk_id) with state (found, ambiguous, unknown), and vault and source where one vault alone has the chunk."""
    there = chunks.select("chunk_id", "vault", "source").join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi")
    one = there.groupBy("chunk_id").agg(F.max("vault").alias("__last"), F.min(F.struct("vault", "source")).alias("r")).select("chunk_id", "__last", "r.*")
    met = ids.select("chunk_id").join(one, "chunk_id", "left")
    state = F.when(F.col("vault").isNull(), "unknown").when(F.col("vault") != F.col("__last"), "ambiguous").otherwise("found")
    only = lambda c: F.when(state == "found", F.col(c)).alias(c)
    return met.select("chunk_id", state.alias("state"), only("vault"), only("source"))


def stem(path: Column) -> Column:
    """The name of a file without folders and its last extension, in lower case."""
    return F.lower(F.regexp_replace(F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1), r"(?<=.)\.[^.]*$", ""))


def resolve_links(links: DataFrame, files: DataFrame) -> DataFrame:
    """``links`` (link) with state (found, ambiguous, unknown), target and n: the file (``files``: source) that has the link's name, whatever its folder."""
    named = files.select(stem(F.col("source")).alias("__stem"), "source").where("__stem is not null").groupBy("__stem").agg(F.min("source").alias("__target"), F.count("*").alias("__n"))
    clean = F.lower(F.trim(F.regexp_replace(F.regexp_extract("link", r"^\s*(?:\[\[)?([^\]|#]*)", 1), r"(?i)\.(md|markdown)\s*$", "")))
    met = links.withColumn("__name", stem_of_link(clean)).join(named, F.col("__name") == F.col("__stem"), "left")
    n = F.coalesce("__n", F.lit(0))
    state = F.when(n == 0, "unknown").when(n > 1, "ambiguous").otherwise("found")
    return met.select(*links.columns, state.alias("state"), F.when(n == 1, F.col("__target")).alias("target"), n.alias("n"))


def stem_of_link(name: Column) -> Column:
    """The last part of a link's path."""
    return F.element_at(F.split(F.replace(name, F.lit("\\"), F.lit("/")), "/"), -1)


def missing_revisions(chunks: DataFrame, revisions: DataFrame) -> DataFrame:
    """source, revision of chunks whose revision is not among ``revisions`` (source, revision). A snapshot needs this to be empty."""
    named = chunks.where("revision is not null").select("source", "revision").distinct()
    return named.join(revisions.select("source", "revision"), ["source", "revision"], "left_anti")
