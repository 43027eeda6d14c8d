"""Chunk tables of Markdown documents, token estimates, and hash embeddings."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.functions import markdown as md
from foliary.functions import tables as tb
from foliary.functions.text import chunk_id, col, content_hash
from foliary.operators.token_chunks import Limits, section_pieces

# Estimated tokens of a space, a Han character, the start and the rest of an ASCII word, a mark, any other character.
SPACE, HAN, START, REST, MARK, OTHER = 0.15, 0.62, 1.30, 0.25, 0.0, 1.15
#: Bytes of text of a task that cuts documents: so much is in Python at once, with some ten times as much of what was found in its lines.
TASK_BYTES = 1 << 20
_HAN = r"[㐀-鿿豈-﫿\x{20000}-\x{323AF}]"


def spread(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` dealt evenly to tasks of about ``TASK_BYTES`` bytes of text each, however few files or row groups hold them."""
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return docs.repartition(max(1, -(-total // TASK_BYTES)))


def line_table(docs: DataFrame, source_col: str, text_col: str, keep: Sequence[str] = (), exempted: bool = False) -> DataFrame:
    """kept (a struct of the columns ``keep``), source, tags, used, and one entry for each line below the front matter in lines, ignore, fence, level, name, flags, opens, closes, cost.

    Exempt documents are left out, unless ``exempted``. Costs are hundredths of estimated tokens.
    """
    # most texts and lines hold none of the characters that a mark begins with, which is quick to see; ``may`` is the same test on both
    may = {
        "heads": lambda x: F.contains(x, F.lit("#")) | x.rlike("(?i)第|chapter"),
        "ignore": lambda x: F.contains(x, F.lit("<!--")),
        "fence": lambda x: F.contains(x, F.lit("```")) | F.contains(x, F.lit("~~~")),
        "flags": lambda x: x.rlike("[#<|]|---|```|~~~"),
        "opens": lambda x: F.contains(x, F.lit("<")),
        "closes": lambda x: F.contains(x, F.lit("<")),
    }
    none = {"heads": F.struct(F.lit(-1).cast("tinyint").alias("level"), F.lit("").alias("name")), "ignore": F.lit(0).cast("tinyint"), "fence": F.lit(""), "flags": F.lit(0).cast("tinyint"), "opens": F.lit(0), "closes": F.lit(0)}

    def each(name: str, f) -> Column:
        found = F.transform("lines", lambda x: F.when(may[name](x), f(x)).otherwise(none[name]))
        return F.when(F.col("may")[name], found).otherwise(F.array_repeat(none[name], F.size("lines")))

    seen = F.struct(*[f(F.col(text_col)).alias(c) for c, f in may.items()]).alias("may")
    rows = docs.select(F.struct(F.lit(0).alias("__"), *keep).alias("kept"), F.col(source_col).cast("string").alias("source"), seen, F.startswith(F.ltrim(F.coalesce(text_col, F.lit(""))), F.lit("---")).alias("front"), md.lines_of(F.col(text_col)).alias("all"))
    rows = rows.withColumn("used", F.when(F.col("front"), md.front_size(F.col("all"))).otherwise(0))
    rows = rows.withColumn("found", F.when(F.col("used") > 0, md.front_matter(F.col("all"), F.col("used")))).where(F.lit(exempted) | ~F.col("front") | ~md.exempt(F.col("found")))
    rows = rows.select("kept", "source", "may", md.listed(F.col("found")["tags"]).alias("tags"), "used", F.slice("all", F.col("used") + 1, F.greatest(F.size("all"), F.lit(1))).alias("lines"))
    rows = rows.withColumn("heads", each("heads", md.heading))
    marks = {"ignore": md.ignore_mark, "fence": md.fence_mark, "flags": tb.table_flags, "opens": lambda x: F.regexp_count(x, F.lit(tb.OPENS)), "closes": lambda x: F.regexp_count(x, F.lit(tb.CLOSES))}
    return rows.select("kept", "source", "tags", "used", "lines", F.col("heads.level").alias("level"), F.col("heads.name").alias("name"), *[each(c, f).alias(c) for c, f in marks.items()], F.transform("lines", token_hundredths).alias("cost"))


def hidden_lines(ignore: np.ndarray) -> np.ndarray:
    """Lines of ignored blocks: those that begin one, and those after which the nearest mark above leaves one open."""
    at = np.maximum.accumulate(np.where(ignore > 0, np.arange(len(ignore)), -1))
    is_open = (at >= 0) & (ignore[at] == 1)
    return (ignore & 1 > 0) | np.concatenate([[False], is_open[:-1]])


def fenced_lines(fence: Sequence[str], hidden: np.ndarray, width: int | None = None) -> np.ndarray:
    """Lines from one that opens a fence to the one before that which closes it with as many of the same mark, or with ``width`` of them."""
    change = np.zeros(len(fence) + 1, np.int64)
    mark = ""
    for i in [i for i, f in enumerate(fence) if f and not hidden[i]]:
        if not mark:
            mark = fence[i][:width]
            change[i] += 1
        elif fence[i].startswith(mark):
            mark = ""
            change[i] -= 1
    return np.cumsum(change)[:-1] > 0


def packed(lines: Sequence[str], first_line: int, size: int, overlap: int) -> Iterator[tuple[int, int, str]]:
    """(first line, last line, text) of chunks of about ``size`` characters, counting a line end for each line.

    A chunk ends before the line that would not fit; the next begins with the last lines that cover ``overlap`` characters. A line
    above ``size`` is cut into pieces that are chunks of their own, the last of which goes on with what follows.
    """
    held: list[str] = []
    first, cost = first_line, 0
    for at, line in enumerate(lines, first_line):
        if held and cost + len(line) + 1 > size:
            yield first, at - 1, "\n".join(held)
            room, keep = overlap, len(held)
            while keep and room > 0:
                keep -= 1
                room -= len(held[keep]) + 1
            held = held[keep:]
            first, cost = at - len(held), sum(len(x) + 1 for x in held)
        if len(line) <= size:
            held.append(line)
            cost += len(line) + 1
            continue
        for i in range(0, len(line), size):
            if held:
                yield first, max(first, at - 1), "\n".join(held)
            held, first = [line[i : i + size]], at
        cost = len(held[0]) + 1
    if held:
        yield first, first_line + len(lines) - 1, "\n".join(held)


class Lines:
    """The lines of one document below its front matter, with what native expressions found in them; those of ignored blocks are blank."""

    def __init__(self, row: dict):
        self.hidden = hidden_lines(np.array(row["ignore"], np.int8))
        for c in ("level", "flags", "opens", "closes", "cost"):
            values = np.array(row[c], np.int64)
            setattr(self, c, np.where(self.hidden, -1 if c == "level" else 0, values))
        self.text = ["" if h else x for x, h in zip(row["lines"], self.hidden.tolist(), strict=True)]
        self.fence = ["" if h else x for x, h in zip(row["fence"], self.hidden.tolist(), strict=True)]
        self.name = row["name"]

    def tables(self, a: int, z: int) -> list[tuple[int, int]]:
        """HTML tables within these lines, counted from the first of them."""
        fenced = fenced_lines(self.fence[a:z], np.zeros(z - a, bool), 3)
        return tb.html_blocks(self.opens[a:z], self.closes[a:z], self.flags[a:z], fenced)


def sections(source: str, doc: Lines) -> tuple[str, list[tuple[int, int, str]]]:
    """The title, and (first line, end, heading) of the sections: a heading outside fences and tables with the lines to the next.

    Blank lines before any text, and blank sections, are left out. The title is the first heading of level one, else the first but chapters, else the file name.
    """
    fenced = fenced_lines(doc.fence, doc.hidden)
    heads = np.flatnonzero((doc.level >= 0) & ~fenced)
    ranked = sorted((int(doc.level[i]) != 1, i) for i in heads if doc.level[i])
    file = source.rsplit("/", 1)[-1]
    title = doc.name[ranked[0][1]] if ranked else file.rpartition(".")[0] or file or source
    in_table = np.zeros(len(doc.text) + 1, bool)
    for a, z in doc.tables(0, len(doc.text)):
        in_table[a : z + 1] = True
    cuts = heads[~in_table[heads]]
    edges = np.unique([0, *cuts, len(doc.text)]).tolist()
    found = []
    for a, z in zip(edges[:-1], edges[1:], strict=True):
        lead = next((i for i in range(a, z) if doc.text[i].strip()), z)
        if lead < z:
            found.append((lead, z, doc.name[a] if a in cuts else title))
    return title, found


def document_rows(source: str, used: int, doc: Lines, size: int, overlap: int) -> Iterator[tuple]:
    """(index, title, heading, first line, last line, content) of the chunks of one document by characters. A table is a chunk of its own, or several tables if longer than ``size``."""
    title, found = sections(source, doc)
    index = 0
    for a, z, heading in found:
        at, line = a, used + 1
        made: list[tuple[int, int, str]] = []
        for p, q in [*((a + p, a + q + 1) for p, q in doc.tables(a, z)), (z, z)]:
            made += packed(doc.text[at:p], line + at, size, overlap)
            some = doc.text[p:q]
            if sum(len(x) + 1 for x in some) <= size:
                made += [(line + p, line + q - 1, "\n".join(some))] if some else []
            else:
                made += [(line + p + x, line + p + y, "\n".join(t)) for x, y, t in tb.split_table(some, size)]
            at = q
        for p, q, content in made:
            yield index, title, heading, p, q, content.strip()
            index += 1


def token_rows(source: str, used: int, doc: Lines, limits: tuple[int, int, int]) -> Iterator[tuple]:
    """(index, title, heading, first line, last line, content, first character, end character, synthetic characters, oversize) of the chunks of one document by estimated tokens.

    Contents keep white space; blank ones are left out. Characters are those of a piece of one long line, else null.
    """
    title, found = sections(source, doc)
    index = 0
    for a, z, heading in found:
        for x in section_pieces(doc.text[a:z], doc.cost[a:z], doc.fence[a:z], doc.opens[a:z], doc.closes[a:z], doc.flags[a:z], limits):
            body = "\n".join(doc.text[a + x.a : a + x.b]) if x.end is None else doc.text[a + x.a][x.start : x.end]
            content = x.prefix + body + x.suffix
            if content.strip():
                cut = (None, None) if x.end is None else (x.start, x.end)
                yield index, title, heading, used + a + x.a + 1, used + a + x.b, content, *cut, len(x.prefix) + len(x.suffix), x.oversize
                index += 1


_KEYS = {"source": pa.string(), "tags": pa.list_(pa.string())}
_CHUNK = {"chunk_index": pa.int32(), "title": pa.string(), "heading": pa.string(), "start_line": pa.int32(), "end_line": pa.int32(), "content": pa.string()}
_CUT = {"start_char": pa.int32(), "end_char": pa.int32(), "synthetic_chars": pa.int32(), "oversize": pa.bool_()}
_DDL = "source string, tags array<string>, chunk_index int, title string, heading string, start_line int, end_line int, content string"


def _fold(rows: DataFrame, make, kinds: dict[str, pa.DataType], ddl: str, keep: Sequence[str]) -> DataFrame:
    """The chunks that ``make`` (source, used, lines) gives of each document, in Arrow batches, with the document's kept columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, of = [], []
            for i in range(b.num_rows):
                row = {c: b.column(c)[i].as_py() for c in b.schema.names if c != "kept"}
                if row["lines"]:
                    made = [(row["source"], row["tags"], *c) for c in make(row["source"] or "", row["used"], Lines(row))]
                    out += made
                    of += [i] * len(made)
            cols = list(zip(*out, strict=True)) or [()] * len(kinds)
            arrays = [pa.array(c, t) for c, t in zip(cols, kinds.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("kept").take(pa.array(of, pa.int64())), *arrays], ["kept", *kinds])

    kept = rows.schema["kept"].dataType.simpleString()
    made = rows.mapInArrow(run, f"kept {kept}, {ddl}")
    named = made.select(*[F.col("kept")[c].alias(c) for c in keep], *kinds)
    return named.withColumn("chunk_id", chunk_id("source", "chunk_index", "content")).withColumn("content_hash", content_hash("content"))


def chunk_documents(docs: DataFrame, source_col: str, text_col: str, size: int = 800, overlap: int = 120, keep: Sequence[str] = ()) -> DataFrame:
    """source, chunk_index, chunk_id, title, heading, start_line, end_line, content, content_hash, tags: chunks of about ``size`` characters.

    Front matter, marks and headings are native expressions, as are identities. What depends on the lines above (open fences, tables and ignored blocks, and
    what a chunk holds so far) is folded document by document in Arrow batches, without a shuffle. A null text has no chunks. The columns ``keep``
    of the document come first; their names must differ from those above.
    """
    rows = line_table(spread(docs, text_col), source_col, text_col, keep).withColumn("cost", F.expr("array_repeat(0L, size(lines))"))
    return _fold(rows, lambda s, u, d: document_rows(s, u, d, size, overlap), _KEYS | _CHUNK, _DDL, keep)


def chunk_documents_by_tokens(docs: DataFrame, source_col: str, text_col: str, limits: Limits = Limits(), keep: Sequence[str] = ()) -> DataFrame:
    """The columns of ``chunk_documents`` for chunks of about ``limits.target`` estimated tokens, with start_char, end_char, synthetic_chars, tokens, oversize, embeddable.

    start_char and end_char are set where a chunk is a piece of one line; synthetic_chars are those of repeated table headers and added fence marks. Only an
    HTML table or a table row may exceed the hard limit; such a chunk is oversize and is not for embedding. A null text has no chunks.
    """
    at = limits.hundredths()
    rows = _fold(line_table(spread(docs, text_col), source_col, text_col, keep), lambda s, u, d: token_rows(s, u, d, at), _KEYS | _CHUNK | _CUT, _DDL + ", start_char int, end_char int, synthetic_chars int, oversize boolean", keep)
    return rows.withColumn("tokens", estimated_tokens("content")).withColumn("oversize", F.col("oversize") | (F.col("tokens") > limits.hard)).withColumn("embeddable", ~F.col("oversize"))


def small_tables_as_pipes(docs: DataFrame, text_col: str, most: int = 60) -> DataFrame:
    """``docs`` with small plain HTML tables in the text as pipe tables; those with spans, unequal rows or more than ``most`` cells stay. Texts without tables are not touched."""

    @F.pandas_udf("string")
    def converted(texts):
        return texts.map(lambda t: "\n".join(tb.with_pipe_tables(x := t.splitlines(), _plain_blocks(x), most)))

    has = F.col(text_col).rlike(tb.OPENS)
    return docs.withColumn(text_col, F.when(has, converted(F.when(has, F.col(text_col)).otherwise(""))).otherwise(F.col(text_col)))


def _plain_blocks(lines: Sequence[str]) -> list[tuple[int, int]]:
    """HTML tables of lines that no native expression has looked at."""
    n = lambda pattern: np.array([len(re.findall(pattern, x)) for x in lines], np.int64)
    fence = [(re.match(md.FENCE, x) or ["", ""])[1] for x in lines]
    flags = (n(r"^#{1,6}\s+") > 0) * tb.HEAD + (n(tb.ROW_ENDS) > 0) * tb.ROW_END
    return tb.html_blocks(n(tb.OPENS), n(tb.CLOSES), flags, fenced_lines(fence, np.zeros(len(lines), bool), 3))


def token_hundredths(t: Column) -> Column:
    """Hundredths of estimated tokens, from counts of character classes: by how much shorter a text is without their runs."""
    size = F.length(t)
    gone = lambda pattern: size - F.length(F.regexp_replace(t, pattern, ""))
    other_scripts = lambda pattern: F.when(F.octet_length(t) == size, 0).otherwise(gone(pattern))  # noqa: E731  ASCII has none
    space, word, starts = gone(r"[\s\x{1C}-\x{1F}\x{85}\p{Z}]+"), gone("[A-Za-z0-9_]+"), F.regexp_count(t, F.lit("[A-Za-z0-9_]+"))
    han, marks = other_scripts(f"{_HAN}+"), other_scripts(r"\p{M}+")
    # 15 for a space, 62 for a Han character, 130 for the first and 25 for each further character of a word, none for a mark, 115 for any other: each count is used once
    whole = (size * 115 - space * 100 - han * 53 - word * 90 + starts * 105 - marks * 115).cast("long")
    return F.when(t.rlike(r"^[A-Za-z0-9_]+\z"), (size * 25 + 105).cast("long")).otherwise(whole)  # one word


def estimated_tokens(text: str | Column) -> Column:
    """Estimated tokens: no Python, and the sum is exact in hundredths."""
    return token_hundredths(col(text)) / F.lit(100.0)


def hash_embedding(text: str | Column, size: int = 384) -> Column:
    """Unit vector from the bytes of sha256, repeated: byte / 127.5 - 1. For tests and offline use."""
    hexes = F.sha2(col(text), 256)
    byte = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.conv(F.substring(hexes, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 127.5 - 1.0)
    whole = F.slice(F.flatten(F.array_repeat(byte, -(-size // 32))), 1, size)
    norm = F.sqrt(F.aggregate(whole, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(whole, lambda x: x / F.when(norm > 0, norm).otherwise(1.0))
