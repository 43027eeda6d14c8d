"""Markdown chunking on hand-made documents."""

import numpy as np
from pyspark.sql import functions as F

from foliary.functions import markdown as md
from foliary.functions import tables as tb
from foliary.operators import chunking


def test_front_matter(spark):
    texts = ["---\nTags: [a, 'b']\nrag: no\nlist:\n- x\n\n- y\n# c\nurl: a:b\nurl: 'c'\n---\nbody", "---\nopen", "", None, "x\n---\n---", "---\n---\n", "---\ntags: q, r\nrag: \"0\"\n---"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("l", md.lines_of(F.col("t")))
    df = df.withColumn("n", md.front_size(F.col("l"))).withColumn("m", md.front_matter(F.col("l"), F.col("n")))
    got = [(r.n, r.m, r.tags, r.out) for r in df.select("n", "m", md.listed(F.col("m")["tags"]).alias("tags"), md.exempt(F.col("m")).alias("out"), "i").orderBy("i").collect()]
    assert got[0] == (11, {"tags": ["a", "b"], "rag": ["no"], "list": ["x", "y"], "url": ["c"]}, ["a", "b"], True)
    assert got[1:5] == [(0, {}, [], False)] * 4 and got[5] == (2, {}, [], False)
    assert got[6] == (4, {"tags": ["q, r"], "rag": ["0"]}, ["q", "r"], True)


def test_lines_end_as_texts_do(spark):
    texts = ["a\nb", "a\nb\n", "\n", "", "a\r\n\r\nb\r", "a b\x0bc"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(md.lines_of(F.col("t"))).collect()] == [t.splitlines() for t in texts]


def test_sections_know_fences_and_ignored_blocks(spark):
    text = "\n".join(["# One #", "a", "```", "# no heading", "~~~", "``", "````", "## Two", "b", "<!-- rag-ignore -->", "```", "<!-- /rag-ignore -->", "# Three", "<!-- no-rag --> <!-- /no-rag -->", "c"])
    df = spark.createDataFrame([("f.md", text)], "source string, text string")
    got = [(r.heading, r.start_line, r.end_line, r.content) for r in chunking.chunk_documents(df, "source", "text").orderBy("chunk_index").collect()]
    assert got == [("One", 1, 7, "# One #\na\n```\n# no heading\n~~~\n``\n````"), ("Two", 8, 12, "## Two\nb"), ("Three", 13, 15, "# Three")]


def test_hidden_lines():
    assert chunking.hidden_lines(np.array([0, 1, 1, 0, 2, 0, 2, 3, 0, 1])).tolist() == [False, True, True, True, True, False, False, True, False, True]
    assert chunking.fenced_lines(["", "```", "~~~", "````", ""], np.zeros(5, bool)).tolist() == [False, True, True, False, False]


def test_packing_overlaps_and_cuts():
    lines = ["a" * 30, "b" * 30, "c" * 30]
    assert list(chunking.packed(lines, 5, 64, 20)) == [(5, 6, "\n".join(lines[:2])), (6, 7, "\n".join(lines[1:]))]
    assert [t for _, _, t in chunking.packed(["x", "y" * 25, "z"], 1, 10, 0)] == ["x", "y" * 10, "y" * 10, "yyyyy\nz"]
    assert list(chunking.packed([], 1, 10, 0)) == []


def test_chunk_table(spark):
    rows = [("n/a.md", "---\ntags: q, r\n---\n# T\nhello\n\n# U\nthere"), ("b.md", None), ("c.md", "---\nrag: false\n---\nx"), ("d.x.md", "\n\n"), ("e.x.md", "text\n\n## b\n# a"), ("f.md", "第一章 x\ny")]
    df = spark.createDataFrame(rows, "source string, text string")
    got = [(r.source, r.chunk_index, r.title, r.heading, r.start_line, r.end_line, r.content, r.tags) for r in chunking.chunk_documents(df, "source", "text").orderBy("source", "chunk_index").collect()]
    assert got[3:] == [("f.md", 0, "f", "第一章 x", 1, 2, "第一章 x\ny", []), ("n/a.md", 0, "T", "T", 4, 6, "# T\nhello", ["q", "r"]), ("n/a.md", 1, "T", "U", 7, 8, "# U\nthere", ["q", "r"])]
    assert [(g[2], g[3]) for g in got[:3]] == [("a", "a"), ("a", "b"), ("a", "a")]


def test_token_estimate_and_embedding(spark):
    df = spark.createDataFrame([("ab 銀,é",), ("",)], "t string")
    got = [r[0] for r in df.select(chunking.estimated_tokens("t")).collect()]
    assert got == [4.62, 0.0]
    e = df.select(chunking.hash_embedding("t", 40)).first()[0]
    assert len(e) == 40 and abs(sum(x * x for x in e) - 1) < 1e-12 and e[32:] == e[:8]


def test_chapters(spark):
    lines = ["Chapter 12 The end", "第三章 起点", "Chapter 12, he said", "Chapter 1!", "Chapter 1 " + "x" * 60, "  chapter 3", "Chapters", "# A #", "####### b", "## c d"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, l string")
    got = [tuple(r[0]) for r in df.orderBy("i").select(md.heading(F.col("l"))).collect()]
    assert got == [(0, "Chapter 12 The end"), (0, "第三章 起点"), *[(-1, "")] * 3, (0, "chapter 3"), (-1, ""), (1, "A"), (-1, ""), (2, "c d")]


def test_cutting_is_spread_whatever_holds_the_texts(spark, monkeypatch):
    docs = spark.createDataFrame([(f"d{i}", "some words\n" * 200) for i in range(20)], "path string, text string").coalesce(1)
    monkeypatch.setattr(chunking, "TASK_BYTES", 4400)
    made = chunking.chunk_documents(docs, "path", "text")
    assert made.rdd.getNumPartitions() == 10
    assert made.select("source").distinct().count() == 20


def test_lines_are_what_the_expressions_say_with_marks_anywhere(spark):
    lines = ["", "word", "a_b9", "# Head", "x # y", "Chapter 3 The sea", "第三章 海", "<!-- rag-ignore -->", "<TABLE >a</table>", "</td>", "```", " ~~~~ py", "|---|", "--- x", "a | b", "é word", "漢字 e\u0301"]
    docs = [("every", "\n".join(lines)), *[(f"one{i}", f"plain\n{x}") for i, x in enumerate(lines)], ("null", None)]
    df = spark.createDataFrame(docs, "path string, text string")
    exprs = {"ignore": md.ignore_mark, "fence": md.fence_mark, "flags": tb.table_flags, "opens": lambda x: F.regexp_count(x, F.lit(tb.OPENS)), "closes": lambda x: F.regexp_count(x, F.lit(tb.CLOSES))}
    table = chunking.line_table(df, "path", "text", exempted=True)
    want = table.select(*[F.transform("lines", f).alias(c) for c, f in exprs.items()], F.transform("lines", lambda x: md.heading(x)["level"]).alias("level"), F.transform("lines", lambda x: md.heading(x)["name"]).alias("name"))
    assert [tuple(r) for r in table.select(*want.columns).collect()] == [tuple(r) for r in want.collect()]
