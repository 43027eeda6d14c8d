"""Parts of documents: sections, cursors, chunk ids and links."""

import random

from pyspark.sql import functions as F

from foliary.operators import reading

DOC = "\n".join(["---", "title: '# no'", "rag: no", "---", "# A #", "a", "```", "# in fence", "```", "## B", "b", "<table>", "# in table", "</table>", "### C", "c", "## B", "Chapter 2 Two", "d", "# E"])


def test_headings_are_nested_intervals(spark):
    df = spark.createDataFrame([("x.md", DOC), ("y.md", None), ("z.md", "no heading")], "source string, text string")
    got = [tuple(r) for r in reading.headings(df, "source", "text").orderBy("line").collect()]
    assert got == [("x.md", "A", 1, 5, 17, 20), ("x.md", "B", 2, 10, 16, 20), ("x.md", "C", 3, 15, 16, 20), ("x.md", "B", 2, 17, 17, 20), ("x.md", "Chapter 2 Two", 1, 18, 19, 20), ("x.md", "E", 1, 20, 20, 20)] or got[4][1] == "2 Two"


def test_sections_by_heading(spark):
    df = spark.createDataFrame([("x.md", DOC), ("y.md", "")], "source string, text string")
    asked = spark.createDataFrame([("x.md", " C "), ("x.md", "B"), ("x.md", "in fence"), ("y.md", "A"), ("gone.md", "A"), ("x.md", "E"), ("x.md", None)], "source string, heading string")
    got = {(r.source, r.heading): (r.state, r.start_line, r.content, r.lines) for r in reading.read_heading(df, "source", "text", asked).collect()}
    assert got["x.md", " C "] == ("found", 15, "### C\nc", [15]) and got["x.md", "E"][2] == "# E"
    assert got["x.md", "B"] == ("ambiguous", None, None, [10, 17]) and got["x.md", "in fence"][0] == "no heading"
    assert got["y.md", "A"][0] == "no heading" and got["gone.md", "A"][0] == "no source" and got["x.md", None][0] == "no heading"


def test_cursors_lead_through_the_whole_text(spark):
    r = random.Random(3)
    texts = ["".join(r.choice("ab\n\n語") for _ in range(r.randrange(1, 60))) for _ in range(12)]
    for t in texts:
        df = spark.createDataFrame([(t,)], "t string")
        line, char, out, steps = 1, 0, "", 0
        while line is not None:
            x = df.select(reading.read_lines(F.col("t"), line, None, char, 7).alias("r")).first().r
            if x is None:
                break
            out, line, char = out + x.content, x.next_line, x.next_char
            steps += 1
        assert out == "\n".join(t.splitlines()), t
        assert steps <= len(t) // 7 + 2
    odd = spark.createDataFrame([(None,), ("",), ("a\nb",)], "t string")
    assert [r[0] for r in odd.select(reading.read_lines(F.col("t"), 3)).collect()] == [None] * 3
    assert [r[0] and r[0].content for r in odd.select(reading.read_lines(F.col("t"), 1, 1, 1)).collect()] == [None, None, ""]


def test_ids_links_and_revisions(spark):
    chunks = spark.createDataFrame([("1", "a", "x.md", "r1"), ("2", "a", "y.md", "r2"), ("2", "b", "y.md", None), ("3", "a", "z.md", "r9"), ("3", "a", "z2.md", "r1")], "chunk_id string, vault string, source string, revision string")
    got = {r.chunk_id: (r.state, r.vault, r.source) for r in reading.locate(spark.createDataFrame([("1",), ("2",), ("3",), ("9",)], "chunk_id string"), chunks).collect()}
    assert got == {"1": ("found", "a", "x.md"), "2": ("ambiguous", None, None), "3": ("found", "a", "z.md"), "9": ("unknown", None, None)}
    files = spark.createDataFrame([("a/Note.md",), ("b/note.txt",), ("c/v1.2.md",), (".hidden",)], "source string")
    links = spark.createDataFrame([("[[note]]",), ("[[V1.2|shown]]",), ("v1.2.md",), ("[[c/v1.2#part]]",), ("none",), (None,)], "link string")
    got = {r.link: (r.state, r.target, r.n) for r in reading.resolve_links(links, files).collect()}
    assert got["[[note]]"] == ("ambiguous", None, 2) and got["none"] == ("unknown", None, 0) and got[None][0] == "unknown"
    assert all(got[x] == ("found", "c/v1.2.md", 1) for x in ("[[V1.2|shown]]", "v1.2.md", "[[c/v1.2#part]]"))
    known = spark.createDataFrame([("x.md", "r1"), ("y.md", "r2"), ("z2.md", "r1")], "source string, revision string")
    assert [tuple(r) for r in reading.missing_revisions(chunks, known).collect()] == [("z.md", "r9")]
