"""Tables in Markdown and chunks by estimated tokens: hand-made cases, and that every character of a text is in some chunk."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliary.functions import tables as tb
from foliary.operators import chunking
from foliary.operators.token_chunks import Limits, character_costs, pieces, ranges

TH = "<tr><th>h1</th><th>h2</th></tr>"
SMALL = Limits(24, 4, 48)


def row(*cells):
    return "<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"


def table(*lines):
    return ["<table>", *lines, "</table>"]


@pytest.mark.parametrize(
    "lines, size, want",
    [
        (table(TH, row("a", 1), row("b", 2)), 1200, [(1, 3, table(TH, row("a", 1), row("b", 2)))]),
        # room for rows is never below 100 characters
        (table(TH, row("row-one-cell", "x"), row("row-two-cell", "y"), row("row-three", "z")), 80, [(1, 2, table(TH, row("row-one-cell", "x"))), (3, 4, table(TH, row("row-two-cell", "y"), row("row-three", "z")))]),
        # a table on one line
        ([f"<table>{row('a1')}{row('b2')}{row('c3')}</table>"], 1200, [(0, 0, table(row("a1"), row("b2"), row("c3")))]),
        ([f"<table>{row('x' * 200)}{row('y' * 200)}</table>"], 300, [(0, 0, table(row("x" * 200))), (0, 0, table(row("y" * 200)))]),
        # a cell that does not fit is cut; the header comes again
        (table(TH, row("長" * 1500)), 1200, [(1, 1, table(TH)), (2, 2, table(TH, row("長" * 1154))), (2, 2, table(TH, row("長" * 346)))]),
        (table("<tr>" + "w" * 150 + "</tr>"), 100, [(1, 1, table("<tr>" + "w" * 96)), (1, 1, table("w" * 54 + "</tr>"))]),
        (table("<thead>", TH, "</thead>", "<tbody>", row(1), row(3), "</tbody>"), 150, [(1, 7, table("<thead>", TH, "</thead>", "<tbody>", row(1), row(3), "</tbody>"))]),
        (table(), 1200, [(0, 1, ["<table>", "</table>"])]),
        (table("junk text"), 1200, [(1, 1, table("junk text"))]),
        (["<table>", row("u1"), "<tr><td>u2"], 1200, [(1, 2, table(row("u1"), "<tr><td>u2"))]),
        # after a row that was cut, the next piece still counts from its line; several rows in a line are told apart
        (table(row("q" * 200), row("r1") + row("r2"), row("r3")), 150, [(1, 1, table(row("q" * 104))), (1, 1, table(row("q" * 96))), (1, 3, table(row("r1"), row("r2"), row("r3")))]),
    ],
)
def test_tables_are_split_into_tables(lines, size, want):
    assert tb.split_table(lines, size) == want


def blocks_of(lines):
    return chunking._plain_blocks(lines)


def test_table_blocks():
    assert blocks_of(["a", "<table>", "x", "</table>", "b", "<TABLE border=1><tr></TABLE >"]) == [(1, 3), (5, 5)]
    assert blocks_of(["<table><tr><td>", "<table>", "</table>", "</td></tr></table>", "z"]) == [(0, 3)]
    assert blocks_of(["```", "<table>", "```", "<table>", "</table>", "~~~ <table>", "</table>"]) == [(3, 4)]
    assert blocks_of(["<table>", "<tr><td>a</td>", "text", "</tr>", "more", "# Head", "</td>"]) == [(0, 3)]
    assert blocks_of(["<table>", *["x"] * 60, "</tr>"]) == [(0, 0)]
    assert blocks_of(["</table>", "<table>", "</table>"]) == []  # a stray end hides the table after it
    assert blocks_of(["<tables>", "<table"]) == []


def test_native_marks_agree_with_the_plain_ones(spark):
    lines = ["# a", "#b", "x </TD>", "```", "~~~~ py", " ```  ", "| a | b |", "|---|:---:|", "--- | ---", "a < b", "<table>", "</table >", "<Table x><table\t></table>"]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, l string").select("i", tb.table_flags(F.col("l")).alias("f"), F.regexp_count("l", F.lit(tb.OPENS)).alias("o"), F.regexp_count("l", F.lit(tb.CLOSES)).alias("c")).orderBy("i").collect()
    assert [r.f for r in got] == [1, 0, 2, 4, 0, 4, 8, 24, 24, 0, 0, 0, 0]
    assert [(r.o, r.c) for r in got[-3:]] == [(1, 0), (0, 1), (2, 1)]


def test_small_tables_become_pipe_tables(spark):
    plain = "before\n" + "\n".join(table("<tr><th>a</th><th> b </th></tr>", "<tr><td>1</td>", "<td>x &amp; y</td></tr>")) + "\nafter\n"
    texts = [plain, plain.replace("<th>a", "<th colspan=2>a"), plain.replace("<td>1</td>", ""), "no table", None, "<table><tr><td>open</td></tr>", "```\n<table><tr><td>c</td></tr></table>\n```", plain + plain]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = [r.text for r in chunking.small_tables_as_pipes(df, "text").orderBy("i").collect()]
    piped = "before\n| a | b |\n| --- | --- |\n| 1 | x & y |\nafter"
    assert got[0] == piped and got[7] == piped + "\n" + piped
    assert got[1].splitlines() == texts[1].splitlines() and got[2].splitlines() == texts[2].splitlines() and got[3:7] == texts[3:7]
    assert tb.as_pipe("<table>" + row(*range(9)) * 7 + "</table>") is None and tb.as_pipe("<table></table>") is None


def test_characters_keep_tables_whole(spark):
    text = "\n".join(["# T", "intro", *table(TH, "# no heading", row(1, 2)), "", "after", *table(*[row("c" * 30, i) for i in range(4)]), "end"])
    df = spark.createDataFrame([("f.md", text)], "source string, text string")
    got = [(r.heading, r.start_line, r.end_line, r.content) for r in chunking.chunk_documents(df, "source", "text", 120, 20).orderBy("chunk_index").collect()]
    big = [row("c" * 30, i) for i in range(4)]
    assert got == [
        ("T", 1, 2, "# T\nintro"),
        ("T", 3, 7, "\n".join(table(TH, "# no heading", row(1, 2)))),
        ("T", 8, 9, "after"),
        ("T", 11, 11, "\n".join(table(big[0]))),
        ("T", 12, 12, "\n".join(table(big[1]))),
        ("T", 13, 13, "\n".join(table(big[2]))),
        ("T", 14, 14, "\n".join(table(big[3]))),
        ("T", 16, 16, "end"),
    ]


TEXTS = {
    "sentences": "hello world. " * 120,
    "han": "中文長行" * 150,
    "lines": "\n".join("word " * 7 for _ in range(80)),
    "fence": "````python\n" + "print('hello world')\n" * 100 + "````",
    "open fence": "~~~python\n" + "variable=" + "x" * 1000,
    "pipe": "| name | value |\n| --- | --- |\n" + "| hello | world |\n" * 100,
    "one column": "| name |\n| --- |\n" + "| hello |\n" * 25,
    "wide header": "| " + "x" * 1000 + " | value |\n| --- | --- |\n| hello | world |",
    "marks": "e\u0301" * 500,
    "html": "<table>\n<thead>\n<tr><th>first</th></tr>\n<tr><th>second</th></tr>\n</thead>\n<tr><td>" + "長" * 1000 + "</td><td>LAST CELL</td></tr>\n</table>\nafter",
    "fence in fence": "````html\n```\n<table>\n<tr><td>inside</td></tr>\n</table>\n````\nafter",
    "blank": "\n \n",
    "mixed": "\n".join(random.Random(8).choice(["a b c d e", "word " * 30, "", "| x | y |", "| --- | --- |", "```", "<table>", "<tr><td>1</td></tr>", "</table>", "長" * 90]) for _ in range(200)),
}


@pytest.fixture(scope="module")
def token_rows(spark):
    df = spark.createDataFrame([(k, v) for k, v in TEXTS.items()], "source string, text string")
    out = {k: [] for k in TEXTS}
    for r in chunking.chunk_documents_by_tokens(df, "source", "text", SMALL).orderBy("source", "chunk_index").collect():
        out[r.source].append(r)
    return out


@pytest.mark.parametrize("name", TEXTS)
def test_chunks_by_tokens_are_bounded_and_hold_everything(name, token_rows):
    lines, found = TEXTS[name].splitlines(), token_rows[name]
    held = set()
    for i, r in enumerate(found):
        assert r.chunk_index == i and r.embeddable == (not r.oversize)
        assert round(r.tokens * 100) == character_costs(r.content).sum()
        assert r.oversize == (r.tokens > SMALL.hard) or "| " in r.content
        if r.start_char is not None:
            assert lines[r.start_line - 1][r.start_char : r.end_char] in r.content and r.start_line == r.end_line
            held.update((r.start_line, c) for c in range(r.start_char, r.end_char))
        else:
            assert "\n".join(lines[r.start_line - 1 : r.end_line]) in r.content
            held.update((n, c) for n in range(r.start_line, r.end_line + 1) for c in range(len(lines[n - 1])))
    assert held == {(n, c) for n, x in enumerate(lines, 1) for c in range(len(x)) if x.strip() or (n, c) in held}


def test_chunks_by_tokens_of_special_blocks(token_rows):
    assert token_rows["blank"] == []
    for name, header in (("pipe", "| name | value |\n| --- | --- |"), ("one column", "| name |\n| --- |")):
        assert len(token_rows[name]) > 1 and all(r.content.startswith(header) for r in token_rows[name])
        assert all(r.synthetic_chars == len(header) + 1 for r in token_rows[name][1:])
    html = token_rows["html"]
    assert html[0].oversize and "LAST CELL" in html[0].content and "second" in html[0].content and html[-1].content == "after"
    assert all("````" in r.content for r in token_rows["fence in fence"][:-1]) and token_rows["fence in fence"][-1].content == "after"
    assert all(r.content.startswith("````python\n") and r.content.endswith("\n````") for r in token_rows["fence"])
    assert token_rows["wide header"][0].oversize
    assert all(not r.content.startswith("\u0301") for r in token_rows["marks"])
    assert all(r.content.endswith(" ") for r in token_rows["sentences"])


def greedy(costs, target, overlap, hard, repeat):
    """One line after the other, as the rule reads."""
    total = lambda some: sum(costs[i] for i in some) + 15 * (len(some) - 1)
    out, held, fresh = [], [], False
    for i, c in enumerate(costs):
        if held and total([*held, i]) > target:
            if fresh:
                out.append((held[0], held[-1] + 1))
            tail = []
            while repeat and len(tail) < len(held) and total(held[-len(tail) - 1 :]) <= overlap:
                tail = held[-len(tail) - 1 :]
            held, fresh = tail, False
        if held and total([*held, i]) > hard:
            held = []
        if c > hard:
            out.append((i, i + 1))
            held, fresh = [], False
        else:
            held, fresh = [*held, i], True
    return out + ([(held[0], held[-1] + 1)] if fresh else [])


def test_ranges_are_those_of_the_greedy_rule():
    r = random.Random(9)
    for _ in range(400):
        costs = [r.choice([0, 15, 130, 500, 1500, 2300, 5000]) for _ in range(r.randrange(30))]
        limits = (r.choice([400, 2400]), r.choice([0, 300, 399]), r.choice([2400, 4800]))
        for repeat in (True, False):
            assert list(ranges(np.array(costs, np.int64), limits, 0, repeat)) == greedy(costs, *limits, repeat)


def test_limits_and_pieces():
    for bad in ((True, 4, 48), (float("nan"), 4, 48), (24, -1, 48), (24, 24, 48), (24, 4, 2)):
        with pytest.raises(ValueError):
            Limits(*bad)
    assert list(pieces("abc def. ghi", 400)) == [(0, 4), (4, 9), (9, 12)]
    assert list(pieces("", 100)) == [] and list(pieces("長長", 1)) == [(0, 1), (1, 2)]
    assert character_costs("ab 銀,é").tolist() == [130, 25, 15, 62, 115, 130, 0]
