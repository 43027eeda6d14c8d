"""Retrieval semantics that the tables do not exercise."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from foliary.functions import text as tx
from foliary.operators import facts, search
from foliary.sources.tables import text_folder


def test_query_terms_of_several_scripts():
    assert tx.query_terms("Plan B 銀河鉄 café") == ["plan", "b", "銀河", "河鉄", "caf"]
    assert tx.query_terms("") == []
    assert tx.phrase_groups("ab 銀河 銀河鉄道 plan") == [["銀河鉄", "河鉄道"], ["plan"]]


def test_acronyms_and_stop_words():
    assert tx.split_acronyms("IT in a plan") == (["plan"], ["it"])
    assert tx.split_acronyms("in of") == (["in", "of"], [])


def test_bm25_agrees_with_sqlite(spark):
    texts = ["the license of the plan", "license license", "apache", "", "a plan for the apache license, version two", "ab"]
    db = sqlite3.connect(":memory:")
    try:
        db.execute("create virtual table f using fts5(c, tokenize='trigram')")
    except sqlite3.OperationalError:
        pytest.skip("no trigram tokenizer")
    db.executemany("insert into f(rowid, c) values (?, ?)", list(enumerate(texts, 1)))
    want = {i - 1: -s for i, s in db.execute("""select rowid, bm25(f) from f where f match '"license" AND "plan"'""")}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, content string")
    got = {r.id: r.bm25 for r in search.bm25(df, "license plan").collect()}
    assert got == pytest.approx(want, rel=1e-9)


def test_rrf_adds_ranks_in_route_order(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "chunk_id string, rank long")
    b = spark.createDataFrame([("y", 1)], "chunk_id string, rank long")
    got = {r.chunk_id: r.score for r in search.fuse([a, b]).collect()}
    assert got == {"x": 1 / 61, "y": 1 / 62 + 1 / 61}


def test_dedupe_keeps_rows_with_null_keys(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None)], "id int, k string")
    assert sorted(r.id for r in search.dedupe(df, ["k"], [F.col("id")]).collect()) == [1, 3, 4]


def test_rerank_puts_scored_first_and_tail_last(spark):
    ranked = spark.createDataFrame([(i,) for i in range(5)], "pos int")
    scores = spark.createDataFrame([(1, 0.2), (2, 0.9), (4, 1.0)], "pos int, relevance double")
    got = search.rerank(ranked, scores, cap=4).orderBy("new_pos").collect()
    assert [r.pos for r in got] == [2, 1, 0, 3, 4]


def test_snippet_window(spark):
    df = spark.createDataFrame([("x " * 100 + "needle " + "y " * 100,), ("short  text",), ("",)], "content string")
    a, b, c = (r[0] for r in df.select(tx.snippet("content", ["needle"])).collect())
    assert "needle" in a and a.startswith("...") and a.endswith("...") and len(a) <= 156
    assert (b, c) == ("short text", "")


def test_trigrams_of_short_texts(spark):
    df = spark.createDataFrame([("ab",), ("abc",), ("ABCD",), ("",)], "t string")
    assert [r[0] for r in df.select(tx.trigrams("t")).collect()] == [[], ["abc"], ["abc", "bcd"], []]


def test_islands_merge_touching_ranges(spark):
    df = spark.createDataFrame([("a", 0, 5), ("a", 5, 7), ("a", 9, 10), ("b", 1, 2)], "k string, start int, end int")
    got = sorted((r.k, r.start, r.end, r.n) for r in facts.islands(df, ["k"]).collect())
    assert got == [("a", 0, 7, 2), ("a", 9, 10, 1), ("b", 1, 2, 1)]


def test_overlaps_agree_with_all_pairs(spark):
    import random

    r = random.Random(3)
    iv = [(i, "k", s := r.randrange(100), s + r.randrange(1, 30)) for i in range(60)]
    df = spark.createDataFrame(iv, "id int, key string, start int, end int")
    got = sorted((x.a_id, x.b_id) for x in facts.overlaps(df, df, "key", 10).collect())
    assert got == sorted((a[0], b[0]) for a in iv for b in iv if a[2] < b[3] and b[2] < a[3])


def test_cas_fold_rejects_stale_commits(spark):
    log = spark.createDataFrame([("d", 1, 0), ("d", 2, 0), ("d", 3, 1), ("d", 4, 3), ("e", 5, 1)], "doc string, seq int, want int")
    got = sorted((r.doc, r.version, r.seq) for r in facts.cas_fold(log, "doc", "seq", "want").collect())
    assert got == [("d", 0, 1), ("d", 1, 3)]


def test_text_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_bytes(b"\xef\xbb\xbfhello")
    (tmp_path / "sub" / "b.txt").write_text("there")
    (tmp_path / "bad.md").write_bytes(b"\xff\xfe")
    (tmp_path / "c.pdf").write_text("no")
    (tmp_path / "~d.md").write_text("no")
    got = {r.source.rsplit("/", 1)[1]: (r.content, r.valid) for r in text_folder(spark, str(tmp_path)).collect()}
    assert got == {"a.md": ("hello", True), "b.txt": ("there", True), "bad.md": (None, False)}


def test_upsert_stream(spark, tmp_path):
    from foliary.streaming.events import current, upsert

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    ddl = "k string, v int, at int, deleted boolean"
    spark.createDataFrame([("a", 1, 1, False), ("a", 2, 2, False), ("b", 1, 1, False)], ddl).coalesce(1).write.mode("append").parquet(src)
    start = upsert(spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(src), out, "k", "at", str(tmp_path / "cp"))
    start().awaitTermination(120)
    spark.createDataFrame([("b", 1, 2, True), ("c", 3, 2, False)], ddl).coalesce(1).write.mode("append").parquet(src)
    start().awaitTermination(120)
    assert sorted((r.k, r.v) for r in current(spark, out).collect()) == [("a", 2), ("c", 3)]


def test_admitted_rows(spark):
    df = spark.createDataFrame([("a/x", ["#One"], 5.0), ("a/y", [], None), ("ab", None, 9.0), ("b", ["two"], 1.0)], "source string, tags array<string>, mtime double")
    names = lambda **f: [r[0] for r in df.where(search.admitted(**f)).orderBy("source").collect()]
    assert names() == ["a/x", "a/y", "ab", "b"] and names(prefix=" a/ ") == ["a/x", "a/y", "ab"] and names(tags=["ONE", "#two"]) == ["a/x", "b"]
    assert names(since=5) == ["a/x", "a/y", "ab"] and names(until=5) == ["a/x", "a/y", "b"] and names(prefix="a/", since=6, until=7) == ["a/y"]
