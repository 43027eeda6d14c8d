"""Steps that hold little at once: batches of texts, Python workers, shuffles."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from foliary.llm import common, line_dedup, ngram_join
from foliary.llm.common import shared_dir
from foliary.llm.edit_fingerprint import edit_distance


def written(spark, rows, ddl="doc_id long, text string"):
    path = shared_dir(spark, "bounded")
    spark.createDataFrame(rows, ddl).write.parquet(path)
    return spark.read.parquet(path)


def test_slices_hold_few_bytes_and_every_row():
    texts = ["a" * 10, None, "", "b" * 500, "c" * 40, "é" * 30, *["d"] * 70, None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(len(texts)))], ["text", "n"])
    got = list(common.slices(iter([batch, batch.slice(0, 0), batch.slice(3)]), "text", 100))
    assert [x for b in got for x in b.column("n").to_pylist()] == [*range(len(texts)), *range(3, len(texts))]
    assert all(b.num_rows == 1 or sum(len((x or "").encode()) for x in b.column("text").to_pylist()) <= 100 for b in got)
    assert len(got) < 12


def test_texts_pass_one_python_worker_in_small_batches(spark, monkeypatch):
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*words, f"x{i}"])) for i in range(4)] + [(9, "another text of a few words")]
    key, seen, real = "spark.sql.execution.arrow.maxBytesPerBatch", {}, ngram_join.materialise

    def spy(df, name):
        plan = df._jdf.queryExecution().executedPlan().toString()
        seen[name] = (sum("MapInArrow" in x for x in plan.splitlines()), spark.conf.get(key))
        return real(df, name)

    monkeypatch.setattr(ngram_join, "materialise", spy)
    before = spark.conf.get(key)
    got = {r.id: r.component_id for r in ngram_join.jaccard_groups(written(spark, rows), "doc_id", "text", 3, 90, 100).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 9: 9}
    assert seen["texts"][0] == 1 and {seen[n][1] for n in ("pools", "texts", "links")} == {"4m"}
    assert spark.conf.get(key) == before


def test_line_dedup_shuffles_few_runs_in_slices_of_length_and_finds_the_pairs(spark):
    r = random.Random(41)
    lines = ["".join(r.choice("abcdefgh ") for _ in range(n)) for n in (*range(40, 200, 4), *range(300, 900, 100)) for _ in range(6)]
    lines = [" ".join(x.split()) for x in lines]
    near = {}
    for i, x in list(enumerate(lines))[::5]:
        y = x
        for _ in range(len(x) // 10):
            at = r.randrange(len(y))
            y = y[:at] + r.choice(("q", "", "q" + y[at])) + y[at + 1 :]
        near[i] = " ".join(y.split())
    texts = spark.createDataFrame([(i, x, len(x), i) for i, x in enumerate(lines)] + [(1000 + i, x, len(x), 1000 + i) for i, x in near.items()], "k long, norm string, len int, root long")
    slices = line_dedup.length_slices(texts, 0.9, 600)
    assert len(slices) > 3 and all(a < b <= c for (a, b), (c, _) in zip(slices, slices[1:]))
    want = {(i, 1000 + i) for i, y in near.items() if edit_distance(lines[i], y) <= 0.1 * max(len(lines[i]), len(y)) + 1e-9}
    got = []
    for bounds in slices:
        got += [(x.a, x.b) for x in line_dedup.sharing_runs(texts, 0.9, bounds, 1 << 16).collect()]
    assert len(want) > 20 and want <= set(got) and len(got) == len(set(got))
    assert want <= {(x.a, x.b) for x in line_dedup.sharing_runs(texts, 0.9, (1, 1000), 64).collect()}  # a crowded filter loses nothing


def test_the_filter_of_runs_holds_its_keys_and_few_others(spark):
    keys = spark.range(500).selectExpr("xxhash64(id) as key")
    mask = line_dedup.held_words(keys, 1 << 14)
    kept = spark.range(5000).crossJoin(mask).where(line_dedup.is_held(F.expr("xxhash64(id)"), 1 << 14))
    ids = {x.id for x in kept.select("id").collect()}
    assert ids >= set(range(500)) and len(ids) < 800
    assert not spark.range(9).crossJoin(line_dedup.held_words(keys.limit(0), 64)).where(line_dedup.is_held(F.expr("xxhash64(id)"), 64)).count()


def test_the_filter_of_runs_lets_one_in_a_hundred_others_pass_at_most(spark):
    mask = line_dedup.held_words(spark.range(2000).selectExpr("xxhash64(id) as key"), 1 << 15)
    others = spark.range(2000, 22000).crossJoin(mask).where(line_dedup.is_held(F.expr("xxhash64(id)"), 1 << 15))
    assert others.count() < 200
