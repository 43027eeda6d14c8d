"""Stored trigram and vector tables against scans and brute force, after upserts and deletes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliary.functions.text import chunk_id, phrase_groups
from foliary.operators import postings, search, vectors


def chunk_table(spark, rows):
    df = spark.createDataFrame(rows, "source string, chunk_index int, content string")
    return df.withColumn("chunk_id", chunk_id("source", "chunk_index", F.coalesce("content", F.lit(""))))


def texts(seed, n):
    r = random.Random(seed)
    words = ["Alpha", "alphabet", "BETA", "aaaa", "banana", "中文檢索", "中文索引系統", "x", "İx", "😀😀😀", "license", "the"]
    return ["".join(r.choice(words) + r.choice([" ", "", "-"]) for _ in range(r.randrange(1, 60))) for _ in range(n)]


QUERIES = ["banana beta", "aaa", "中文檢索 license", "an", "alphabet alpha alpha"]


def same_route(spark, index, live):
    df = chunk_table(spark, live)
    for q in QUERIES:
        want = [tuple(r) for r in search.bm25_route(df, q, 15).orderBy("rank").collect()]
        assert [tuple(r) for r in index.bm25_route(q, 15).orderBy("rank").collect()] == want, q


def test_bm25_from_postings_is_that_of_the_scan(spark):
    index = postings.TrigramIndex(spark, postings.shared_folder(spark, "t"), shards=3, slots=4).create()
    assert index.count() == 0 and index.bm25_route("alpha").count() == 0
    rows = [(f"s{i % 17}", i // 17, t) for i, t in enumerate([*texts(1, 80), "", None, "ab", "abc", "alpha"])]
    index.upsert(chunk_table(spark, rows))
    same_route(spark, index, rows)
    # sources replaced, among them one by fewer chunks, and a new one
    fresh = [(f"s{i % 3}", i // 3, t) for i, t in enumerate(texts(2, 9))] + [("new", 0, "alpha banana")]
    index.upsert(chunk_table(spark, fresh))
    live = [r for r in rows if r[0] not in ("s0", "s1", "s2")] + fresh
    assert index.count() == len(live)
    same_route(spark, index, live)
    index.upsert(chunk_table(spark, fresh))  # once more: nothing changes
    assert index.count() == len(live)
    index.delete(spark.createDataFrame([("s5",), ("s6",), ("no such",), (None,)], "source string"))
    live = [r for r in live if r[0] not in ("s5", "s6")]
    same_route(spark, index, live)
    hits = {r.chunk_id for r in index.bm25_route("alpha", 100, prefix="s1").collect()}
    assert hits and hits <= {r.chunk_id for r in chunk_table(spark, live).where("source like 's1%'").collect()}
    index.clear()
    assert index.count() == 0 and index.bm25_route("alpha").count() == 0
    index.upsert(chunk_table(spark, rows[:5]))
    assert index.count() == 5


def test_only_touched_shards_are_written(spark, tmp_path):
    index = postings.TrigramIndex(spark, f"{tmp_path}/index", shards=8, slots=2).create()
    index.upsert(chunk_table(spark, [(f"s{i}", 0, t) for i, t in enumerate(texts(3, 40))]))
    files = lambda: {str(p): p.stat().st_mtime_ns for p in (tmp_path / "index").rglob("*.parquet")}
    before = files()
    index.upsert(chunk_table(spark, [("s7", 0, "alpha")]))
    after = files()
    assert len({p.split("shard=")[1].split("/")[0] for p in set(after) - set(before)}) == 1
    plan = index.phrase_hits(["alpha"])._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "In(gram" in plan


def test_an_upsert_appends_postings_until_more_are_dead_than_live(spark, tmp_path):
    index = postings.TrigramIndex(spark, f"{tmp_path}/index", shards=1, slots=2).create()
    first = [(f"s{i}", 0, t + " alpha") for i, t in enumerate(texts(6, 40))]
    index.upsert(chunk_table(spark, first))
    files = lambda: {str(p): p.stat().st_mtime_ns for p in (tmp_path / "index").rglob("*.parquet") if "slot=" in str(p) and "slot=-1" not in str(p)}
    before = files()
    fresh = [(f"s{i}", 0, t + " beta") for i, t in enumerate(texts(7, 5))]
    index.upsert(chunk_table(spark, fresh))
    assert before.items() <= files().items() and len(files()) > len(before)
    same_route(spark, index, fresh + first[5:])
    named = lambda: index.read().where("nos is not null").select("seg", F.explode("nos").alias("no")).distinct().count()
    assert named() == 45 and index.count() == 40
    index.delete(spark.createDataFrame([(f"s{i}",) for i in range(30)], "source string"))
    assert not before.keys() & files().keys() and named() == index.count() == 10
    same_route(spark, index, first[30:])
    index.compact()
    assert len(files()) == 2 and named() == 10
    same_route(spark, index, first[30:])


def test_postings_of_a_call_that_was_cut_off_are_dead(spark, tmp_path, monkeypatch):
    index = postings.TrigramIndex(spark, f"{tmp_path}/index", shards=2, slots=2).create()
    first = [(f"s{i}", 0, t) for i, t in enumerate(texts(8, 12))]
    index.upsert(chunk_table(spark, first))

    def fail(*_):
        raise OSError("cut off")

    fresh = [(f"s{i}", 0, t) for i, t in enumerate(texts(9, 4))]
    with monkeypatch.context() as m:
        m.setattr(postings.TrigramIndex, "_rewrite", fail)
        with pytest.raises(OSError, match="cut off"):
            index.upsert(chunk_table(spark, fresh))
    same_route(spark, index, first)
    index.upsert(chunk_table(spark, fresh))
    same_route(spark, index, fresh + first[4:])


def test_tasks_of_one_shard_make_the_same_postings(spark, monkeypatch):
    monkeypatch.setattr(postings, "TASK_CHARS", 500)
    monkeypatch.setattr(postings, "SORT_CHARS", 200)
    index = postings.TrigramIndex(spark, postings.shared_folder(spark, "t"), shards=3, slots=2).create()
    rows = [(f"s{i % 7}", i // 7, t) for i, t in enumerate(texts(10, 60))]
    index.upsert(chunk_table(spark, rows))
    same_route(spark, index, rows)


def test_a_phrase_is_covered_by_few_trigrams():
    assert [o for o, _ in postings.covering("abc")] == [0]
    assert [o for o, _ in postings.covering("license")] == [0, 3, 4]
    assert [o for o, _ in postings.covering("abcdef")] == [0, 3]
    assert phrase_groups("license") == [["license"]]


def clustered(seed, n, d=16, groups=12):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((groups, d))
    return centres[r.integers(groups, size=n)] + r.standard_normal((n, d)) * 0.15


def brute(x, q, k):
    s = {key: round(float(v @ q) / (np.linalg.norm(v) * np.linalg.norm(q)), 12) if np.any(v) else 0.0 for key, v in x.items()}
    return sorted(s, key=lambda i: (-s[i], i))[:k]


def vector_table(spark, x):
    return spark.createDataFrame([(k, f"src{int(k) % 5}" if k else None, None if v is None else [float(a) for a in v]) for k, v in x.items()], "key string, source string, embedding array<double>")


def test_vector_search_is_exact_and_reads_few_cells(spark):
    x = {f"{i:04d}": v for i, v in enumerate(clustered(4, 600))}
    x["0007"] = np.zeros(16)
    store = vectors.new_store(spark, "model-a/16")
    with pytest.raises(ValueError):
        store.upsert(vector_table(spark, x))
    store.train(vector_table(spark, x), 12)
    bad = {**x, "9001": None, "9002": [float("nan")] * 16, "9003": []}
    assert store.upsert(vector_table(spark, bad)).count() == 600 == store.count()
    r = np.random.default_rng(5)
    for q in [*(x[k] + r.standard_normal(16) * 0.1 for k in ("0001", "0100", "0333")), r.standard_normal(16), -x["0001"]]:
        found = store.search(q, 10)
        assert found.complete and [g.key for g in found.rows.orderBy(F.desc("similarity"), "key").collect()] == brute(x, q, 10)
    near = store.search(x["0100"], 10)
    assert near.read < near.cells and store.search(x["0100"], 10, probes=1).rows.count() == 10
    assert not store.search(r.standard_normal(16), 10, probes=1).complete
    # replace, add and delete
    moved = {"0001": -x["0001"], "0700": x["0002"] * 2}
    store.upsert(vector_table(spark, moved), spark.createDataFrame([("src3",)], "source string"))
    x = {k: v for k, v in {**x, **moved}.items() if int(k) % 5 != 3}
    assert store.count() == len(x)
    for q in (x["0002"], moved["0001"]):
        assert [g.key for g in store.search(q, 10).rows.orderBy(F.desc("similarity"), "key").collect()] == brute(x, q, 10)
    assert store.search(x["0002"], 1000).rows.count() == len(x)
    keys = spark.createDataFrame([("0002",), ("0003",), ("0700",)], "key string")
    assert {r.key for r in store.get(keys).collect()} == {"0002", "0700"}
    got = store.attach(keys.withColumnRenamed("key", "chunk_id")).collect()
    assert {g.chunk_id for g in got} == {"0002", "0700"}
    store.delete(spark.createDataFrame([(f"src{i}",) for i in range(5)], "source string"))
    assert store.count() == 0 and store.search([1.0] * 16, 3).rows.count() == 0


def test_another_space_is_refused(spark):
    store = vectors.new_store(spark, "model-a/4")
    store.train(spark.createDataFrame([([1.0, 0.0, 0.0, 0.0],), ([0.0, 1.0, 0.0, 0.0],)], "embedding array<double>"), 2)
    other = vectors.VectorStore(spark, store.path, "model-b/4")
    for call in (other.rows, lambda: other.search([1.0] * 4, 1), lambda: other.delete(spark.createDataFrame([("s",)], "source string"))):
        with pytest.raises(vectors.SpaceMismatch):
            call()
    store.bind()


def test_limit_of_neighbours_grows_with_filters():
    assert [vectors.knn_limit(k, filtered=f) for k, f in ((5, False), (5, True), (10, True), (100, True), (100, False), (3, True))] == [60, 100, 200, 800, 100, 60]
