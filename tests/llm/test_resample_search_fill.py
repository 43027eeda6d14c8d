"""Fill-in-the-middle, importance resampling and collision search against plain Python, through the registered queries."""

import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from foliary.llm import collision_search, fill_middle, importance
from foliary.llm.queries import queries

MARKS = ("<P>", "<S>", "<M>")
ODD = ["", None, " ", "ä", "x<S>y", "<P>", "日本語" * 50, "😀" * 7, "é" * 9, "a" * 100 + "é" * 100 + "a" * 300 + "語" * 400, "<<S" * 5, "no end <", "y" * 3000, "Ünïcode " * 200]


def save(folder, name, **columns):
    pq.write_table(pa.table(columns), f"{folder}/{name}.parquet")


def texts_of(seed, n):
    r = random.Random(seed)
    words = ["alpha", "Beta", "x1", "straße", "語", "it's", "-", "a.b", "<", "😀", "Q" * 70, "z" * 200]
    return [*ODD, *("".join(r.choice(words) + r.choice([" ", "\n", "", ",  "]) for _ in range(r.randrange(60))) for _ in range(n))]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_fill_in_middle_is_that_of_code_points(spark, tmp_path):
    texts = texts_of(1, 300)
    save(tmp_path, "documents", doc_id=pa.array(range(len(texts))), text=pa.array(texts, pa.string()))
    got = {r.doc_id: r for r in queries()["op11_fill_in_middle"](spark, str(tmp_path)).collect()}
    forms = set()
    for i, t in enumerate(texts):
        t = t or ""
        n, hexes = len(t), sha(f"1:{i}")
        h = [int(hexes[8 * k : 8 * k + 8], 16) for k in range(4)]
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        if not t or any(m in t for m in MARKS) or h[2] % 100 >= 90:
            want = ("plain", None, None, t)
        elif h[3] % 100 < 20:
            want = ("spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}")
        else:
            want = ("psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}")
        forms.add(want[0])
        r = got[i]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, *want[:3], sha(want[3]), sha(t))
    assert forms == {"plain", "spm", "psm"} and len(got) == len(texts)


@pytest.mark.parametrize("piece", [7, 64, 1 << 20])
def test_rank_index_is_exact_and_its_segments_keep_their_bound(piece):
    r = random.Random(2)
    texts = ["".join(r.choice(["a", "é", "語", "😀"]) * r.randrange(1, 200) for _ in range(r.randrange(12))) for _ in range(40)]
    data = "".join(texts).encode()
    offs = np.cumsum([0, *(len(t.encode()) for t in texts)])
    index = fill_middle.RankIndex(np.frombuffer(data, np.uint8), offs, piece=piece)
    want = [len(data[:o].decode()) for o in offs.tolist()]
    assert index.ranks.tolist() == want
    whole = "".join(texts)
    every = np.cumsum([0, *(len(c.encode()) for c in whole)])
    assert index.offset(np.arange(len(whole) + 1)).tolist() == every.tolist()
    assert np.abs(index.rests.astype(int)).max() <= fill_middle.ERROR + 1
    starts, slopes = fill_middle.fit_segments(every)
    for s, z, k in zip(starts, [*starts[1:], len(every)], slopes, strict=True):
        assert np.abs(every[s] + k * np.arange(z - s) - every[s:z]).max() <= fill_middle.ERROR + 1e-6
    assert len(starts) < len(every) / 20


def test_fill_in_middle_of_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, n long, form string")
    assert fill_middle.fill_in_middle(empty, "doc_id", "text").count() == 0
    rows = spark.createDataFrame([(None, "some text", 5), (None, "some text", 6), (3, None, 7)], "doc_id long, text string, output int")
    got = fill_middle.digest(fill_middle.fill_in_middle(rows, "doc_id", "text", plain=0)).collect()
    assert sorted(r.restored_sha256 for r in got) == sorted([sha("some text"), sha("some text"), sha("")])
    long = spark.createDataFrame([(i, "ab語" * 1_000_000) for i in range(2)], "doc_id long, text string")
    assert {r.restored_sha256 for r in fill_middle.digest(fill_middle.fill_in_middle(long, "doc_id", "text")).collect()} == {sha("ab語" * 1_000_000)}


def features(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    ws = "".join(c if ord(c) > 127 or c in "0123456789abcdefghijklmnopqrstuvwxyz" else " " for c in low).split(" ")
    ws = [w for w in ws if w]
    return ws, ws + [f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False)]


def expected(docs, target):
    counts = []
    for some in (docs, target):
        c = [0] * 10000
        for t in some:
            for f in features(t)[1]:
                c[zlib.crc32(f.encode()) % 10000] += 1
        counts.append(c)
    s_all, t_all = map(sum, counts)
    gain = [math.floor(1000 * math.log((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000)))) for s, t in zip(*counts, strict=True)]
    out, able = {}, []
    for i, d in enumerate(docs):
        ws, fs = features(d)
        weight = sum(gain[zlib.crc32(f.encode()) % 10000] for f in fs) // len(fs) if fs else 0
        h = int(sha(f"7:{i}")[:8], 16)
        out[i] = [len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
        if len(ws) >= 20:
            able.append(i)
    for rank, i in enumerate(sorted(able, key=lambda i: (-out[i][2], i))[: 25 * len(able) // 100], 1):
        out[i][3] = rank
    return {i: tuple(x) for i, x in out.items()}


def test_resampling_is_that_of_crc32_and_plain_counts(spark, tmp_path):
    docs, target = texts_of(3, 400), ["alpha Beta x1", "straße 語 alpha", None, ""]
    save(tmp_path, "documents", doc_id=pa.array(range(len(docs))), text=pa.array(docs, pa.string()))
    save(tmp_path, "benchmark", item_id=pa.array(range(4)), text=pa.array(target, pa.string()))
    got = {r.doc_id: (r.n_features, r.weight, r.score, r.rank) for r in queries()["op12_importance_resampling"](spark, str(tmp_path)).collect()}
    want = expected(docs, target)
    assert got == want and sum(x[3] is not None for x in want.values()) > 20


def test_checksums_of_spans_of_any_length():
    r = random.Random(4)
    for reach in (1, 3, 64):
        sums = importance.Checksums(reach)
        parts = [bytes(r.randrange(256) for _ in range(n)) for n in (1, 2, 63, 64, 65, 127, 128, 129, 1000, 4097, 5)]
        data = b" ".join(parts) + b" "
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        starts = ends - [len(p) for p in parts]
        assert sums.of(np.frombuffer(data, np.uint8), starts, ends).tolist() == [zlib.crc32(p) for p in parts]


def test_resampling_of_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, rank int")
    some = spark.createDataFrame([(1, "a b " * 30, 1), (1, "a b " * 30, 2), (None, "c " * 40, 3), (None, None, 4)] + [(i, "word " * 25, 0) for i in range(2, 14)], "doc_id long, text string, rank int")
    assert importance.resample(empty, empty).count() == 0
    got = importance.resample(some, empty).collect()
    assert len(got) == 16 and sorted(r.rank for r in got if r["rank"]) == [1, 2, 3]
    assert importance.resample(empty, some).count() == 0
    long = spark.createDataFrame([(1, "x" * 3_000_000), (2, "é y " * 700_000)], "doc_id long, text string")
    assert {r.id: r.n_features for r in importance.resample(long, long).collect()} == {1: 1, 2: 2 * 1_400_000 - 1}


def test_search_finds_what_brute_force_finds(spark, tmp_path):
    r = np.random.default_rng(5)
    x = r.standard_normal((3000, 24)) * np.exp(r.standard_normal((3000, 1)) / 2)
    x[100:400] = x[100]  # a tenth of the rows are one vector
    x[500:540] = x[20] * 1.01 + r.standard_normal((40, 24)) * 0.01
    rows = [v.tolist() for v in x]
    rows[7], rows[40], rows[60], rows[61], rows[80] = None, [0.0] * 24, [None] * 24, [math.nan] * 24, [1.0, 2.0]
    save(tmp_path, "embeddings", vec_id=pa.array(range(3000)), embedding=pa.array(rows, pa.list_(pa.float64())))
    got = {}
    for g in queries()["op13_collision_search"](spark, str(tmp_path)).orderBy("query_id", "rank").collect():
        got.setdefault(g.query_id, []).append((g["rank"], g.vec_id, g.score))
    out = [7, 40, 60, 61, 80]
    asked = [i for i in range(0, 3000, 20) if i not in out]
    assert sorted(got) == asked
    found = 0
    for i in asked:
        s = {j: float((x[j] * x[i]).sum()) for j in range(3000) if j != i and j not in out}
        want = sorted(s, key=lambda j: (-s[j], j))[:20]
        assert [g[0] for g in got[i]] == list(range(1, 21))
        assert [g[1] for g in got[i]] == sorted((g[1] for g in got[i]), key=lambda j: (-s[j], j))
        assert all(g[2] == s[g[1]] for g in got[i])
        found += len({g[1] for g in got[i]} & set(want))
    assert found >= 0.95 * 20 * len(asked)


def test_search_in_many_small_shards_and_blocks(spark):
    r = np.random.default_rng(6)
    x = r.standard_normal((400, 8))
    df = spark.createDataFrame([(i, v.tolist(), "other") for i, v in enumerate(x)], "id long, v array<double>, key string")
    got = collision_search.nearest(df, "id", "v", k=5, every=4, shard=16, stream=50, block=9).groupBy("query_id").agg(F.collect_set("vec_id").alias("s")).collect()
    want = {i: set(sorted((j for j in range(400) if j != i), key=lambda j: (-(x[j] @ x[i]), j))[:5]) for i in range(0, 400, 4)}
    assert len(got) == 100 and sum(len(set(g.s) & want[g.query_id]) for g in got) >= 475


def test_search_of_odd_tables(spark):
    kind = "id long, v array<double>"
    empty = spark.createDataFrame([], kind)
    assert collision_search.nearest(empty, "id", "v").count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 2.0]), (3, [1.0, 1.0]), (None, [5.0, 5.0]), (20, [1.0, 0.0])], kind)
    got = collision_search.nearest(few, "id", "v").collect()
    by = {}
    for g in got:
        by.setdefault(g.query_id, []).append((g["rank"], g.vec_id, g.score))
    assert sorted(by[20]) == [(1, 0, 1.0), (2, 0, 1.0), (3, 3, 1.0), (4, 0, 0.0)]
    assert len(by[0]) == 12  # three rows with that id, four others each
    lone = spark.createDataFrame([(20, [1.0])], kind)
    assert collision_search.nearest(lone, "id", "v").count() == 0
    assert math.isclose(collision_search.collide(1.0, 1.0), 0.6826894921370859)
