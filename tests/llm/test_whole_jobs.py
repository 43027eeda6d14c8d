"""Whole jobs: what the operators must find where shorter paths would miss it."""

import random
import string

import pytest
from pyspark.sql import functions as F

from foliary.llm import line_dedup, ngram_join
from foliary.llm.common import shared_dir
from foliary.llm.edit_fingerprint import edit_distance


def written(spark, rows, ddl="doc_id long, text string"):
    path = shared_dir(spark, "whole")
    spark.createDataFrame(rows, ddl).write.parquet(path)
    return spark.read.parquet(path)


def words(r, n):
    return [("".join(r.choice(string.ascii_lowercase) for _ in range(r.randrange(3, 10)))) for _ in range(n)]


def similar(a, b):
    return a != b and edit_distance(a, b) <= 0.1 * max(len(a), len(b)) + 1e-9


def test_line_dedup_finds_lines_with_one_edit(spark):
    r = random.Random(21)
    rows, near = [], {}
    for n in (10, 20, 50):
        for _ in range(60):
            w = words(r, n)
            v = list(w)
            v[r.randrange(n)] = words(r, 1)[0]
            a, b = " ".join(w), " ".join(v)
            rows += [(2 * len(near), a), (2 * len(near) + 1, b)]
            near[2 * len(near) + 1] = similar(a, b)
    got = {x.doc_id: x.n_dropped for x in line_dedup.dedup_lines(written(spark, rows)).collect()}
    want = [i for i, s in near.items() if s]
    assert len(want) > 120 and sum(got[i] for i in want) >= 0.97 * len(want)
    assert all(not got[i] for i in got if i not in want)


def test_line_dedup_loses_no_pair_of_lines_with_scattered_edits(spark):
    r = random.Random(23)
    rows, near = [], {}
    for n in (5, 10, 20, 50):
        for share in (0.5, 0.8, 1):
            for _ in range(25):
                a = b = " ".join(words(r, n))
                for _ in range(int(0.1 * len(a) * share)):
                    at = r.randrange(1, len(b) - 1)
                    b = b[:at] + r.choice((r.choice(string.ascii_lowercase), r.choice(string.ascii_lowercase) + b[at], "")) + b[at + 1 :]
                rows += [(2 * len(near), a), (2 * len(near) + 1, b)]
                near[2 * len(near) + 1] = (a == b or similar(" ".join(a.split()), " ".join(b.split()))) and len(b.split()) >= 5
    got = {x.doc_id: x.n_dropped for x in line_dedup.dedup_lines(written(spark, rows)).collect()}
    assert sum(near.values()) > 200
    assert sum(near.values()) > 200
    assert {i for i, n in got.items() if n} == {i for i, s in near.items() if s}


def test_jaccard_of_very_long_near_copies(spark):
    long = [f"w{i}" for i in range(300_000)]
    near = [*long[:150_000], "changed", *long[150_001:]]
    a, b = list(range(300_000)), list(range(299_999)) + [300_001]
    links = ngram_join.trie_links([tuple(a), tuple(b), tuple(b[1:])], [0, 0, 0], 9, 10)
    assert len(links) == 2 and {i for e in links for i in e} == {0, 1, 2}
    rows = [(1, " ".join(long)), (2, " ".join(near)), (3, "another text of a few words")]
    got = {x.id: x.component_id for x in ngram_join.jaccard_groups(written(spark, rows), "doc_id", "text", 3, 90, 100).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_one_document_of_each_group_stays_whatever_its_id(spark):
    import corpus_pipeline

    r = random.Random(22)
    a, b, c = (words(r, 60) for _ in range(3))
    near = " ".join([*a[:-1], "changed"])
    rows = [(5, " ".join(a)), (None, near), (None, " ".join(b)), (None, near + " more"), (7, " ".join(c)), (7, near), (None, None), (5, " ".join(a)), (8, "")]
    left = corpus_pipeline.one_of_each_group(spark, written(spark, rows), "").collect()
    want = [(5, " ".join(a)), (None, " ".join(b)), (7, " ".join(c)), (None, None), (8, "")]
    assert sorted(map(str, left)) == sorted(f"Row(doc_id={x[0]!r}, text={x[1]!r})" for x in want)


def test_line_dedup_of_lines_without_spaces_with_marks_and_of_great_length(spark):
    r = random.Random(23)
    han, thai = ["".join(chr(lo + r.randrange(n)) for _ in range(40)) for lo, n in ((0x4E00, 2000), (0x0E01, 46))]
    hindi = "कि खि गि घि चि"
    vowels = hindi.replace("ि", "ु")
    long = words(r, 33_000)
    rows = [(1, han), (2, han), (3, han[:20] + "龘" + han[21:]), (4, thai), (5, thai), (6, hindi), (7, vowels), (8, han[:4]), (9, han[:4]), (10, hindi)]
    rows += [(11, " ".join(long)), (12, " ".join([*long[:9], "changed", *long[10:]]))]
    got = {x.doc_id: x.n_dropped for x in line_dedup.dedup_lines(written(spark, rows)).collect()}
    assert got == {i: int(i in (2, 3, 5, 10, 12)) for i in range(1, 13)}


def test_distance_is_that_of_whole_lines(spark):
    r = random.Random(24)
    pairs = []
    for n in (1, 10, 60, 200):
        for _ in range(10):
            a = words(r, n)
            b = list(a)
            for _ in range(r.randrange(4)):
                b[r.randrange(n)] = "x"
            pairs.append((" ".join(a), " ".join(b + ["more"] * r.randrange(2))))
    df = spark.createDataFrame(pairs, "x string, y string")
    got = df.select("x", "y", line_dedup.distance(F.col("x"), F.col("y"), F.lit(20), F.lit(-1)).alias("d"), line_dedup.distance(F.col("x"), F.col("y"), F.lit(40), F.lit(20)).alias("e")).collect()
    for g in got:
        want = edit_distance(g.x, g.y)
        assert g.d == (want if want <= 20 else -1)
        assert want <= g.e <= 20 or g.e == (want if want <= 40 else -1)


def test_trie_links_join_what_known_groups_leave_apart():
    r = random.Random(31)
    for _ in range(150):
        base = [r.sample(range(400), r.randrange(10, 60)) for _ in range(3)]
        sets = []
        for _ in range(r.randrange(1, 40)):
            x = dict.fromkeys(r.choice(base))
            for t in r.sample(sorted(x), r.randrange(4)):
                del x[t]
            sets.append(tuple(sorted({*x, *(r.randrange(400, 440) for _ in range(r.randrange(3)))})))
        side, known = [r.randrange(2) for _ in sets], [r.randrange(60) for _ in sets]
        meet = range(len(sets))
        both = len(set(side)) > 1
        near = [(i, j) for i in meet for j in meet if i < j and (not both or side[i] != side[j]) and len({*sets[i]} & {*sets[j]}) * 10 >= 8 * len({*sets[i]} | {*sets[j]})]
        told = [(i, j) for i in meet for j in meet if i < j and known[i] == known[j]]
        got = ngram_join.trie_links(sets, side, 8, 10, None, known)
        assert all(tuple(sorted(e)) in near for e in got)
        assert union_of(meet, told + got) == union_of(meet, told + near)
    assert ngram_join.trie_links([], [], 8, 10) == []


def union_of(ids, pairs):
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("cap", [9])
def test_groups_of_copies_that_barely_link_are_exact(spark, cap):
    r = random.Random(32)
    texts = []
    for size in (70, 40, 12):
        base = words(r, 90)
        for _ in range(size):
            w = list(base)
            for _ in range(r.randrange(5)):
                w[r.randrange(len(w))] = r.choice(["changed", "other", "third"]) + str(r.randrange(4))
            texts.append(" ".join(w))
    # a passage in texts that are otherwise different
    passage = words(r, 12)
    texts += [" ".join([*words(r, 20), *passage, *words(r, 20)]) for _ in range(30)]
    sets = [{tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for t in texts]
    meet = range(len(texts))
    near = [(i, j) for i in meet for j in meet if i < j and len(sets[i] & sets[j]) * 10 >= 9 * len(sets[i] | sets[j])]
    got = ngram_join.jaccard_groups(written(spark, list(enumerate(texts))), "doc_id", "text", 3, 90, 100, cap=cap).collect()
    assert {x.id: x.component_id for x in got} == union_of(meet, near)


def test_sifting_keeps_every_row_that_is_asked_for_and_few_others(spark):
    rows = spark.createDataFrame([(i if i % 50 else None, f"t{i}") for i in range(2000)], "n long, text string")
    wanted = spark.createDataFrame([(7,), (None,), (-5,), (1999,)], "n long")
    got = [tuple(r) for r in ngram_join.sifted(rows, "n", wanted).collect()]
    assert len(got) < 60 and {r[0] for r in got} >= {7, 1999, None} and sum(r[0] is None for r in got) == 40
    crowded = ngram_join.sifted(rows, "n", wanted, bits=64).collect()
    assert len(got) < len(crowded) < 2000 and {tuple(r) for r in crowded} >= set(got)
    assert ngram_join.sifted(rows, "n", wanted.limit(0)).count() == 0


def test_few_texts_are_shuffled_and_each_set_once(spark, monkeypatch):
    words = [f"w{i}" for i in range(400)]
    near = [" ".join([*words[:200], f"x{i}"]) for i in range(3)]
    rows = [(None, near[0])] * 30 + [(5, t) for t in near] + [(100 + i, " ".join(f"{i}-{w}" for w in words)) for i in range(50)]
    seen = {}
    real = ngram_join.materialise

    def spy(df, name):
        seen.setdefault(name, []).append(out := real(df, name))
        return out

    monkeypatch.setattr(ngram_join, "materialise", spy)
    got = ngram_join.jaccard_groups(written(spark, rows), "doc_id", "text", 3, 90, 100).collect()
    assert sum(r.component_id == 5 for r in got) == 33 and sum(r.kept for r in got) == 51
    assert seen["texts"][0].count() == 33 and seen["sources"][0].count() == 3  # the others share no bucket
    assert all(n.count() == n.select("tok", "rid").distinct().count() for n in seen["named"])
