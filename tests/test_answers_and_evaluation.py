"""Budgets of answers against answers that are built and measured; bootstrap and percentiles against plain Python."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from foliary.operators import answers, evaluation


def measured(answer):
    return len(json.dumps({"content": [{"type": "text", "text": json.dumps(answer, ensure_ascii=False)}]}, ensure_ascii=False).encode())


def plain(items, base, budget, offset):
    def made(k, truncated, **more):
        return {**base, "chunks": items[:k], "truncated": truncated, "returned": k, "next_offset": offset + k, **more}

    whole = made(len(items), False)
    if measured(whole) <= budget:
        return (len(items), False, offset + len(items), measured(whole), "whole", None)
    for k in range(len(items) - 1, 0, -1):
        if measured(made(k, True)) <= budget:
            return (k, True, offset + k, measured(made(k, True)), "cut", None)
    empty = measured(made(0, True, budget_hint=answers.FIRST_HINT))
    if empty <= budget:
        return (0, True, offset, empty, "empty", None)
    over = {**base, "chunks": [], "next_offset": offset, "truncated": True, "returned": 0, "budget_exceeded": True, "budget_hint": answers.OVERFLOW_HINT}
    least = budget
    for _ in range(3):
        least = measured({**over, "minimum_budget_bytes": least})
    return (0, True, offset, least, "overflow", least)


@pytest.mark.parametrize("offset", [0, 95])
def test_budgets_are_those_of_measured_answers(spark, offset):
    r = random.Random(6)
    texts = {g: ["".join(r.choice(['a', '"', "\\", "é", "\n", "語", " "]) for _ in range(r.randrange(25))) for _ in range(n)] for g, n in (("a", 14), ("b", 1), ("c", 3))}
    rows = [(g, i, t) for g, ts in texts.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "g string, i int, t string").repartition(3)
    item = F.concat(F.lit('{"text": '), answers.json_string("t"), F.lit("}"))
    base = {"query": 'a "b" é', "n": 3}
    sizes = {plain([{"text": t} for t in texts["a"]], base, b, offset)[3] for b in (250, 400, 600)}
    for budget in sorted({10, 99, 150, 190, 230, 250, 400, 600, 5000, *sizes, *(s - 1 for s in sizes)}):
        got = {x.g: (x.returned, x.truncated, x.next_offset, x.bytes, x.state, x.minimum) for x in answers.within_answer(df, ["g"], [F.col("i")], item, base, budget, offset).collect()}
        assert got == {g: plain([{"text": t} for t in ts], base, budget, offset) for g, ts in texts.items()}, budget


def test_listing_and_depth(spark):
    df = spark.range(7)
    for offset, limit, want in ((0, 3, (7, 3, True)), (4, 3, (7, None, False)), (0, None, (7, None, False)), (9, 2, (7, None, False))):
        page, info = answers.listing(df, [F.col("id")], offset, limit)
        assert tuple(info.first()) == want and [x.id for x in page.collect()] == list(range(7))[offset : None if limit is None else offset + limit]
    assert [answers.fan_out_depth(5), answers.fan_out_depth(30, 40, 10), answers.fan_out_depth(5, 300), answers.fan_out_depth(5, 10, 20)] == [20, 50, 200, 30]


def test_bootstrap_draws_what_its_rule_says(spark):
    r = random.Random(7)
    deltas = [(f"q{i:03d}", round(r.uniform(-1, 1), 6)) for i in range(23)]
    got = evaluation.bootstrap_interval(spark.createDataFrame([*deltas, ("none", None), (None, 1.0)], "query string, delta double")).first()
    pick = lambda i: int(hashlib.md5(f"17:{i}".encode()).hexdigest()[:8], 16) % 23
    means = sorted(sum(deltas[pick(b * 23 + j)][1] for j in range(23)) / 23 for b in range(500))
    assert got.n == 23 and got["mean"] == pytest.approx(sum(d for _, d in deltas) / 23)
    assert (got.low, got.high) == (pytest.approx(means[12]), pytest.approx(means[487]))
    assert evaluation.bootstrap_interval(spark.createDataFrame([], "query string, delta double")).count() == 0


def test_percentiles_are_nearest_ranks(spark):
    r = random.Random(8)
    rows = [(g, r.choice([1.0, 2.5, 7.0, None, r.random()])) for g in "aab" for _ in range(40)] + [("c", None), ("d", 5.0), (None, 1.0)]
    got = {(x.g, x.fraction): x.v for x in evaluation.percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", [0.0, 0.5, 0.95, 1.0]).collect()}
    want = {}
    for g in {g for g, _ in rows}:
        vs = sorted(v for k, v in rows if k == g and v is not None)
        want |= {(g, f): vs[min(len(vs) - 1, int((len(vs) - 1) * f))] for f in (0.0, 0.5, 0.95, 1.0) if vs}
    assert got == want
