"""State of sources as a stream, stopped and started again, against the same log folded by windows; upserts of odd first batches."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from foliary.streaming import events as ev
from foliary.streaming import sources as src

T0 = datetime(2024, 1, 1)
KIND = "source string, at timestamp, kind string, mtime double, size bigint, sha string"


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def log_of(seed, n):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        s = f"s{r.randrange(6)}"
        if r.random() < 0.3:
            rows.append((s, at(i * 20), r.choice(["failed", "failed", "done"]), None, None, None))
        else:
            rows.append((s, at(i * 20), "sample", float(r.randrange(2)), r.choice([0, 5, 5, 5, 6]), r.choice(["x", "y", None])))
    return rows


def plain(rows, pause=60, attempts=3):
    """The rule, one row after the other."""
    out, end = [], max(r[1] for r in rows)
    for s in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == s]
        sample, ledger, failures, due = None, None, 0, None
        for _, t, kind, mtime, size, sha in mine:
            if due and due < t and kind != "sample":
                out.append((s, due, "gave_up" if failures >= attempts else "retry", None, failures))
                due = None
            if kind != "sample":
                failures = failures + 1 if kind == "failed" else 0
                due = t + timedelta(seconds=pause * 2 ** (failures - 1)) if failures else None
                out.append((s, t, kind, sha, failures))
                continue
            same, sample = sample == (mtime, size), (mtime, size)
            if size == 0 or not same:
                out.append((s, t, "empty" if size == 0 else "settling", sha, 0))
            else:
                out.append((s, t, "new" if ledger is None else "seen" if ledger == (sha,) else "changed", sha, 0))
                ledger = (sha,)
        if due and due < end:
            out.append((s, due, "gave_up" if failures >= attempts else "retry", None, failures))
    return sorted(out, key=str)


def told(df):
    return sorted((tuple(r) for r in df.select("source", "at", "status", "sha", "failures").collect()), key=str)


def test_windows_follow_the_rule(spark):
    rows = log_of(1, 400)
    got = told(src.statuses(spark.createDataFrame([*rows, (None, T0, "sample", 1.0, 1, "x"), ("s1", None, "sample", 1.0, 1, "x")], KIND), attempts=3))
    assert got == plain(rows)
    assert {g[2] for g in got} >= {"empty", "settling", "new", "changed", "seen", "failed", "done", "retry", "gave_up"}
    assert told(src.statuses(spark.createDataFrame([], KIND))) == []


def test_the_stream_says_the_same_and_remembers_over_a_restart(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", src.ROCKS)
    rows = log_of(2, 120)
    parts = [rows[i : i + 24] for i in range(0, len(rows), 24)]

    def run(some):
        for i in some:
            r = parts[i][:]
            random.Random(i).shuffle(r)
            spark.createDataFrame(r, KIND).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            files = spark.readStream.schema(KIND).parquet(f"{tmp_path}/in")
            q = src.watch(files, attempts=3).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out")
            q.awaitTermination()

    run(range(3))
    run(range(3, 5))
    end = max(r[1] for r in rows)
    got, want = told(spark.read.parquet(f"{tmp_path}/out")), plain(rows)
    assert [g for g in got if g[2] not in ("retry", "gave_up")] == [w for w in want if w[2] not in ("retry", "gave_up")]
    again = [g for g in got if g[2] in ("retry", "gave_up")]
    assert again and set(again) <= set(want) and all(g[1] <= end for g in again)
    # rows of the past change nothing
    spark.createDataFrame([("s0", at(-5), "sample", 9.0, 9, "z")], KIND).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run([])
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_ledger_and_revocation(spark):
    files = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("d", None)], "source string, sha string")
    seen = spark.createDataFrame([("a", "1"), ("b", "9"), ("c", None), ("z", "1"), ("x/y", "1")], "source string, sha string")
    assert {r.source: r.state for r in src.ledger_diff(files, seen).collect()} == {"a": "seen", "b": "changed", "c": "seen", "d": "new"}
    assert {r.source for r in src.revoked(seen, files, True).collect()} == {"z", "x/y"}
    assert {r.source for r in src.revoked(seen, files, True, ["x"]).collect()} == {"z"}
    assert src.revoked(seen, files, False).count() == 0


def test_upserts_begin_with_nothing_and_keep_two_versions(spark, tmp_path):
    kind = "k string, o int, v string, deleted boolean"
    batches = [[("a", None, "no order", None)], [("a", 2, "two", None), ("b", 1, "one", None)], [("a", 1, "late", None)], [("b", 3, None, True)], [("a", 4, "four", None)], [("a", 5, "five", None)], [("c", 1, "c", None)]]
    for b in batches:
        spark.createDataFrame(b, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(kind).parquet(f"{tmp_path}/in")
        ev.upsert(stream, f"{tmp_path}/table", "k", "o", f"{tmp_path}/state", buckets=1)().awaitTermination()
    assert sorted(tuple(r) for r in ev.current(spark, f"{tmp_path}/table").select("k", "o", "v").collect()) == [("a", 5, "five"), ("c", 1, "c")]
    kept = [p for p in (tmp_path / "table").glob("__version=*/__bucket=0")]
    assert len(kept) <= 3
    assert spark.read.parquet(f"{tmp_path}/table").where(F.col("k") == "c").count() == 1
