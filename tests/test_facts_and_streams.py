"""Folds of logs and streams against loops over the same rows."""

import random

from pyspark.sql import functions as F

from foliary.operators import facts
from foliary.streaming import events


def test_cas_fold_of_random_logs(spark):
    r = random.Random(31)
    log = [(r.choice([1, 2, 3, None]), s, r.randrange(6)) for s in range(400)] + [(9, 1, 1), (9, 2, 0), (9, 3, 1), (9, None, 2), (9, 4, None)]
    want, count = set(), {}
    for k, s, e in sorted((x for x in log if x[1] is not None and x[2] is not None), key=lambda x: x[1]):
        if e == count.get(k, 0):
            want.add((k, e, s))
            count[k] = e + 1
    df = spark.createDataFrame(log, "k long, at long, expects int").repartition(3)
    got = {tuple(x) for x in facts.cas_fold(df, "k", "at", "expects").collect()}
    assert got == want and {(9, 0, 2), (9, 1, 3)} <= got
    assert facts.cas_fold(df.limit(0), "k", "at", "expects").count() == 0


def stream_of(spark, tmp_path, batches, ddl):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{i}")
    return spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in0").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in*")


def test_upsert_keeps_the_newest_change_of_any_batch(spark, tmp_path):
    batches = [
        [(1, 9, "new", False), (2, 1, "a", False), (3, 5, "gone", True), (4, 1, "x", False)],
        [(1, 1, "late", False), (2, 3, "b", False), (3, 4, "revived", False)],
        [(4, 2, None, True), (5, None, "no order", False), (6, 1, "six", None)],
    ]
    ddl = "id long, at long, text string, deleted boolean"
    changes = stream_of(spark, tmp_path, batches, ddl)
    run = events.upsert(changes, f"{tmp_path}/out", "id", "at", f"{tmp_path}/ck")
    run().awaitTermination()
    want = {}
    for i, at, text, gone in (x for b in batches for x in b if x[1] is not None):
        if i not in want or at > want[i][0]:
            want[i] = (at, text, bool(gone))
    got = {x.id: x.text for x in events.current(spark, f"{tmp_path}/out").collect()}
    assert got == {i: t for i, (_, t, gone) in want.items() if not gone} == {1: "new", 2: "b", 6: "six"}
    run().awaitTermination()  # nothing new
    assert {x.id: x.text for x in events.current(spark, f"{tmp_path}/out").collect()} == got


def test_windows_of_a_stream_leave_out_rows_behind_the_watermark(spark, tmp_path):
    # late rows are told by the watermark of the batch before last
    hours = [[(10, "a", 1.0), (10, "a", 2.0)], [(13, "a", 4.0)], [(13, "c", 32.0)], [(10, "a", 8.0), (14, "b", 16.0)], [(20, "a", 0.0)]]
    rows = [[(f"2024-01-01 {h}:00:00", t, v) for h, t, v in b] for b in hours]
    raw = stream_of(spark, tmp_path, rows, "ts string, event_type string, value double")
    out = events.tumbling(raw.withColumn("ts", F.to_timestamp("ts")))
    q = out.writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(x.event_type, x.n, x.total) for x in spark.table("windows").collect()}
    assert {("a", 2, 3.0), ("a", 1, 4.0), ("b", 1, 16.0)} <= got and ("a", 3, 11.0) not in got


def test_next_at_most_against_a_loop(spark):
    r = random.Random(5)
    rows = [(k, at, r.randrange(4)) for k in ("a", "b", None) for at in sorted(r.sample(range(60), 25))] + [("a", 7, 2), ("c", 1, 0), ("c", 2, None)]
    df = spark.createDataFrame(rows, "k string, at int, level int")
    got = sorted(map(repr, (tuple(x) for x in facts.next_at_most(df, "k", "at", "level").collect())))
    later = lambda k, at, n: min((b for q, b, m in rows if q == k and b > at and n is not None and m is not None and m <= n), default=None)
    assert got == sorted(map(repr, ((k, at, n, later(k, at, n)) for k, at, n in rows)))
    assert facts.next_at_most(df.limit(0), "k", "at", "level").count() == 0
