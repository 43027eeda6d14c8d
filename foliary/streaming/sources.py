"""What is known of each source, kept as stream state: whether a file has settled, whether its content is new, and how often work on it failed.

Rows are samples of a listing and outcomes of work: source, at, kind, mtime, size, sha. Kinds: ``sample`` (a file as it was seen), ``failed`` and ``done``
(work on it ended). Every row gets one status:

* ``empty``: a sample of size 0, which waits whatever its samples say; ``settling``: it differs from the source's last sample in mtime or size;
* of settled samples ``new``, ``changed`` or ``seen``, by the sha that the source's last settled sample had (the ledger);
* ``failed`` with the number of failures in a row, and ``done``, which sets it back.

A failure asks for another attempt after a pause that doubles each time: ``retry``, or ``gave_up`` after ``attempts`` failures. Neither comes if
another outcome is there first.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

OUT = StructType([StructField("source", StringType()), StructField("us", LongType()), StructField("status", StringType()), StructField("sha", StringType()), StructField("failures", LongType())])
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Seconds before the first retry, and after how many failures in a row none follows.
PAUSE, ATTEMPTS = 60, 5


def _timed(rows: DataFrame) -> DataFrame:
    """Rows that can be placed: with a source and a time."""
    return rows.where("source is not null and at is not null").select("source", "at", "kind", "mtime", "size", "sha")


def statuses(rows: DataFrame, pause: int = PAUSE, attempts: int = ATTEMPTS) -> DataFrame:
    """source, at, status, sha, failures of all rows of a finished log, by windows; with every retry that is due before the log's last time.

    Of one source, rows go by time; ties go by kind, mtime, size and sha. Rows without a source or time are left out. A source's log is sorted in one task.
    """
    by = Window.partitionBy("source").orderBy("at", "kind", "mtime", "size", "sha")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    is_sample = F.col("kind") == "sample"
    last = F.last(F.when(is_sample, F.struct("mtime", "size")), ignorenulls=True).over(before)
    seen = _timed(rows).withColumn("settled", is_sample & (F.col("size") != 0) & F.coalesce((last["mtime"].eqNullSafe(F.col("mtime"))) & (last["size"].eqNullSafe(F.col("size"))), F.lit(False)))
    ledger = F.last(F.when(F.col("settled"), F.struct("sha")), ignorenulls=True).over(before)
    run = F.sum((F.col("kind") == "done").cast("long")).over(upto)
    told = seen.withColumns({"ledger": ledger, "run": run})
    failed = F.sum((F.col("kind") == "failed").cast("long")).over(Window.partitionBy("source", "run").orderBy("at", "kind", "mtime", "size", "sha").rowsBetween(Window.unboundedPreceding, 0))
    told = told.withColumn("failures", F.when(F.col("kind") == "failed", failed).otherwise(0).cast("long"))
    content = F.when(F.col("ledger").isNull(), "new").when(F.col("ledger.sha").eqNullSafe(F.col("sha")), "seen").otherwise("changed")
    status = F.when(~is_sample, F.col("kind")).when(F.col("size") == 0, "empty").when(F.col("settled"), content).otherwise("settling")
    nxt = F.min(F.when(~is_sample, F.col("at"))).over(by.rowsBetween(1, Window.unboundedFollowing))
    due = F.timestamp_micros(F.unix_micros("at") + (F.lit(pause) * F.pow(F.lit(2), F.col("failures") - 1) * 1_000_000).cast("long"))
    out = told.select("source", "at", status.alias("status"), "sha", "failures", "kind", nxt.alias("next"), F.when(F.col("kind") == "failed", due).alias("due"))
    end = rows.agg(F.max("at").alias("end"))
    again = out.where("kind = 'failed'").crossJoin(F.broadcast(end)).where("due < end and (next is null or next > due)")  # the log's end is one row
    again = again.select("source", F.col("due").alias("at"), F.when(F.col("failures") >= attempts, "gave_up").otherwise("retry").alias("status"), F.lit(None).cast("string").alias("sha"), "failures")
    return out.select("source", "at", "status", "sha", "failures").unionByName(again)


def _told(source: str, us: int, status: str, sha: str | None = None, failures: int = 0) -> Row:
    return Row(source=source, us=us, status=status, sha=sha, failures=failures)


class SourceMemory(StatefulProcessor):
    """The state of one source: its last sample, the ledger, failures in a row, and the time of the last row."""

    def __init__(self, pause: int = PAUSE, attempts: int = ATTEMPTS):
        self.pause, self.attempts = pause, attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sample = handle.getValueState("sample", "mtime double, size bigint")
        self.ledger = handle.getValueState("ledger", "sha string")
        self.failures = handle.getValueState("failures", "n bigint, due bigint")
        self.last = handle.getValueState("last", "us bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        nulls_first = lambda x: (x is not None, x)
        for r in sorted(rows, key=lambda r: (r.us, r.kind, nulls_first(r.mtime), nulls_first(r.size), nulls_first(r.sha))):
            if self.last.exists() and r.us < self.last.get()[0]:
                yield _told(key[0], r.us, "late", r.sha)
                continue
            self.last.update((r.us,))
            yield self._sampled(key[0], r) if r.kind == "sample" else self._ended(key[0], r)

    def _sampled(self, source: str, r: Row) -> Row:
        same = self.sample.exists() and tuple(self.sample.get()) == (r.mtime, r.size)
        self.sample.update((r.mtime, r.size))
        if r.size == 0 or not same:
            return _told(source, r.us, "empty" if r.size == 0 else "settling", r.sha)
        status = "new" if not self.ledger.exists() else "seen" if self.ledger.get()[0] == r.sha else "changed"
        self.ledger.update((r.sha,))
        return _told(source, r.us, status, r.sha)

    def _ended(self, source: str, r: Row) -> Row:
        n, due = self.failures.get() if self.failures.exists() else (0, None)
        if due is not None:
            self.handle.deleteTimer(due)
        if r.kind == "done":
            self.failures.clear()
            return _told(source, r.us, "done", r.sha)
        due = r.us // 1000 + self.pause * 2**n * 1000
        self.handle.registerTimer(due)
        self.failures.update((n + 1, due))
        return _told(source, r.us, "failed", r.sha, n + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        n, _ = self.failures.get()
        due = expiredTimerInfo.getExpiryTimeInMs()
        self.failures.update((n, None))
        yield _told(key[0], due * 1000, "gave_up" if n >= self.attempts else "retry", None, n)

    def close(self) -> None:
        pass


def watch(rows: DataFrame, lateness: str = "0 seconds", pause: int = PAUSE, attempts: int = ATTEMPTS) -> DataFrame:
    """The statuses of a stream of rows, in append mode; what is known of a source is in the state store (set its provider to ``ROCKS``).

    Rows of one source go by time within a batch; a row older than one that was told before is ``late`` and changes nothing. A retry comes with the
    batch in which the watermark passes its time.
    """
    timed = _timed(rows).withColumn("us", F.unix_micros("at")).withWatermark("at", lateness)
    told = timed.groupBy("source").transformWithState(SourceMemory(pause, attempts), OUT, "Append", "EventTime")
    return told.select("source", F.timestamp_micros("us").alias("at"), "status", "sha", "failures")


def ledger_diff(files: DataFrame, seen: DataFrame) -> DataFrame:
    """``files`` (source, sha) with ``state``: new, changed or seen by the ledger ``seen`` (source, sha, one row each)."""
    known = seen.select(F.col("source").alias("__s"), F.col("sha").alias("__sha"))
    state = F.when(F.col("__s").isNull(), "new").when(F.col("__sha").eqNullSafe(F.col("sha")), "seen").otherwise("changed")
    return files.join(known, F.col("source") == F.col("__s"), "left").withColumn("state", state).drop("__s", "__sha")


def revoked(known: DataFrame, listed: DataFrame, complete: bool, pruned: list[str] = ()) -> DataFrame:
    """Sources of ``known`` that are gone from the listing. None of an incomplete listing, and none below a folder that the listing left out."""
    if not complete:
        return known.select("source").limit(0)
    gone = known.select("source").join(listed.select("source"), "source", "left_anti")
    for folder in pruned:
        gone = gone.where(~F.col("source").startswith(folder.rstrip("/") + "/"))
    return gone
