"""Revisions of documents as a log of events, from which all tables are derived.

A log has seq, source, kind, revision, sha, expected, value, blob. Kinds: ``stage`` a candidate, ``attach`` an occurrence (value) of a blob to it, ``commit`` or
``discard`` it, set the ``visibility`` of a source to a value, ``invalidate`` or ``delete`` it. Nothing is updated in place: a rejected event stays in the
log with its verdict, and documents, kept revisions and media are queries on the verdicts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

VISIBILITIES = ("active", "exempt", "deleted", "unverified")
_OUT = "seq bigint, source string, kind string, revision string, value string, blob string, verdict string, number bigint, active string, visibility string, removed array<string>"


class _Source:
    """One source while its events are read in order: its candidate with occurrences, what is visible, and the number of changes."""

    def __init__(self) -> None:
        self.known, self.visibility, self.active, self.number = False, None, None, 0
        self.staged = self.sha = None
        self.committed: list[str] = []  # at most two
        self.occurrences: set[str] = set()

    def _stage(self, revision: str | None, sha: str | None, **_) -> tuple[str, list[str]]:
        if not revision or not sha:
            return "incomplete", []
        if revision == self.staged or revision in self.committed:
            return "repeated", []
        gone = [self.staged] if self.staged else []
        self.staged, self.sha, self.occurrences = revision, sha, set()
        self.visibility = self.visibility or "unverified"
        self.known = True
        return "accepted", gone

    def _attach(self, revision: str | None, value: str | None, has_blob: bool, **_) -> tuple[str, list[str]]:
        if not revision or revision != self.staged:
            return "not staged", []
        if not has_blob:
            return "no blob", []
        if value is None or value in self.occurrences:
            return "repeated", []
        self.occurrences.add(value)
        return "accepted", []

    def _commit(self, revision: str | None, sha: str | None, expected: int | None, **_) -> tuple[str, list[str]]:
        if not revision or revision != self.staged:
            return "not staged", []
        if expected is not None and expected != self.number:
            return "sequence moved", []
        if sha is not None and sha != self.sha:
            return "other content", []
        if self.visibility == "deleted" and expected is None:
            return "deleted", []
        gone = [r for r in self.committed if r != self.active]
        self.committed = [r for r in self.committed if r == self.active] + [revision]
        if self.visibility != "exempt":
            self.active, self.visibility = revision, "active"
        self.staged = None
        self.number += 1
        return "accepted", gone

    def _discard(self, revision: str | None, **_) -> tuple[str, list[str]]:
        if not revision or revision != self.staged:
            return "not staged", []
        self.staged = None
        return "accepted", [revision]

    def _visibility(self, value: str | None, **_) -> tuple[str, list[str]]:
        if not self.known or value not in VISIBILITIES:
            return "unknown", []
        self.visibility = value
        return "accepted", []

    def _invalidate(self, **_) -> tuple[str, list[str]]:
        return self._visibility("unverified")

    def _delete(self, **_) -> tuple[str, list[str]]:
        if not self.known or self.visibility == "deleted":
            return "unknown", []
        self.visibility, self.active = "deleted", None
        self.number += 1
        return "accepted", []

    def take(self, kind: str, **event) -> tuple[str, list[str]]:
        act = {"stage": self._stage, "attach": self._attach, "commit": self._commit, "discard": self._discard, "visibility": self._visibility, "invalidate": self._invalidate, "delete": self._delete}.get(kind)
        return act(**event) if act else ("unknown", [])


def verdicts(log: DataFrame, blobs: DataFrame | None = None) -> DataFrame:
    """The log with verdict, and what the source is afterwards: number of changes, active revision, visibility; ``removed`` are revisions that go.

    * A candidate replaces an older one of its source; it needs a revision and a sha, and no revision that the source still has.
    * An occurrence is attached to the present candidate alone, once, and only if its blob was put (``blobs``: blob, seq) before.
    * A commit must name the candidate. ``expected``, if given, must be the number of changes so far, and ``sha`` the candidate's. A deleted source takes
      only commits that give ``expected``. The committed revision becomes active, but for an exempt source. The revision that was active stays, other committed ones go.
    * Deleting counts as a change, and is a marker: facts stay. Visibility and invalidation need a known source.

    Events without a seq or source are left out; ties of seq go by kind, revision and value. One task reads the events of a source in order, and holds of it
    what the candidate has attached.
    """
    rows = log.where("seq is not null and source is not null").select("seq", "source", "kind", "revision", "sha", F.col("expected").cast("long").alias("expected"), "value", "blob")
    put = blobs.where("blob is not null").groupBy("blob").agg(F.min("seq").alias("put")) if blobs is not None else rows.sparkSession.createDataFrame([], "blob string, put bigint")
    rows = rows.join(put, "blob", "left").withColumn("has_blob", F.coalesce(F.col("put") < F.col("seq"), F.lit(False))).drop("put")
    names = [c.split()[0] for c in _OUT.split(", ")]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, _Source()
        for b in batches:
            told = []
            for e in b.to_pylist():
                if e["source"] != now:
                    now, state = e["source"], _Source()
                kind = e.pop("kind")
                verdict, gone = state.take(kind, **{k: e[k] for k in ("revision", "sha", "expected", "value", "has_blob")})
                told.append((verdict, state.number, state.active, state.visibility, gone))
            cols = list(zip(*told, strict=True)) or [()] * 5
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names[:6]), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    return rows.repartition("source").sortWithinPartitions("source", "seq", "kind", "revision", "value").mapInArrow(fold, _OUT)


def documents(told: DataFrame) -> DataFrame:
    """source, active, visibility, number of every known source, from the last of its verdicts."""
    last = told.groupBy("source").agg(F.max_by(F.struct("active", "visibility", "number"), F.struct("seq", "kind", "revision", "value")).alias("r"))
    return last.select("source", "r.*").where("visibility is not null")


def kept_revisions(told: DataFrame) -> DataFrame:
    """source, revision, state (staged or committed), seq of its last step: revisions that nothing replaced, discarded or superseded."""
    gone = told.select("source", F.explode("removed").alias("revision"))
    steps = told.where("verdict = 'accepted' and kind in ('stage', 'commit')")
    state = steps.groupBy("source", "revision").agg(F.max("seq").alias("seq"), F.max_by("kind", "seq").alias("kind"))
    state = state.select("source", "revision", F.when(F.col("kind") == "commit", "committed").otherwise("staged").alias("state"), "seq")
    return state.join(gone, ["source", "revision"], "left_anti")


def active_revisions(told: DataFrame) -> DataFrame:
    """Kept revisions with their documents: source, revision, seq, visibility, number of those that are active and to be seen."""
    seen = documents(told).where("visibility = 'active'").select("source", F.col("active").alias("revision"), "visibility", "number")
    return kept_revisions(told).where("state = 'committed'").join(seen, ["source", "revision"]).drop("state")


def occurrences(told: DataFrame, blobs: DataFrame) -> DataFrame:
    """source, revision, occurrence and the blob's columns, of kept revisions."""
    there = told.where("verdict = 'accepted' and kind = 'attach'").select("source", "revision", F.col("value").alias("occurrence"), "blob")
    return there.join(kept_revisions(told).select("source", "revision"), ["source", "revision"], "left_semi").join(blobs.drop("seq"), "blob")


def put_blobs(known: DataFrame, new: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows to add, conflicts) of blobs by content: blob (sha256), mime, size, data. Content that is known is not added again.

    A conflict is a content that is known, or comes more than once, under another media type. Raises if what is added does not fit into ``limit`` bytes with what
    is known. Null data are left out.
    """
    named = new.where("data is not null").select(F.sha2("data", 256).alias("blob"), "mime", F.octet_length("data").cast("long").alias("size"), "data")
    one = named.groupBy("blob").agg(F.min("mime").alias("mime"), F.first("size").alias("size"), F.first("data").alias("data"), F.collect_set("mime").alias("mimes"))
    met = one.join(known.select("blob", F.col("mime").alias("old")), "blob", "left")
    add = met.where("old is null").select("blob", "mime", "size", "data")
    conflicts = met.where((F.size("mimes") > 1) | (F.col("old").isNotNull() & (F.col("old") != F.col("mime")))).select("blob", "mimes", "old")
    if limit is not None:
        used = known.select("size").unionByName(add.select("size")).agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
        if used > limit:
            raise ValueError(f"{used} bytes of blobs exceed {limit}")
    return add, conflicts


def newest_by_key(rows: DataFrame, key: Sequence[str], seq: str = "seq") -> DataFrame:
    """Variants and the like: the last row put under each key."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(seq)))
    return rows.withColumn("__n", n).where("__n = 1").drop("__n")


def live_links(log: DataFrame) -> DataFrame:
    """Links (profile, source, generation, chunk, occurrence) of the newest generation of each profile and source. A generation replaces all of the one
    before; a row without a chunk stands for an empty one.
    """
    newest = log.groupBy("profile", "source").agg(F.max("generation").alias("generation"))
    return log.join(newest, ["profile", "source", "generation"], "left_semi").where("chunk is not null").dropDuplicates()


def derived_status(marks: DataFrame, told: DataFrame) -> DataFrame:
    """profile, status, captured: the last mark (profile, seq, captured, status) of each derived layer; ``ready`` is ``stale`` if any source changed after
    the seq that the build had captured.
    """
    changed = told.where("verdict = 'accepted' and kind in ('commit', 'delete')").agg(F.max("seq").alias("__moved"))
    last = newest_by_key(marks, ["profile"]).crossJoin(F.broadcast(changed))  # one row
    stale = (F.col("status") == "ready") & F.coalesce(F.col("__moved") > F.col("captured"), F.lit(False))
    return last.select("profile", F.when(stale, "stale").otherwise(F.col("status")).alias("status"), "captured")
