"""Versioned facts, set differences, intervals and metrics as DataFrame operations."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row of each key of an append-only log."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return log.withColumn("__n", n).where("__n = 1").drop("__n")


def prune(log: DataFrame, key: Sequence[str], order: Sequence[Column], keep: int = 2) -> DataFrame:
    """Rows beyond the newest ``keep`` of each key: what a clean-up would delete."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return log.withColumn("age", n).where(F.col("age") > keep)


def cas_fold(log: DataFrame, key: str, seq: str, expected: str) -> DataFrame:
    """Accepted commits (key, version, seq) of a log in the order of ``seq``: those whose expected version is the number of commits accepted before.

    A commit that comes too early or too late is rejected; a later one that expects the same version may still be accepted. Ties of ``seq`` go by the
    expected version. Each key's log is read in order by one task, which holds a counter and no rows. Null keys are a key of their own; a commit
    without a sequence or an expected version is rejected.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, count = object(), 0
        for b in batches:
            taken, versions = [], []
            for i, (k, e) in enumerate(zip(b.column("k").to_pylist(), b.column("e").to_pylist(), strict=True)):
                if k != now:
                    now, count = k, 0
                if e == count:
                    taken.append(i)
                    versions.append(count)
                    count += 1
            some = b.take(pa.array(taken, pa.int64()))
            yield pa.RecordBatch.from_arrays([some.column("k"), pa.array(versions, pa.int64()), some.column("s")], [key, "version", seq])

    rows = log.select(F.col(key).alias("k"), F.col(seq).alias("s"), F.col(expected).cast("long").alias("e")).where("s is not null and e is not null")
    kinds = dict(log.dtypes)
    return rows.repartition("k").sortWithinPartitions("k", "s", "e").mapInArrow(fold, f"`{key}` {kinds[key]}, version bigint, `{seq}` {kinds[seq]}")


def unreferenced(facts: DataFrame, key: str, *users: tuple[DataFrame, str]) -> DataFrame:
    """Facts that no user table refers to: an anti-join for each."""
    for df, k in users:
        facts = facts.join(df.select(F.col(k).alias("__k")), F.col(key) == F.col("__k"), "left_anti")
    return facts


def visible(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks whose document is unknown, or active with the chunk's revision. ``documents``: source, visibility, active_revision."""
    d = documents.select(F.col("source").alias("__s"), "visibility", "active_revision")
    ok = F.col("__s").isNull() | ((F.col("visibility") == "active") & (F.col("revision").isNull() | (F.col("revision") == F.col("active_revision"))))
    return chunks.join(d, F.col("source") == F.col("__s"), "left").where(ok).drop("__s", "visibility", "active_revision")


def overlaps(a: DataFrame, b: DataFrame, key: str, span: int) -> DataFrame:
    """Pairs of half-open intervals [start, end) of a and b with equal ``key`` that overlap: a_id, b_id.

    Each interval is listed in the bins of ``span`` it touches, so the join is by equality even where one key is hot;
    a pair is kept in the bin where the later of both starts.
    """
    bins = lambda d: F.explode(F.sequence(F.floor(d["start"] / span), F.floor((F.greatest(d["end"], d["start"] + 1) - 1) / span)))
    x = a.select(F.col("id").alias("a_id"), F.col(key).alias("ka"), F.col("start").alias("sa"), F.col("end").alias("ea"), bins(a).alias("bin"))
    y = b.select(F.col("id").alias("b_id"), F.col(key).alias("kb"), F.col("start").alias("sb"), F.col("end").alias("eb"), bins(b).alias("bin_b"))
    on = (F.col("ka") == F.col("kb")) & (F.col("bin") == F.col("bin_b")) & (F.col("sa") < F.col("eb")) & (F.col("sb") < F.col("ea"))
    return x.join(y, on).where(F.floor(F.greatest("sa", "sb") / span) == F.col("bin")).select("a_id", "b_id")


def islands(rows: DataFrame, key: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """Merged ranges of each key; ranges that touch are one."""
    line = Window.partitionBy(*key).orderBy(start, end)
    before = F.max(end).over(line.rowsBetween(Window.unboundedPreceding, -1))
    new = rows.withColumn("__new", F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0))
    part = new.withColumn("__part", F.sum("__new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return part.groupBy(*key, "__part").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("__part")


def next_at_most(rows: DataFrame, key: str, at: str, level: str, levels: Sequence[int] = range(7)) -> DataFrame:
    """Adds next_at: the next place of the key whose level is no higher; null at the end. Places are integers, levels one of ``levels``.

    Running minima from the end, one for each level, in one pass of a sorted window: no row meets all later ones.
    """
    later = Window.partitionBy(key).orderBy(F.desc(at)).rangeBetween(Window.unboundedPreceding, -1)
    seen = [F.min(F.when(F.col(level) == n, F.col(at))).over(later).alias(f"__l{n}") for n in levels]
    nearest = F.least(*[F.when(F.col(level) >= n, F.col(f"__l{n}")) for n in levels], F.lit(None))
    return rows.select("*", *seen).withColumn("next_at", nearest).drop(*[f"__l{n}" for n in levels])


def ignored(paths: DataFrame, rules: Sequence[tuple[str, bool]], path: str = "path") -> DataFrame:
    """Paths with ``is_ignored``: the last rule that matches decides (regular expression, ignore or not); none: not ignored.

    Rules are a short configured list, so they are one expression, not a join.
    """
    out = F.lit(False)
    for pattern, verdict in rules:
        out = F.when(F.col(path).rlike(pattern), F.lit(verdict)).otherwise(out)
    return paths.withColumn("is_ignored", out)


def reuse_vectors(missing: DataFrame, donors: DataFrame, key: str) -> DataFrame:
    """``missing`` with the donor_id of the first donor (smallest id) that has the same key; null where none has."""
    first = donors.groupBy(F.col(key).alias("__k")).agg(F.min("id").alias("donor_id"))
    return missing.join(first, F.col(key) == F.col("__k"), "left").drop("__k")


def ranking_metrics(ranked: DataFrame, k: int) -> DataFrame:
    """Per query of ``ranked`` (query, rank from 1, relevance): hit, reciprocal rank, recall and nDCG at k, 9 digits."""
    gain = F.pow(F.lit(2.0), F.col("relevance")) - 1
    ideal = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("relevance"), "rank"))
    near = F.col("rank") <= k
    rows = ranked.withColumn("best", ideal)
    disc = lambda c: F.log2(F.col(c) + 1.0)
    agg = rows.groupBy("query").agg(
        F.max((near & (F.col("relevance") > 0)).cast("int")).alias("hit"),
        F.min(F.when(F.col("relevance") > 0, F.col("rank"))).alias("first"),
        F.sum((near & (F.col("relevance") > 0)).cast("int")).alias("found"),
        F.sum((F.col("relevance") > 0).cast("int")).alias("relevant"),
        F.sum(F.when(near, F.round(gain / disc("rank"), 12).cast("decimal(30,12)"))).alias("dcg"),
        F.sum(F.when(F.col("best") <= k, F.round(gain / disc("best"), 12).cast("decimal(30,12)"))).alias("idcg"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a).cast("double") / F.col(b).cast("double"), 9)).otherwise(0.0)
    return agg.select("query", "hit", F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 9).alias("rr"), share("found", "relevant").alias("recall"), share("dcg", "idcg").alias("ndcg"))


def estimate_error(rows: DataFrame, by: str, estimate: str, actual: str) -> DataFrame:
    """Per ``by``: n, mean and largest |estimate - actual| / max(1, actual), as decimals of 9 digits, so that the sum has one order-free value."""
    error = F.abs(F.col(estimate) - F.col(actual)) / F.greatest(F.col(actual), F.lit(1))
    exact = F.round(error, 9).cast("decimal(20,9)")
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.round(F.sum(exact).cast("double") / F.count("*"), 6).alias("mean_error"), F.max(exact).cast("double").alias("max_error"))
