"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Every document has a fixed pseudo-random place in its source's permutation; the top bits of that place are its bucket.
   Sizes per (source, bucket), and their prefix sums, place every document on its source's line of words without
   ever sorting a source in one task.
2. Targets share all words by weight, up to ``cap`` times a source; what exceeds a cap is shared again.
3. A source's line, repeated until its target, is cut into blocks of equal words: its exact block quota.
4. The quotas go down a binary tree over the output shards; each node splits its blocks of all sources by one multivariate
   hypergeometric draw, so shards get random, exactly exhausting mixtures. The blocks of a source, permuted, are
   dealt to its shards in order, so no two shards share a block.
5. Documents of a shard are shuffled by another fixed pseudo-random number.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, free_name, materialise

#: Buckets per source. Each holds about n / BUCKETS documents of a source of n.
BUCKETS = 1024


def water_fill(sizes: np.ndarray, weights: np.ndarray, total: float, cap: float) -> np.ndarray:
    """Targets in proportion to weights, none above cap * size, the excess shared again until none is above."""
    limit, out, free = cap * sizes, np.zeros(len(sizes)), sizes > 0
    rest = total
    while free.any() and rest > 0:
        share = np.where(free, rest * weights / weights[free].sum(), 0.0)
        over = free & (share > limit)
        if not over.any():
            out[free] = share[free]
            break
        out[over] = limit[over]
        rest -= limit[over].sum()
        free &= ~over
    return out


def split_tree(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """(shards, sources) block counts: columns sum to the quotas, rows differ by at most one block in total."""
    out = np.zeros((shards, len(quotas)), np.int64)
    total = int(quotas.sum())
    caps = np.full(shards, total // shards)
    caps[: total % shards] += 1
    stack = [(0, shards, quotas.astype(np.int64))]
    while stack:
        lo, hi, have = stack.pop()
        if hi - lo == 1:
            out[lo] = have
            continue
        mid = (lo + hi) // 2
        left = rng.multivariate_hypergeometric(have, int(caps[lo:mid].sum()), method="marginals") if have.any() else have
        stack += [(lo, mid, left), (mid, hi, have - left)]
    return out


def allocate(docs: DataFrame, source_col: str, key_cols: Sequence[str], size: Column, weights: Sequence[float] = (5, 2, 1), cap: int = 3, shards: int = 64, block: int = 50_000, seed: int = 11) -> DataFrame:
    """Adds to every row size, source_size, target (words of its source), taken (words) and shard_copies.

    ``weights`` repeat over the sources by code point, null last. shard_copies lists the shard of each copy taken: a row is taken
    0 to ``cap`` times, whole, where its copy begins in a block that the tree has dealt to a shard and the larger half of the row is before the
    target, so a source's taken words differ from its target by at most half of one row. Rows of size 0 are not taken.
    ``key_cols`` fix the pseudo-random order; rows equal in them are interchangeable. Reruns give equal results. Blocks
    have ``block`` words. Other columns may have any names; those named like a new one are replaced. An empty table gives an empty result.
    """
    cols = [c for c in docs.columns if c.lower() not in ("size", "source_size", "target", "taken", "shard_copies")]
    place, bucket, src = "place", "bucket", "src"
    # the columns of docs travel in one struct, where their names meet no others
    rows = docs.select(F.struct(*docs.columns).alias("doc"), size.cast("long").alias("size"), F.col(source_col).cast("string").alias(src), F.xxhash64(F.lit(seed), *[F.col(c) for c in key_cols]).alias(place))
    rows = rows.withColumn(bucket, F.shiftrightunsigned(place, 64 - 10).cast("int"))
    keys = [F.col(f"doc.{c}") for c in key_cols]
    per = materialise(rows.groupBy(F.col(src).alias("s"), F.col(bucket).alias("b")).agg(F.sum("size").alias("w")), "buckets")

    def targets(pdf: pd.DataFrame) -> pd.DataFrame:
        """All sources: one row each, a list of configured streams, not of documents."""
        names = [None if pd.isna(x) else x for x in pdf["s"]]
        by = sorted(range(len(names)), key=lambda i: (names[i] is None, names[i] or ""))
        sizes = pdf["w"].to_numpy(np.float64)[by]
        w = np.array([weights[i % len(weights)] for i in range(len(by))], float)
        goal = water_fill(sizes, w, sizes.sum(), cap)
        quotas = np.ceil(goal / block).astype(np.int64)
        cuts = np.cumsum(split_tree(quotas, shards, np.random.default_rng(seed)), axis=0)
        return pd.DataFrame({"s": [names[i] for i in by], "source_size": sizes.astype(np.int64), "target": goal, "quota": quotas, "cuts": list(cuts.T)})

    sums = per.groupBy("s").agg(F.sum("w").alias("w")).withColumn("all", F.lit(1)).groupBy("all").applyInPandas(targets, "s string, source_size bigint, target double, quota bigint, cuts array<bigint>")
    sums = materialise(sums, "sources")
    on = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    line = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    marks = per.withColumn("c0", F.coalesce(F.sum("w").over(line), F.lit(0))).join(sums.withColumnRenamed("s", "s2"), on("s", "s2")).drop("s2")
    # blocks that each bucket's copies may begin in, permuted, and the shards they go to
    blocks = F.expr(f"transform(sequence(0, {cap - 1}), e -> struct(cast((c0 + e * source_size) div {block} as bigint) as lo, cast((c0 + w + e * source_size) div {block} as bigint) as hi))")
    spread = marks.select("s", "b", "quota", "cuts", F.explode(blocks).alias("r")).where("quota > 0").select("s", "b", "quota", "cuts", F.explode(F.sequence("r.lo", "r.hi")).alias("k")).where("k < quota").distinct()

    @F.pandas_udf("int")
    def shard_of(s: pd.Series, k: pd.Series, quota: pd.Series, cuts: pd.Series) -> pd.Series:
        n, x = quota.to_numpy(np.int64), k.to_numpy(np.int64)
        p = permute(x, n, seed)
        at = [int(np.searchsorted(c, v, side="right")) for c, v in zip(cuts, p, strict=True)]
        return pd.Series([i if i < len(c) else None for i, c in zip(at, cuts, strict=True)], dtype="Int32")  # null: no shard has drawn it

    dealt = spread.withColumn("shard", shard_of("s", "k", "quota", "cuts")).groupBy(F.col("s").alias("s3"), F.col("b").alias("b3")).agg(F.map_from_entries(F.collect_list(F.struct("k", "shard"))).alias("shards"))
    marks = marks.join(dealt, on("s", "s3") & (F.col("b") == F.col("b3")), "left").select("s", "b", "c0", "source_size", "target", "shards")
    marks = materialise(marks, "marks")
    met = rows.join(marks, (F.col(src).eqNullSafe(F.col("s"))) & (F.col(bucket) == F.col("b")))
    within = Window.partitionBy(src, bucket).orderBy(place, *keys, "size").rowsBetween(Window.unboundedPreceding, -1)
    met = met.withColumn("c0", F.col("c0") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    starts = F.expr(f"filter(transform(sequence(0, {cap - 1}), e -> c0 + e * source_size), p -> size > 0 and p + size / 2 <= target)")
    met = met.withColumn("shard_copies", F.coalesce(F.filter(F.transform(starts, lambda p: F.try_element_at("shards", F.floor(p / block))), lambda x: x.isNotNull()), F.array().cast("array<int>")))
    return met.withColumn("taken", F.col("size") * F.size("shard_copies")).select(*[F.col(f"doc.`{c}`") for c in cols], "size", "source_size", "target", "taken", "shard_copies")


def permute(k: np.ndarray, n: np.ndarray, seed: int) -> np.ndarray:
    """A fixed permutation of 0..n-1, elementwise: four Feistel rounds on the next even power of two, walked until in range."""
    from .common import mix64

    bits = np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64)
    half = ((bits + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x = k.astype(np.uint64)
    todo = np.ones(len(x), bool)
    while todo.any():
        a, b, m = x[todo] >> half[todo], x[todo] & mask[todo], mask[todo]
        for r in range(4):
            a, b = b, a ^ (mix64(b + np.uint64((seed * 4 + r) * 0x9E3779B97F4A7C15 % (1 << 64))) & m)
        x[todo] = (a << half[todo]) | b
        todo[todo] = x[todo] >= n[todo].astype(np.uint64)
    return x.astype(np.int64)


def words(text_col: str) -> Column:
    """Words of a text: runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0))


def mix(docs: DataFrame, source_col: str = "source", text_col: str = "text", key_cols: Sequence[str] = ("doc_id", "text"), seed: int = 11, **options) -> DataFrame:
    """The mixture itself: the columns of ``docs``, a row for each copy taken, plus shard; rows of a shard stand together, shuffled."""
    copy, out = free_name(docs.columns, "copy"), free_name(docs.columns, "shard")
    took = allocate(docs, source_col, key_cols, words(text_col), seed=seed, **options)
    rows = took.select(*docs.columns, F.posexplode("shard_copies").alias(copy, out))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a shard is spread over tasks by its shuffle key, so that shards need not fit one
    key = F.xxhash64(F.lit(seed + 1), copy, *[F.col(c) for c in key_cols])
    return rows.repartitionByRange(n, F.col(out), key).sortWithinPartitions(F.col(out), key).drop(copy).withColumnRenamed(out, "shard" if "shard" not in docs.columns else out)
