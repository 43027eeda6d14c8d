"""Nearest neighbours by largest inner product, by collision counting.

Vectors are scaled by the largest norm of their shard and given one more component, so that all have length one and the largest inner product is
the smallest distance. A hash function is a projection on one random direction, and a shard keeps the sorted projections of its vectors for each of
``arrays`` directions. A query opens a window around its own projection in every array; windows widen by steady factors (virtual rehashing: nothing is
hashed again). A vector that lies in at least ``share`` of the windows, which its ranks in the arrays tell, is verified by its exact inner product.

A query is done with a shard when the windows are so wide that any vector as near as its k-th best so far would have been counted often enough with
the chance ``sure``; there is no limit on how many vectors are verified. Shards are sorted by norm, so a query skips those whose norms cannot reach
its k-th best. The queries meet all rows in blocks: work grows with queries times rows, and what a block holds is bounded.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import groups, materialise, numbered

#: Rows of one sorted shard, rows that one task streams, queries of one block.
SHARD, STREAM, BLOCK = 8192, 32_768, 1024


def directions(size: int, arrays: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, size]).standard_normal((size, arrays))


def collide(width: np.ndarray | float, distance: np.ndarray | float) -> float:
    """The chance that two points at a distance lie within ``width`` of each other on a random direction."""
    return math.erf(width / max(distance, 1e-12) / math.sqrt(2))


def at_least(trials: int, wins: int, chance: float) -> float:
    """The chance of so many wins or more in independent trials."""
    if chance >= 1:
        return 1.0
    logs = [math.lgamma(trials + 1) - math.lgamma(i + 1) - math.lgamma(trials - i + 1) + i * math.log(max(chance, 1e-300)) + (trials - i) * math.log1p(-chance) for i in range(wins, trials + 1)]
    return min(1.0, sum(map(math.exp, logs)))


def width_for(arrays: int, wins: int, sure: float) -> float:
    """The width of windows in which a point at distance 1 is counted ``wins`` times with the chance ``sure``. Widths grow as distances do."""
    low, high = 1e-3, 1e3
    for _ in range(60):
        mid = math.sqrt(low * high)
        low, high = (low, mid) if at_least(arrays, wins, collide(mid, 1.0)) >= sure else (mid, high)
    return high


class Shard:
    """Sorted projections of at most 65,535 vectors of one length, and each vector's rank in every array."""

    def __init__(self, x: np.ndarray, top: float, planes: np.ndarray):
        self.x, self.top = x, top
        scaled = x / top
        rest = np.sqrt(np.clip(1 - np.einsum("ij,ij->i", scaled, scaled), 0, 1))
        spots = scaled @ planes[:-1] + np.outer(rest, planes[-1])
        order = np.argsort(spots, axis=0, kind="stable").T
        self.rank = np.empty(order.shape, np.uint16)
        np.put_along_axis(self.rank, order, np.arange(len(x), dtype=np.uint16)[None], axis=1)
        self.low = spots.min() - 1
        self.step = spots.max() + 1 - self.low  # array i lies between i * step and (i + 1) * step: one sorted line of all arrays
        self.lift = np.arange(len(order)) * self.step - self.low
        self.line = (np.take_along_axis(spots.T, order, axis=1) + self.lift[:, None]).ravel()

    def collisions(self, spots: np.ndarray, width: float) -> np.ndarray:
        """In how many arrays each vector lies in the window of this width around a query's projection: where its rank is between the window's ends."""
        n = len(self.x)
        low, high = self.lift + self.low, self.lift + self.low + self.step
        first, last = (np.searchsorted(self.line, np.clip(spots + self.lift + w, low, high)) - np.arange(len(self.lift)) * n for w in (-width, width))
        inside = (self.rank - first.astype(np.uint16)[:, None]) < (last - first).astype(np.uint16)[:, None]  # ranks below the window wrap around
        return inside.view(np.uint8).sum(axis=0, dtype=np.uint8)


class Best:
    """The best k rows of one query so far: scores falling, then ids rising."""

    def __init__(self, k: int):
        self.k = k
        self.scores, self.ids, self.own = np.empty(0), np.empty(0, np.int64), np.empty(0, bool)

    def bound(self) -> float:
        return self.scores[self.k - 1] if len(self.scores) >= self.k else -np.inf

    def add(self, scores: np.ndarray, ids: list[np.ndarray], own: np.ndarray) -> None:
        sizes = [len(x) for x in ids]
        s = np.concatenate([self.scores, np.repeat(scores, sizes)])
        i = np.concatenate([self.ids, *ids])
        o = np.concatenate([self.own, np.repeat(own, sizes)])
        order = np.lexsort((i, -s))[: self.k]
        self.scores, self.ids, self.own = s[order], i[order], o[order]


def search(shard: Shard, ids: list[np.ndarray], keys: np.ndarray, q: np.ndarray, q_keys: np.ndarray, best: list[Best], planes: np.ndarray, wins: int, unit: float, first: float, growth: float) -> None:
    """Add to ``best`` what the shard has for each query. ``unit`` is the width for distance 1."""
    n = len(shard.x)
    for i in range(len(q)):
        norm = math.sqrt(q[i] @ q[i])
        if best[i].bound() > norm * shard.top * (1 + 1e-12):
            continue
        spots = (q[i] / norm) @ planes[:-1]
        def need() -> float:
            bound = best[i].bound() / (norm * shard.top)
            return unit * math.sqrt(max(0.0, 2 - 2 * min(1.0, bound))) if bound > -np.inf else np.inf

        left, started, known = np.ones(n, bool), False, need()
        width = first if known == np.inf else min(known, max(first, known / growth))
        while left.any():
            counts = shard.collisions(spots, width)
            enough = wins
            if not started:  # the first step also takes those that were counted most often, so that there is a k-th best
                most = min(n, best[i].k)
                enough, started = min(wins, np.partition(counts, n - most)[n - most]), True
            met = np.flatnonzero((counts >= enough) & left)
            left[met] = False
            if len(met):
                verify(shard, ids, keys, q[i], q_keys[i], best[i], met)
            if width >= (known := need()) or counts.min() == len(spots):
                break
            width = min(width * growth, known)


def verify(shard: Shard, ids: list[np.ndarray], keys: np.ndarray, q: np.ndarray, q_key: bytes, best: Best, rows: np.ndarray) -> None:
    """Exact scores of these rows. Sums in a fixed order decide; a faster product only leaves out what is too far off to matter."""
    rough = shard.x[rows] @ q
    least = best.bound()
    if len(rows) > best.k:
        least = max(least, np.partition(rough, -best.k)[-best.k])
    if least > -np.inf:
        rows = rows[rough >= least - 1e-9 * (abs(least) + shard.top * math.sqrt(q @ q))]
    scores = (shard.x[rows] * q).sum(axis=1)
    order = np.lexsort(([ids[r][0] for r in rows.tolist()], -scores))[: best.k]
    rows = rows[order]
    best.add(scores[order], [ids[r] for r in rows.tolist()], keys[rows] == q_key)


def vector_key() -> Column:
    """128 bits of the column v; equal for vectors that differ in the sign of zeros alone."""
    return F.unhex(F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(i), "v")), 16, "0") for i in (1, 2)]))


def classes(df: DataFrame, id_col: str, vec_col: str, k: int) -> DataFrame:
    """(key, size, norm, v, ids): distinct vectors that take part, as bytes of doubles, each with the k + 1 smallest ids of its rows, repeats counted.

    A vector that millions of rows share is thus searched once; tasks drop what is beyond k + 1 before they send anything.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("id is not null")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0)).withColumn("key", vector_key())
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where(F.col("n") <= k + 1)
    return first.groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("v").alias("v"))


def nearest(df: DataFrame, id_col: str, vec_col: str, k: int = 20, every: int = 20, arrays: int = 64, share: float = 0.8, sure: float = 0.97, first: float = 0.7, growth: float = 1.5, seed: int = 13, shard: int = SHARD, stream: int = STREAM, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every`` the ``k`` rows found with the largest inner products, its own apart.

    Scores are inner products in double precision of the vectors as given, ties go to the smaller id. All rows are indexed. Vectors that are null,
    empty, zero or hold null or non-finite components, and rows without an id, take no part; a query meets vectors of its own length only. A query with fewer
    candidates gets them all. Rows with equal vectors, or with equal ids, count as rows of their own; of repeated ids each row is a query.
    Other columns are not read. A vector as near as the k-th found is found with the chance ``sure`` at least.
    """
    whole = materialise(classes(df, id_col, vec_col, k), "vectors")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    sized = whole.select("key", "ids", "v", F.size("v").alias("size"), norm.alias("norm"))
    is_query = F.pmod(F.col(id_col).cast("long"), F.lit(every)) == 0
    asked = df.where(is_query).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    asked = materialise(asked.select("id", vector_key().alias("key")).join(whole.select("key"), "key", "left_semi"), "asked")
    n, n_queries = whole.count(), asked.select("key").distinct().count()
    if not n_queries:
        return df.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    blocks, streams = -(-n_queries // block), -(-n // stream)
    order = [F.asc("size"), F.desc("norm"), F.asc("key")]
    at = F.col("at")
    placed = numbered(sized, order, "at").select("key", "ids", "v", "size", "norm", F.floor(at / stream).alias("stream"), F.floor(at % stream / shard).alias("shard"))
    rows = placed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    queries = sized.join(asked.select("key").distinct(), "key", "left_semi").withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
    queries = queries.withColumn("stream", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(streams - 1).cast("long")))).withColumn("shard", F.lit(-1).cast("long"))
    names = ["block", "stream", "shard", "size", "norm", "key", "ids", "v"]
    met = rows.select(*names).unionByName(queries.select(*names))
    wins = math.ceil(share * arrays)
    unit = width_for(arrays, wins, sure)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked_by: dict[int, tuple[np.ndarray, np.ndarray, list[Best]]] = {}
        now = None

        def told() -> Iterator[pa.RecordBatch]:
            for _, q_keys, best in asked_by.values():
                size = [len(b.ids) for b in best]
                cols = [np.repeat(q_keys, size), np.concatenate([b.scores for b in best]), np.concatenate([b.ids for b in best]), np.concatenate([b.own for b in best])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.float64(), pa.int64(), pa.bool_()), strict=True)], ["key", "score", "id", "own"])

        for t in groups(batches, ["block", "stream", "shard", "size"]):
            here = (t.column("block")[0].as_py(), t.column("stream")[0].as_py())
            if here != now:
                yield from told()
                asked_by, now = {}, here
            size = t.column("size")[0].as_py()
            x = t.column("v").combine_chunks().flatten().to_numpy().reshape(-1, size)
            keys = np.array(t.column("key").to_pylist(), object)
            if t.column("shard")[0].as_py() < 0:
                asked_by[size] = (x, keys, [Best(k + 1) for _ in keys])
            elif size in asked_by:
                planes = directions(size + 1, arrays, seed)
                q, q_keys, best = asked_by[size]
                ids = [np.array(i, np.int64) for i in t.column("ids").to_pylist()]
                search(Shard(x, float(t.column("norm").to_numpy().max()) * (1 + 1e-12), planes), ids, keys, q, q_keys, best, planes, wins, unit, first, growth)
        yield from told()

    deal = ["block", "stream"]
    got = met.repartition(blocks * streams, *deal).sortWithinPartitions(*deal, "shard", "size", F.desc("norm"), "key")
    found = materialise(got.mapInArrow(run, "key binary, score double, id bigint, own boolean"), "found")
    line = Window.partitionBy("key").orderBy(F.desc("score"), "id")
    lists = found.withColumn("n", F.row_number().over(line)).where(F.col("n") <= k + 1).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("n", "score", "id", "own"))).alias("found"))
    lists = materialise(lists, "lists")  # so that a key with many queries can be split in the join
    both = asked.join(lists, "key")
    mine = F.array_position(F.transform("found", lambda e: e["own"] & (e["id"] == F.col("id"))), True)
    rest = F.slice(F.filter("found", lambda e, i: i + 1 != mine), 1, k)
    out = both.select(F.col("id").alias("query_id"), F.posexplode(rest).alias("at", "e"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("e.id").alias("vec_id"), F.col("e.score").alias("score"))
