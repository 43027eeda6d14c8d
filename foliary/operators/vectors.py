"""A stored vector table in cells around trained centres, with pruned reads and a re-rank that knows when it is complete.

The table is Parquet, partitioned by ``cell``: a vector belongs to the centre it has the largest cosine with; vectors of no length are in cell -1. Centres
come from k-means (MLlib, cosine) on a bounded sample. Beside the rows stands a small table of cells: centre, and the least cosine of any of its vectors
with it. By the angles' triangle inequality that bounds the cosine of a query with anything in a cell. So a search reads the best cells first,
and then only those cells whose bound still reaches the k-th best: its result is exact, or it says that it is not.

The space fingerprint (model, size, normalisation) is part of the table; another one is refused.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.operators.search import cosine, dot
from foliary.sources.tables import overwrite_partitions, shared_folder, stored

ROWS = "cell int, key string, source string, embedding array<double>"
CELLS = "cell int, centre array<double>, least double, n bigint"
#: Vectors that centres are trained on, at most about so many.
SAMPLE = 50_000
#: Slack of bounds for rounding.
SLACK = 1e-9


class SpaceMismatch(ValueError):
    """The stored vectors belong to another space."""


@dataclass(frozen=True)
class Found:
    """``rows``: key, similarity of the nearest. ``complete``: nothing in an unread cell can be nearer; ``read`` of ``cells`` cells were read."""

    rows: DataFrame
    complete: bool
    read: int
    cells: int


def knn_limit(top_k: int, per_route: int = 40, rerank_cap: int = 60, filtered: bool = False) -> int:
    """How many neighbours a route asks for: more where filters will drop some, up to 20 times the page and 8 times the plain limit."""
    plain = max(top_k, per_route, rerank_cap)
    return max(plain, min(20 * top_k, 8 * plain)) if filtered else plain


@dataclass(frozen=True)
class VectorStore:
    """Vectors of one space under ``path``."""

    spark: SparkSession
    path: str
    space: str

    def create(self) -> VectorStore:
        """Write tables without rows; fails where there are any."""
        self.spark.createDataFrame([(self.space,)], "space string").coalesce(1).write.parquet(f"{self.path}/space")
        for name, schema in (("rows", ROWS), ("cells", CELLS)):
            self.spark.createDataFrame([], schema).write.parquet(f"{self.path}/{name}")
        return self

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def bind(self) -> None:
        """Refuse vectors of another space than the stored one. Every read and write does so first."""
        known = self._table("space", "space string").first()["space"]
        if known != self.space:
            raise SpaceMismatch(f"the table holds vectors of {known!r}, not of {self.space!r}")

    def rows(self) -> DataFrame:
        """cell, key, source, embedding of all stored vectors."""
        self.bind()
        return self._table("rows", ROWS).where("key is not null")

    def cells(self) -> DataFrame:
        return self._table("cells", CELLS)

    def train(self, vectors: DataFrame, cells: int, seed: int = 11, sample: int = SAMPLE) -> None:
        """Fix the centres from about ``sample`` of the ``vectors`` (embedding), chosen by a hash. A table is trained once, before its first rows."""
        self.bind()
        if not self.cells().isEmpty():
            raise ValueError("the centres of this table are fixed")
        some = vectors.select(F.col("embedding").cast("array<double>").alias("v"))
        some = some.where(_usable("v")).where(dot(F.col("v"), F.col("v")) > 0)
        n = some.count()
        share = min(1.0, sample / max(n, 1))
        picked = some.where(F.pmod(F.xxhash64("v"), F.lit(1_000_000)) < math.ceil(1_000_000 * share)).select(array_to_vector("v").alias("features"))
        centres = KMeans(k=cells, distanceMeasure="cosine", seed=seed, maxIter=10).fit(picked).clusterCenters() if n else []
        found = [(i, [float(x) for x in c / np.linalg.norm(c)], 1.0, 0) for i, c in enumerate(centres) if np.linalg.norm(c) > 0]
        self.spark.createDataFrame([(-1, [], 1.0, 0), *found], CELLS).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/cells")

    def _placed(self, rows: DataFrame, centres: list[tuple[int, np.ndarray]]) -> DataFrame:
        """Rows with the cell of the nearest centre, ties to the smaller, by one matrix product for each batch."""
        names = np.array([c for c, _ in centres], np.int32)
        matrix = np.array([v for _, v in centres]).T if centres else np.zeros((1, 0))

        @F.pandas_udf("int")
        def nearest(vectors):
            import pandas as pd

            out = np.full(len(vectors), -1, np.int32)
            if len(names):
                at = [i for i, v in enumerate(vectors) if len(v) == len(matrix) and np.any(v)]
                if at:
                    out[at] = names[np.argmax(np.stack([vectors.iloc[i] for i in at]) @ matrix, axis=1)]
            return pd.Series(out)

        return rows.withColumn("cell", nearest("embedding"))

    def _centres(self) -> list[tuple[int, np.ndarray]]:
        """Cells and their centres, in order: as many as the table was trained with."""
        return sorted(((r["cell"], np.array(r["centre"])) for r in self.cells().where("cell >= 0").collect()), key=lambda x: x[0])

    def upsert(self, vectors: DataFrame, removed: DataFrame | None = None) -> DataFrame:
        """Store ``vectors`` (key, source, embedding), in place of rows with their keys, and drop the sources of ``removed`` first.

        Returns the keys of ``vectors`` that are now stored: not those with null keys, or vectors that are null or hold null or non-finite
        components. Of rows that repeat a key one is stored. Only the cells that rows leave or enter are written anew.
        """
        self.bind()
        if self.cells().isEmpty():
            raise ValueError("train the table first")
        good = vectors.where(F.col("key").isNotNull()).select(F.col("key").cast("string").alias("key"), F.col("source").cast("string").alias("source"), F.col("embedding").cast("array<double>").alias("embedding"))
        good = good.where(_usable("embedding")).groupBy("key").agg(F.min(F.struct("source", "embedding")).alias("r")).select("key", "r.*")
        new = stored(self._placed(good, self._centres()), "vectors")
        old = self._table("rows", ROWS).where("key is not null")
        leaving = old.select("cell", "key", "source").join(new.select("key"), "key", "left_semi").select("cell", "key")
        if removed is not None:
            leaving = leaving.unionByName(old.select("cell", "key", "source").join(removed.select(F.col("source").cast("string").alias("source")), "source", "left_semi").select("cell", "key"))
        leaving = stored(leaving.distinct(), "leaving")
        touched = [r["cell"] for r in new.select("cell").union(leaving.select("cell")).distinct().collect()]  # at most as many as there are cells
        if touched:
            whole = old.where(F.col("cell").isin(touched)).join(leaving.select("key"), "key", "left_anti").unionByName(new)
            marks = self.spark.createDataFrame([(c,) for c in touched], "cell int")  # cells that lose all rows are overwritten too
            overwrite_partitions(whole.unionByName(marks, allowMissingColumns=True).select("cell", "key", "source", "embedding"), f"{self.path}/rows", ["cell"], ["key"])
            self._measure(touched)
        return new.select("key")

    def _measure(self, touched: Sequence[int]) -> None:
        """Work out the bounds of these cells again."""
        known = stored(self.cells(), "cells")
        there = self._table("rows", ROWS).where(F.col("cell").isin(list(touched)) & F.col("key").isNotNull()).join(F.broadcast(known.select("cell", "centre")), "cell")
        near = dot(F.col("embedding"), F.col("centre")) / F.sqrt(dot(F.col("embedding"), F.col("embedding")))
        told = there.groupBy("cell").agg(F.min(F.when(F.col("cell") >= 0, near).otherwise(F.lit(1.0))).alias("least"), F.count("*").alias("n"))
        rest = known.where(F.col("cell").isin(list(touched))).select("cell", "centre").join(told, "cell", "left").select("cell", "centre", F.coalesce("least", F.lit(1.0)).alias("least"), F.coalesce("n", F.lit(0)).alias("n"))
        fresh = stored(known.where(~F.col("cell").isin(list(touched))).unionByName(rest), "cells")
        fresh.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/cells")

    def delete(self, sources: DataFrame) -> None:
        """Drop the vectors of these sources."""
        self.upsert(self.spark.createDataFrame([], "key string, source string, embedding array<double>"), sources)

    def count(self) -> int:
        return self.rows().count()

    def get(self, keys: DataFrame) -> DataFrame:
        """key, embedding of those ``keys`` (key) that are stored."""
        return self.rows().select("key", "embedding").join(keys.select(F.col("key").cast("string").alias("key")), "key", "left_semi")

    def attach(self, chunks: DataFrame, chunk_key: str = "chunk_id") -> DataFrame:
        """``chunks`` that have a stored vector, with ``embedding``."""
        mine = self.rows().select(F.col("key").alias("__key"), "embedding")
        return chunks.join(mine, F.col(chunk_key).cast("string") == F.col("__key")).drop("__key")

    def search(self, query: Sequence[float], k: int, probes: int | None = None, first: int = 4) -> Found:
        """The ``k`` stored vectors with the largest cosine with ``query``, to 12 digits; ties by key. A vector of no length has cosine 0.

        Without ``probes`` the result is exact: the ``first`` most promising cells that hold ``k`` rows are read, then those whose bound reaches the
        k-th best, and no others. With it that many cells are read. The driver holds the cells' centres and ``k`` similarities.
        """
        self.bind()
        q = np.array([float(x) for x in query])
        size = float(np.linalg.norm(q))
        cells = []
        for r in self.cells().where("n > 0").collect():
            bound = 0.0
            if r["cell"] >= 0 and size > 0 and len(r["centre"]) == len(q):
                angle = math.acos(max(-1.0, min(1.0, float(q @ np.array(r["centre"])) / size))) - math.acos(max(-1.0, min(1.0, r["least"])))
                bound = math.cos(max(0.0, angle)) + SLACK
            cells.append((-bound, r["cell"], r["n"]))
        cells.sort()
        head, held = 0, 0
        while head < len(cells) and (head < (probes or first) or probes is None and held < k):
            held += cells[head][2]
            head += 1

        def nearest(some: list[tuple[float, int, int]]) -> DataFrame:
            rows = self._table("rows", ROWS).where(F.col("cell").isin([c for _, c, _ in some]) & F.col("key").isNotNull() & (F.size("embedding") == len(q)))
            return rows.select("key", F.round(cosine(F.col("embedding"), q.tolist()), 12).alias("similarity")).orderBy(F.desc("similarity"), "key").limit(k)

        got = stored(nearest(cells[:head]), "nearest")
        worst = got.agg(F.count("*").alias("n"), F.min("similarity").alias("s")).first()
        more = [c for c in cells[head:] if worst["n"] < k or -c[0] >= worst["s"]]
        if probes is not None or not more:
            return Found(got, not more, head, len(cells))
        both = got.unionByName(nearest(more)).orderBy(F.desc("similarity"), "key").limit(k)
        return Found(both, True, head + len(more), len(cells))


def _usable(c: str):
    """Not null, not empty, all components finite."""
    return F.coalesce((F.size(c) > 0) & ~F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def new_store(spark: SparkSession, space: str) -> VectorStore:
    """An empty table in the shared folder of the session."""
    return VectorStore(spark, shared_folder(spark, "vectors"), space).create()
