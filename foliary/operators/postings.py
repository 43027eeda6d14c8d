"""A stored trigram index of chunks, kept up to date by source, that answers the BM25 route without reading any content.

The index is one Parquet table, partitioned by ``shard`` (a hash of the source) and ``slot`` (a hash of the trigram; -1 holds a row for each chunk). A
trigram is the number of its three code points, 21 bits each, and files are sorted by it, so a query lists a few slots and reads a few row groups.
A row of postings holds the places of its trigram in the lower-case contents of many chunks. A phrase occurs where the postings of trigrams that cover
it agree, so its frequency is exact, overlaps included.

An upsert appends the postings of its chunks, under a name of its own (``seg``), and rewrites the rows of chunks of the shards it touches, which are few
and narrow. Postings of chunks without such a row are dead: a query leaves them out, and a shard with more dead postings than live ones is rewritten
without them. So what is written grows with what comes in, not with what is there.

Every partition that is overwritten has a row without a chunk number: one that loses its last row is thus overwritten too. That of slot -1 counts what is dead.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.functions.text import phrase_groups
from foliary.operators.search import PER_ROUTE, bm25_score, place, top
from foliary.sources.tables import overwrite_partitions, shared_folder, stored

SCHEMA = "shard int, slot int, seg string, gram bigint, nos array<bigint>, places array<int>, no bigint, size int, chunk_id string, source string, chunk_index int, dead bigint"
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
_CHUNK = ["shard", "seg", "no"]
#: Characters whose postings one task makes, and those that are sorted at once.
TASK_CHARS, SORT_CHARS = 1 << 23, 1 << 21


def gram_code(three: str) -> int:
    """The number of three code points."""
    a, b, c = map(ord, three)
    return a << 42 | b << 21 | c


def covering(phrase: str) -> list[tuple[int, int]]:
    """(offset, trigram) of as few trigrams as cover a phrase of three characters or more."""
    starts = [*range(0, len(phrase) - 3, 3), len(phrase) - 3]
    return [(i, gram_code(phrase[i : i + 3])) for i in starts]


@dataclass(frozen=True)
class TrigramIndex:
    """The index at ``path``. ``shards`` and ``slots`` belong to the table and stay as it was first written."""

    spark: SparkSession
    path: str
    shards: int = 64
    slots: int = 16

    def create(self) -> TrigramIndex:
        """Write a table without rows; fails where there is one."""
        self.spark.createDataFrame([], SCHEMA).write.parquet(self.path)
        return self

    def read(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def chunks(self) -> DataFrame:
        """shard, seg, no, chunk_id, source, chunk_index and size (number of trigrams) of every chunk."""
        return self.read().where("slot = -1 and no is not null").select(*_CHUNK, "chunk_id", "source", "chunk_index", "size")

    def count(self) -> int:
        return self.chunks().count()

    def _shard(self) -> Column:
        return F.pmod(F.xxhash64("source"), F.lit(self.shards)).cast("int")

    def upsert(self, chunks: DataFrame, removed: DataFrame | None = None) -> None:
        """Replace all rows of the sources of ``chunks`` (source, chunk_index, chunk_id, content) by these, and drop the sources of ``removed``.

        Null sources are left out; null contents count as empty. A source in both is replaced. If a write is cut off, the same call mends it: postings
        that it appended are dead, as no chunk has their name.
        """
        seg = uuid.uuid4().hex
        content = F.coalesce("content", F.lit("")).alias("content")
        added = stored(chunks.where("source is not null").select("source", "chunk_index", "chunk_id", content, self._shard().alias("shard"), F.monotonically_increasing_id().alias("no")), "added")
        gone = added.select("shard", "source")
        if removed is not None:
            gone = gone.unionByName(removed.where("source is not null").select(self._shard().alias("shard"), "source"))
        gone = stored(gone.distinct(), "gone")
        touched = [r["shard"] for r in gone.select("shard").distinct().collect()]  # at most as many as there are shards
        if not touched:
            return
        old = self.chunks().where(F.col("shard").isin(touched))
        fresh = added.select("*", F.lit(seg).alias("seg"), F.greatest(F.length("content") - 2, F.lit(0)).alias("size")).select(*old.columns)
        live = stored(old.join(gone, ["shard", "source"], "left_anti").unionByName(fresh), "live")
        before = self._by_shard(self.read().where(F.col("shard").isin(touched) & (F.col("slot") == -1)), F.coalesce("size", "dead"))
        after, new = self._by_shard(live, F.col("size")), self._by_shard(live.where(F.col("seg") == seg), F.col("size"))
        dead = {s: before.get(s, 0) + new.get(s, 0) - after.get(s, 0) for s in touched}
        if new:
            self._append(added, seg, new)
        squeezed = [s for s in touched if dead[s] > after.get(s, 0)]
        self._rewrite(live, {s: 0 if s in squeezed else n for s, n in dead.items()}, squeezed)

    def delete(self, sources: DataFrame) -> None:
        """Drop the chunks of these sources."""
        self.upsert(self.spark.createDataFrame([], "source string, chunk_index int, chunk_id string, content string"), sources)

    def clear(self) -> None:
        """Drop all chunks."""
        self.delete(self.chunks().select("source").distinct())

    def compact(self) -> None:
        """Rewrite all shards without dead postings, one file for each slot of a shard: for after many small upserts, each of which adds files."""
        live = stored(self.chunks(), "live")
        every = [r["shard"] for r in self.read().select("shard").distinct().collect()]
        if every:
            self._rewrite(live, dict.fromkeys(every, 0), every)

    @staticmethod
    def _by_shard(rows: DataFrame, size: Column) -> dict[int, int]:
        return {r["shard"]: r["n"] or 0 for r in rows.groupBy("shard").agg(F.sum(size).alias("n")).collect()}

    def _append(self, added: DataFrame, seg: str, chars: dict[int, int]) -> None:
        """Append the postings of ``added``: tasks of one shard each, as many for a shard as its ``chars`` ask for."""
        tasks, deal = 0, []
        for s, n in sorted(chars.items()):
            per = max(1, -(-n // TASK_CHARS))
            deal.append((s, tasks, per))
            tasks += per
        low = added.where(F.length(F.lower("content")) >= 3).select("shard", "no", F.lower("content").alias("low"))
        dealt = low.join(F.broadcast(self.spark.createDataFrame(deal, "shard int, base int, per int")), "shard")
        dealt = dealt.repartitionById(tasks, (F.col("base") + F.pmod(F.xxhash64("no"), F.col("per"))).cast("int")).select("shard", "no", "low")
        rows = self._postings(dealt).withColumn("seg", F.lit(seg)).sortWithinPartitions("shard", "slot", "gram")
        rows.write.mode("append").option("compression", "zstd").partitionBy("shard", "slot").parquet(self.path)

    def _rewrite(self, live: DataFrame, dead: dict[int, int], squeezed: list[int]) -> None:
        """Overwrite the rows of chunks of the shards of ``dead`` by ``live``, and the postings of the ``squeezed`` shards by those of live chunks."""
        marks = self.spark.createDataFrame(sorted(dead.items()), "shard int, dead bigint").withColumn("slot", F.lit(-1))
        whole = live.withColumn("slot", F.lit(-1)).unionByName(marks, allowMissingColumns=True)
        if squeezed:
            rows = self.read().where(F.col("shard").isin(squeezed) & F.col("nos").isNotNull()).withColumn("row", F.monotonically_increasing_id())
            spots = rows.select("shard", "slot", "seg", "gram", "row", F.inline(F.arrays_zip("nos", "places"))).withColumnRenamed("nos", "no")
            spots = spots.join(live.select(*_CHUNK), _CHUNK, "left_semi")
            kept = spots.groupBy("shard", "slot", "seg", "gram", "row").agg(F.sort_array(F.collect_list(F.struct("no", "places"))).alias("at"))
            kept = kept.select("shard", "slot", "seg", "gram", F.col("at.no").alias("nos"), F.col("at.places").alias("places"))
            slots = self.spark.createDataFrame([(s, i) for s in squeezed for i in range(self.slots)], "shard int, slot int")
            whole = whole.unionByName(kept, allowMissingColumns=True).unionByName(slots, allowMissingColumns=True)
        for c in SCHEMA.split(", "):
            if c.split()[0] not in whole.columns:
                whole = whole.withColumn(c.split()[0], F.lit(None).cast(c.split()[1]))
        overwrite_partitions(whole.select(*_COLUMNS), self.path, ["shard", "slot"], ["gram", "no"])

    def _postings(self, low: DataFrame) -> DataFrame:
        """Rows of postings of the texts ``low``, whose tasks hold one shard each: one for each trigram of about ``SORT_CHARS`` characters, sorted at once."""
        slots = self.slots

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts, nos = b.column("low").to_pylist(), b.column("no").to_numpy()
                for some in _runs([len(t) for t in texts], SORT_CHARS):
                    points = [np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.int64) for t in texts[some]]
                    codes = [t[:-2] << 42 | t[1:-1] << 21 | t[2:] for t in points]
                    sizes = [len(c) for c in codes]
                    gram = np.concatenate(codes)
                    order = np.argsort(gram, kind="stable")  # so chunks and places stay in order
                    gram = gram[order]
                    no = np.repeat(nos[some], sizes)[order]
                    at = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])[order]
                    first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
                    ends = pa.array(np.append(first, len(gram)), pa.int32())
                    lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (no, at)]
                    slot = (gram[first] % 1_000_003 % slots).astype(np.int32)
                    shard = pa.array(np.full(len(first), b.column("shard")[0].as_py(), np.int32))
                    yield pa.RecordBatch.from_arrays([shard, pa.array(slot), pa.array(gram[first]), *lists], ["shard", "slot", "gram", "nos", "places"])

        return low.mapInArrow(run, "shard int, slot int, gram bigint, nos array<bigint>, places array<int>")

    def phrase_hits(self, phrases: list[str]) -> DataFrame:
        """shard, seg, no, size, source, tf0, tf1, ...: how often each phrase occurs, overlaps included, in the live chunks that hold any of their trigrams."""
        covers = [covering(p) for p in phrases]
        codes = sorted({g for c in covers for _, g in c})
        slots = sorted({g % 1_000_003 % self.slots for g in codes})
        rows = self.read().where(F.col("slot").isin(slots) & F.col("gram").isin(codes) & F.col("nos").isNotNull())
        spots = rows.select("shard", "seg", "gram", F.inline(F.arrays_zip("nos", "places"))).withColumnRenamed("nos", "no")
        found = spots.groupBy(*_CHUNK).agg(*[F.collect_list(F.when(F.col("gram") == g, F.col("places"))).alias(f"g{i}") for i, g in enumerate(codes)])

        def starts(offset: int, gram: int) -> Column:
            return F.transform(f"g{codes.index(gram)}", lambda x: x - offset)

        def hits(cover: list[tuple[int, int]]) -> Column:
            return F.size(F.array_distinct(reduce(F.array_intersect, [starts(*x) for x in cover]))).cast("long")

        live = self.chunks().select(*_CHUNK, "size", "source")
        return found.select(*_CHUNK, *[hits(c).alias(f"tf{i}") for i, c in enumerate(covers)]).join(live, _CHUNK)

    def bm25_route(self, query: str, n: int = PER_ROUTE, prefix: str = "", key: Sequence[str] = ("chunk_id",)) -> DataFrame:
        """(key, rank) of the best ``n`` chunks: what ``search.bm25_route`` gives for the contents, from postings alone.

        Statistics are over all chunks; ``prefix`` admits sources that begin with it. Only chunks that score no less than the n-th best are looked up by name.
        """
        groups = phrase_groups(query)
        if not groups:
            return self.chunks().select(*key, F.lit(0).cast("long").alias("rank")).limit(0)
        flat = list(dict.fromkeys(p for g in groups for p in g))
        hits = stored(self.phrase_hits(flat), "hits")
        sizes = self.chunks().agg(F.count("*").alias("__n"), F.avg("size").alias("__avg"))
        stats = hits.agg(*[F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(flat))]).crossJoin(sizes)  # a row each
        match = reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, [F.col(f"tf{flat.index(p)}") > 0 for p in g]) for g in groups])
        met = hits.where(match)
        if prefix.strip():
            met = met.where(F.col("source").startswith(prefix.strip().replace("\\", "/").rstrip("/")))
        uses = [flat.index(p) for g in groups for p in g]
        score = bm25_score([(F.col(f"tf{i}"), F.col(f"df{i}")) for i in uses], F.col("size"))
        scored = stored(met.crossJoin(F.broadcast(stats)).select(*_CHUNK, F.round(score, 9).alias("score")), "scored")
        least = scored.orderBy(F.desc("score")).limit(n).agg(F.min("score").alias("least"))
        best = scored.crossJoin(F.broadcast(least)).where(F.col("score") >= F.col("least"))
        return top(best.join(self.chunks(), _CHUNK), place(F.col("score")), n, key)


def _runs(sizes: list[int], most: int) -> Iterator[slice]:
    """Slices of consecutive entries of about ``most`` in all, at least one each."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if sizes:
        yield slice(start, len(sizes))


def new_index(spark: SparkSession, shards: int = 64, slots: int = 16) -> TrigramIndex:
    """An empty index in the shared folder of the session."""
    return TrigramIndex(spark, shared_folder(spark, "trigrams"), shards, slots).create()
