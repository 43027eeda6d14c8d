"""Helpers that the operators of this subpackage share.

Intermediate tables go to the folder named by ``spark.checkpoint.dir``, which every
executor can reach, so that a lost executor never loses a finished step.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separates words: ASCII white space only. ``bytes.split()`` splits at the same characters.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder URI below the checkpoint folder of the session.

    Where the session names none, a local session (as in tests) gets a temporary folder once; on a cluster that is an error, as
    executors could not reach it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
        if not base:
            master = spark.sparkContext.master
            if not (master == "local" or master.startswith("local[")):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors reach")
            base = tempfile.mkdtemp(prefix="foliary-")
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/foliary/{name}-{uuid.uuid4().hex}"


@contextmanager
def session_conf(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings of the session, with _ for the dots of ``spark.sql.``, that hold within the block."""
    old = {k: spark.conf.get(k, None) for k in (f"spark.sql.{n.replace('_', '.')}" for n in values)}
    for k, v in zip(old, values.values(), strict=True):
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends here, and the shuffles of the step go."""
    path = shared_dir(df.sparkSession, name)
    with session_conf(df.sparkSession, classic_shuffleDependency_fileCleanup_enabled="true"):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI; ``file:/x`` and plain paths count as local."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


def row_ids(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a column that tells its rows apart in the same way in each pass, and the name of that column.

    Of a Parquet table it is the file and the place therein, whatever tasks read it; anything else (other files too, which tell no
    places) is numbered and written once.
    """
    rid = free_name(docs.columns, "rid")
    java = getattr(docs, "_jdf", None)  # a remote session has none
    if java is not None and java.queryExecution().optimizedPlan().nodeName().startswith("LogicalRelation") and "_metadata" not in (c.lower() for c in docs.columns):
        try:
            return docs.withColumn(rid, F.struct(F.xxhash64("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("r"))), rid
        except AnalysisException as e:
            if e.getCondition() != "FIELD_NOT_FOUND":
                raise
    number = F.struct(F.lit(0).cast("long").alias("f"), F.monotonically_increasing_id().alias("r"))
    return materialise(docs.withColumn(rid, number), "rows"), rid


def free_name(columns: Sequence[str], stem: str) -> str:
    """A column name that clashes with none of ``columns`` (names compare without case)."""
    taken = {c.lower() for c in columns}
    name = f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def attach(df: DataFrame, keys: Sequence[str], aggs: Sequence[tuple[str, Column]], merges: Sequence[Column], salt: Column, salts: int = 64) -> DataFrame:
    """Give every row the aggregate of its key, without bringing a hot key to one task.

    ``aggs`` are (name, aggregate) pairs taken per (key, salt); ``merges`` combine them per key,
    under the same names. Only the salts that occur are kept, so the second side has a row
    for each (key, salt) that exists and the join is spread over the salts.
    Null keys match each other.
    """
    s = free_name(df.columns, "salt")
    salted = df.withColumn(s, F.pmod(salt, F.lit(salts)).cast("int"))
    part = salted.groupBy(*keys, s).agg(*[a.alias(n) for n, a in aggs])
    whole = part.groupBy(*keys).agg(F.collect_set(s).alias(s), *[m.alias(n) for (n, _), m in zip(aggs, merges, strict=True)])
    right = whole.withColumn(s, F.explode(s)).select(*[F.col(k).alias(f"{k}{s}") for k in keys], F.col(s).alias(f"{s}_r"), *[n for n, _ in aggs])
    on = F.col(s) == F.col(f"{s}_r")
    for k in keys:
        on &= salted[k].eqNullSafe(right[f"{k}{s}"])
    return salted.join(right, on).drop(s, f"{s}_r", *[f"{k}{s}" for k in keys])


def numbered(rows: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """``rows`` with their place from 0 in this order. Rows that tie are told apart by a number of their own, so that a hot value spreads over ranges.

    Ranges are sorted apart and written; the places before a range are prefix sums over the ranges' counts, of which there is one for each task.
    """
    own, at, base = (free_name(rows.columns, x) for x in ("own", "at", "base"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    line = [*order, F.col(own)]
    ranges = rows.withColumn(own, F.monotonically_increasing_id()).repartitionByRange(parts, *line).sortWithinPartitions(*line)
    done = materialise(ranges.drop(own).withColumn(at, F.monotonically_increasing_id()), "ranges")
    part = F.shiftright(at, 33)
    before, bases = 0, []
    for p, n in sorted((r["p"], r["n"]) for r in done.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()):
        bases.append((p, before))
        before += n
    starts = rows.sparkSession.createDataFrame(bases, f"{own} bigint, {base} bigint")
    met = done.join(F.broadcast(starts), part == F.col(own))
    return met.withColumn(name, F.col(base) + F.col(at) - F.shiftleft(part, 33)).drop(own, at, base)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that sums of products spread over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BYTE[65:91] = _BYTE[97:123]  # A-Z hash as a-z
_BASE = 0x2545F4914F6CDD1D
_UNBASE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(n, np.uint64)
    have = 1
    while have < n:
        step = np.uint64(pow(base, have, 1 << 64))
        take = min(have, n - have)
        out[have : have + take] = out[:take] * step
        have += take
    return out


class Shingler:
    """Sorted distinct 64-bit hashes of the k-word shingles of each text of a column.

    Words are runs of non-white-space bytes with A-Z lower-cased; a text of fewer than k words is one shingle, a
    null, empty or blank one has none. Whole texts are read, about ``chunk`` bytes at a time, without a Python loop
    over words: a word's hash is the difference of two prefix sums of its bytes' values times powers of a base.
    """

    def __init__(self, k: int, chunk: int = 1 << 20):
        self.k, self.chunk = k, chunk
        self.up, self.down = _powers(_BASE, chunk), _powers(_UNBASE, chunk)

    def sets(self, column: pa.Array) -> list[np.ndarray]:
        column = column.cast(pa.large_string())
        offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        sizes = np.diff(offs)
        if column.null_count:
            sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), sizes, 0)
        out: list[np.ndarray] = []
        i = 0
        while i < len(sizes):
            j = i + 1
            while j < len(sizes) and offs[j + 1] - offs[i] <= self.chunk:
                j += 1
            out += self._some(data, offs[i : j + 1])
            i = j
        return out

    def _some(self, data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
        empty = np.empty(0, np.uint64)
        b, starts = data[offs[0] : offs[-1]], (offs - offs[0])
        n = len(b)
        if n > len(self.up):
            self.up, self.down = _powers(_BASE, n), _powers(_UNBASE, n)
        word = ~_SPACE[b]
        edge = np.zeros(n + 1, bool)
        edge[starts] = True
        before = np.concatenate([[False], word])
        after = np.concatenate([word, [False]])
        first = np.flatnonzero(after & (~before | edge))
        last = np.flatnonzero(before & (~after | edge))
        if not len(first):
            return [empty] * (len(offs) - 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[b] * self.up[:n], out=sums[1:])
        h = mix64((sums[last] - sums[first]) * self.down[first])
        of = np.searchsorted(first, starts)  # the first word of each text
        m = len(h)
        acc = np.full(m, self.k, np.uint64)
        for j in range(min(self.k, m)):
            acc[: m - j] = mix64(acc[: m - j] * np.uint64(0x9E3779B97F4A7C15) + h[j:])
        out = []
        for a, z in zip(of[:-1].tolist(), of[1:].tolist(), strict=True):
            c = z - a
            if c >= self.k:
                s = np.sort(acc[a : z - self.k + 1])
                new = np.empty(len(s), bool)
                new[0] = True
                np.not_equal(s[1:], s[:-1], out=new[1:])
                out.append(s[new])
            elif c:
                one = np.full(1, c, np.uint64)
                for j in range(a, z):
                    one = mix64(one * np.uint64(0x9E3779B97F4A7C15) + h[j : j + 1])
                out.append(one)
            else:
                out.append(empty)
        return out


def slices(batches: Iterator[pa.RecordBatch], col: str, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``most`` bytes of text in ``col``, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(col)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < len(ends):
            z = max(a + 1, int(np.searchsorted(ends, most + (ends[a - 1] if a else 0), side="right")))
            yield batch.slice(a, z - a)
            a = z


def groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Runs of equal ``keys`` in sorted batches; a run may span batches. Callers bound a run's rows."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            v = c.to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:], strict=False):
            key = tuple(c[a].as_py() for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def block_pairs(df: DataFrame, bucket: str, count: str, spread: Column, cap: int) -> DataFrame:
    """Split buckets of more than ``cap`` rows so that every pair of rows still meets in some task.

    A bucket of ``count`` rows has B = ceil(count / cap) blocks; each row goes to every pair of blocks that
    holds its own. Adds ``blk`` (own block), ``blk_a`` <= ``blk_b``. Rows of buckets within the cap stay single.
    """
    b = F.ceil(F.col(count) / F.lit(cap)).cast("int")
    own = F.pmod(spread, b).cast("int")
    return (
        df.withColumn("blk", own)
        .withColumn("blk_o", F.explode(F.sequence(F.lit(0), b - 1)))
        .withColumn("blk_a", F.least("blk", "blk_o"))
        .withColumn("blk_b", F.greatest("blk", "blk_o"))
        .drop("blk_o")
    )


class UnionFind:
    """Disjoint sets over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True
