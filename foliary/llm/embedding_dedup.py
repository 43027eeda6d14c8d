"""Embedding near-duplicates: random-hyperplane signs in several tables, exact cosine, components.

Equal (label, vector) rows form one class, so a vector that repeats a million times is compared once. A class has a
signature of ``bits`` signs in each of ``tables`` tables; classes with the same label and signature meet in a bucket.
Every pair is judged by its double-precision cosine, in the first table where it meets, so links are counted
once without listing pairs. Buckets above ``cap`` are split into pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UnionFind, block_pairs, groups, materialise
from .graph import components

CAP = 1024


def signatures(rows: np.ndarray, tables: int, bits: int, seed: int) -> np.ndarray:
    """(n, tables) integers: signs of the projections on random normal directions, fixed by the seed."""
    planes = np.random.default_rng([seed, rows.shape[1]]).standard_normal((rows.shape[1], tables * bits))
    signs = (rows @ planes >= 0).reshape(len(rows), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def _unit(blob: bytes) -> np.ndarray:
    v = np.frombuffer(blob, np.float64)
    v = v / np.abs(v).max()
    return v / np.sqrt(v @ v)


def classes(rows: DataFrame) -> DataFrame:
    """Adds key (digest of label and vector) and vec (doubles as bytes); null where the vector links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            keys, vecs = [], []
            for label, v in zip(b.column("lab").to_pylist(), b.column("v"), strict=True):
                x = None
                if label is not None and v.is_valid and len(v.values) and not v.values.null_count:
                    x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                    if not np.isfinite(x).all() or not x.any():
                        x = None
                keys.append(None if x is None else xxhash.xxh3_128_digest(repr(label).encode() + b"\0" + (x + 0.0).tobytes()))
                vecs.append(None if x is None else x.tobytes())
            yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("id"), b.column("lab"), pa.array(keys, pa.binary()), pa.array(vecs, pa.binary())], ["rid", "id", "lab", "key", "vec"])

    return rows.mapInArrow(run, "rid bigint, id bigint, lab string, key binary, vec binary")


def embedding_groups(df: DataFrame, id_col: str, vec_col: str, label_col: str, cosine: float = 0.93, tables: int = 24, bits: int = 12, seed: int = 20, cap: int = CAP) -> DataFrame:
    """One row per row of ``df``: id, n_links, component_id, kept.

    Two rows link where labels are equal and not null and the cosine of their vectors is at least ``cosine``, if they meet
    in a table (at the bound itself a pair is missed with chance (1 - (1 - a/pi)^bits)^tables, a being its angle; copies
    always meet). Vectors that are null, empty, zero, of another length, or hold null or non-finite components link with nothing.
    n_links counts other rows, repeated rows included. component_id is the smallest id reachable; null ids come last.
    One row of each component is kept: the one with that id (where ids repeat, the first of them as written).
    Other columns are not read.
    """
    rows = df.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("lab"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = materialise(classes(rows), "vectors")
    whole = rows.where("key is not null").groupBy("key").agg(F.count("*").alias("copies"), F.first("lab").alias("lab"), F.first("vec").alias("vec"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vecs = b.column("vec").to_pylist()
            sigs: list[bytes] = [b""] * len(vecs)
            for size in {len(v) for v in vecs}:
                at = [i for i, v in enumerate(vecs) if len(v) == size]
                for i, s in zip(at, signatures(np.stack([_unit(vecs[i]) for i in at]), tables, bits, seed), strict=True):
                    sigs[i] = s.astype(np.int32).tobytes()
            ints = pa.array([np.frombuffer(s, np.int32).tolist() for s in sigs], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("key", "copies", "lab", "vec")], ints], ["key", "copies", "lab", "vec", "sig"])

    signed = materialise(whole.mapInArrow(sign, "key binary, copies bigint, lab string, vec binary, sig array<int>"), "signed")
    posts = signed.select("key", F.xxhash64("lab", F.length("vec")).alias("grp"), F.posexplode("sig").alias("tab", "sign"))
    posts = posts.select("key", "tab", F.xxhash64("grp", "tab", "sign").alias("bucket"))
    sizes = posts.groupBy("tab", "bucket").agg(F.count("*").alias("c")).where("c > 1")
    tasks = block_pairs(posts.join(sizes, ["tab", "bucket"]), "bucket", "c", F.xxhash64("key"), cap).join(signed, "key")
    tasks = tasks.select("tab", "bucket", "blk", "blk_a", "blk_b", "key", "copies", "lab", "vec", "sig")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["tab", "bucket", "blk_a", "blk_b"]):
            tab, keys = t.column("tab")[0].as_py(), t.column("key").to_pylist()
            labels = np.unique(t.column("lab").to_numpy(), return_inverse=True)[1]
            vecs = t.column("vec").to_pylist()
            if len({len(v) for v in vecs}) > 1:  # hashes of two lengths met
                continue
            x = np.stack([_unit(v) for v in vecs])
            sig = np.stack([s.values.to_numpy() for s in t.column("sig").combine_chunks()])
            side = t.column("blk").to_numpy()
            near = (x @ x.T >= cosine) & (labels[:, None] == labels)
            np.fill_diagonal(near, False)
            if side.min() != side.max():
                near &= side[:, None] != side
            a, b = np.nonzero(near)
            new = ~(sig[a, :tab] == sig[b, :tab]).any(axis=1)  # met in no earlier table
            a, b = a[new], b[new]
            if not len(a):
                continue
            copies = t.column("copies").to_numpy()
            links = np.bincount(a, weights=copies[b], minlength=len(keys)).astype(np.int64)
            uf, to = UnionFind(len(keys)), {}
            for i, j in zip(a.tolist(), b.tolist(), strict=True):
                uf.join(i, j)
            at = np.flatnonzero(links)
            to = [keys[uf.find(i)] for i in at.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in at], pa.binary()), pa.array(to, pa.binary()), pa.array(links[at])], ["a", "b", "links"])

    order = ["tab", "bucket", "blk_a", "blk_b"]
    met = materialise(tasks.repartition(*order).sortWithinPartitions(*order).mapInArrow(meet, "a binary, b binary, links bigint"), "met")
    comp = components(met.select("a", "b"))
    per = signed.select("key", "copies").join(met.groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links")), "key", "left").join(comp.withColumnRenamed("node", "key"), "key", "left")
    per = per.select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "key").alias("root"))
    of = rows.select("rid", "id", "key").join(per, "key", "left")
    least = of.where("root is not null").groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("z"), "id", "rid")).alias("m"))
    out = of.join(least, "root", "left")
    lone = F.col("root").isNull()
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(lone, F.col("id")).otherwise(F.col("m.id")).alias("component_id"), (lone | (F.col("rid") == F.col("m.rid"))).alias("kept"))
