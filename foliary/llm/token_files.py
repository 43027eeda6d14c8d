"""Token-ID output: flat unsigned-integer files with 64-bit document offsets, memory-mapped by readers.

Documents are range-partitioned and sorted by id; each task encodes its range and writes one pair of files:

* ``NAME.bin``: the ids of its documents, one after the other, little-endian uint16 (uint32 for larger vocabularies);
* ``NAME.idx``: magic ``FOLTOK01``, then uint64 id width, documents n and ids m, then n+1 uint64 offsets in ids,
  n int64 document ids and n flags (1: the id is null).

The manifest lists the files of the attempts that succeeded, so a repeated or speculative attempt leaves only a file
that nobody reads. The first id of each partition comes from a prefix sum over the manifest: a document's
global offset is its partition's base plus its local offset.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, open_fs, shared_dir
from .tokens import default_path, encoder

MAGIC = b"FOLTOK01"
SLICE = 256  # texts encoded at a time


def write_token_files(docs: DataFrame, id_col: str, text_col: str, out: str, end_id: int, tokenizer_path: str | None = None, partitions: int | None = None) -> DataFrame:
    """Write the token files of ``docs`` below the URI ``out``; return the manifest.

    Manifest: part, file, documents, tokens, base_document, base_token. Null texts are empty; every document ends with
    ``end_id``. Order: ascending id, null ids first, equal ids by a hash of the text. An empty table gives an empty manifest.
    Other columns are not read.
    """
    spark = docs.sparkSession
    path = tokenizer_path or default_path()
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("tie"))
    rows = rows.repartitionByRange(n, "id", "tie").sortWithinPartitions("id", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        enc = encoder(path)
        kind = np.uint16 if len(enc.width) <= 1 << 16 and end_id < 1 << 16 else np.uint32
        fs, folder = open_fs(out)
        fs.create_dir(folder, recursive=True)
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        ids, nulls, lengths = [], [], []
        with fs.open_output_stream(f"{folder}/{name}.bin") as f:
            for b in batches:
                col, key = b.column("text"), b.column("id")
                nulls.append(np.asarray(key.is_null()).astype(np.uint8))
                ids.append(key.fill_null(0).to_numpy().astype("<i8"))
                for i in range(0, b.num_rows, SLICE):
                    got = enc.encode(col[i : i + SLICE].to_pylist(), end_id)
                    lengths += map(len, got)
                    f.write(np.concatenate(got).astype(kind).astype(f"<u{kind().itemsize}").tobytes())
        if not lengths:
            fs.delete_file(f"{folder}/{name}.bin")
            return
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
        with fs.open_output_stream(f"{folder}/{name}.idx") as f:
            f.write(MAGIC + np.array([kind().itemsize, len(lengths), offsets[-1]], "<u8").tobytes())
            f.write(offsets.tobytes() + np.concatenate(ids).tobytes() + np.concatenate(nulls).tobytes())
        yield pa.RecordBatch.from_pylist([{"part": part, "file": name, "documents": len(lengths), "tokens": int(offsets[-1])}], pa.schema([("part", pa.int64()), ("file", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64())]))

    wrote = materialise(rows.mapInArrow(run, "part bigint, file string, documents bigint, tokens bigint"), "manifest")
    # one row per partition, never per document
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = [F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"base_{c[:-1]}") for c in ("documents", "tokens")]
    return wrote.select("part", "file", "documents", "tokens", *bases)


def open_tokens(fs: pafs.FileSystem, folder: str, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, offsets, document ids, null flags) of one file pair; memory-mapped where the file system is local."""

    def raw(path: str) -> np.ndarray:
        if isinstance(fs, pafs.LocalFileSystem):
            return np.memmap(path, np.uint8, "r")
        with fs.open_input_file(path) as f:
            return np.frombuffer(f.read(), np.uint8)

    idx = raw(f"{folder}/{name}.idx")
    if idx[:8].tobytes() != MAGIC:
        raise ValueError(f"{name}.idx is no index of token files")
    width, n, m = (int(x) for x in idx[8:32].view("<u8"))
    offsets = idx[32 : 40 + 8 * n].view("<u8")
    keys = idx[40 + 8 * n : 40 + 16 * n].view("<i8")
    data = raw(f"{folder}/{name}.bin").view(f"<u{width}")
    if len(data) != m:
        raise ValueError(f"{name}.bin is cut short")
    return data, offsets, keys, idx[40 + 16 * n : 40 + 17 * n]


def read_token_files(manifest: DataFrame, out: str) -> DataFrame:
    """Per document, from the files: doc_id, start (global), n_tokens, ids_crc32 (of uint32 little-endian ids).

    One task reads the files of few manifest rows; a document's ids are never more than one slice of the map.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = open_fs(out)
        for b in batches:
            for row in b.to_pylist():
                data, offs, keys, nulls = open_tokens(fs, folder, row["file"])
                for i in range(0, len(keys), 10_000):
                    o = offs[i : i + 10_001].astype(np.int64)
                    crc = [zlib.crc32(data[a:z].astype("<u4").tobytes()) for a, z in zip(o[:-1].tolist(), o[1:].tolist(), strict=True)]
                    k = pa.array(keys[i : i + 10_000], mask=nulls[i : i + 10_000].astype(bool))
                    yield pa.RecordBatch.from_arrays([k, pa.array(row["base_token"] + o[:-1]), pa.array(np.diff(o)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("file", "base_token").repartition(n, "file").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_digests(docs: DataFrame, id_col: str, text_col: str, end_id: int, tokenizer_path: str | None = None) -> DataFrame:
    """Write ``docs`` to token files in the shared folder and return what reading them back gives."""
    out = shared_dir(docs.sparkSession, "tokens")
    manifest = materialise(write_token_files(docs, id_col, text_col, out, end_id, tokenizer_path), "bases")
    return read_token_files(manifest, out)
