"""Listing a folder tree level by level: ignored folders are left out before anything below them is listed, and what could not be read is told."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.functions.ignore import is_ignored
from foliary.sources.tables import stored

_ROW = "path string, is_dir boolean, size bigint, mtime double, error string"
TEXT = ("md", "markdown", "txt")


@dataclass(frozen=True)
class Listing:
    """``files``: path (from the root), size, mtime, ignored. ``pruned`` and ``unreadable`` have the folders that were not listed. ``complete``: the root and all
    that was to be listed could be read, so that a file that is missing is gone.
    """

    files: DataFrame
    pruned: DataFrame
    unreadable: DataFrame
    complete: bool


def _listed(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    fs, base = pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", root)) if ":/" in root else (pafs.LocalFileSystem(), root)
    names = [c.split()[0] for c in _ROW.split(", ")]
    for b in batches:
        for folder in b.column("path").to_pylist():
            place = f"{base.rstrip('/')}/{folder}".rstrip("/")
            try:
                rows = [(x.path[len(base.rstrip("/")) + 1 :], x.type == pafs.FileType.Directory, x.size, x.mtime.timestamp() if x.mtime else None, None) for x in fs.get_file_info(pafs.FileSelector(place))]
            except (OSError, pa.ArrowException) as e:
                rows = [(folder, True, None, None, str(e)[:200])]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.bool_(), pa.int64(), pa.float64(), pa.string()), strict=True)], names)


def scan(spark: SparkSession, root: str, ignore: Sequence[str] = (), extensions: Sequence[str] = TEXT, with_ignored: bool = False, levels: int = 64) -> Listing:
    """The files below ``root`` with these extensions that ``ignore`` (lines of an ignore file) does not leave out, or all with the flag ``ignored``.

    Each level of folders is listed by tasks, a folder in one task. Names of temporary files (``~`` first, .tmp, .swp, .swo), and folders and files that begin
    with a dot, are left out. Links are followed, and ``levels`` keeps cycles finite: a tree that is deeper is not complete.
    """
    found: list[DataFrame] = []
    level = spark.createDataFrame([("", False)], "path string, ignored boolean")
    for _ in range(levels):
        rows = level.repartition("path").select("path", "ignored").mapInArrow(lambda b: _listed(b, root), _ROW)
        below = stored(rows.where(~F.element_at(F.split("path", "/"), -1).startswith(".") | F.col("error").isNotNull()), "level")
        above = F.when(F.col("is_dir"), is_ignored(F.col("path"), ignore, True)).otherwise(is_ignored(F.col("path"), ignore))
        below = below.withColumn("ignored", above)
        found.append(below)
        level = below.where(F.col("is_dir") & F.col("error").isNull() & (F.lit(with_ignored) | ~F.col("ignored"))).select("path", "ignored")
        if level.isEmpty():
            break
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    name = F.element_at(F.split("path", "/"), -1)
    wanted = name.rlike(r"(?i)\.(" + "|".join(map(re.escape, extensions)) + ")$") & ~name.rlike(r"(?i)^~|\.(tmp|swp|swo)(\.|$)")
    files = every.where(~F.col("is_dir") & wanted & (F.lit(with_ignored) | ~F.col("ignored"))).select("path", "size", "mtime", "ignored")
    unreadable = every.where("error is not null").select("path", "error")
    return Listing(files, every.where("is_dir and ignored and error is null").select("path"), unreadable, unreadable.isEmpty() and level.isEmpty())
