"""Snapshots of tables with a manifest of what every file holds, checked in full before anything is taken over.

A snapshot is a folder: ``data/NAME`` with Parquet tables, ``manifest`` with rows and a digest of each file, and ``about`` with format and fingerprints. The digest of a
file is taken from its rows, not its bytes, and does not depend on their order. The manifest is written last: a folder without one is no snapshot.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT = 1
_SEEDS = (3, 5)


class SnapshotMismatch(ValueError):
    """A snapshot is not what its manifest says, or does not fit here."""


def file_digests(spark: SparkSession, path: str, name: str) -> DataFrame:
    """table, file, n, digest of the files of one table: per file partial sums and XORs of row hashes."""
    rows = spark.read.parquet(path)
    row = F.to_json(F.struct(*[F.col(c) for c in sorted(rows.columns)]), {"ignoreNullFields": "false"})
    hashes = [F.xxhash64(F.lit(s), row) for s in _SEEDS]
    named = rows.select(F.col("_metadata.file_name").alias("file"), *[h.alias(f"h{i}") for i, h in enumerate(hashes)])
    parts = [F.count("*").alias("n"), F.sum(F.col("h0").cast("decimal(38,0)")).alias("s"), F.bit_xor("h1").alias("x")]
    return named.groupBy("file").agg(*parts).select(F.lit(name).alias("table"), "file", "n", F.concat_ws(":", "s", F.hex("x")).alias("digest"))


def _digests(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    out = None
    for name in names:
        one = file_digests(spark, f"{path}/data/{name}", name)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "table string, file string, n bigint, digest string")


def differences(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of either that the other lacks: the keys, ``left`` and ``right``, how often each side has them. None if both are equal as bags of rows; nulls are equal."""
    tagged = a.select(*keys, F.lit(1).alias("__l"), F.lit(0).alias("__r")).unionByName(b.select(*keys, F.lit(0).alias("__l"), F.lit(1).alias("__r")))
    return tagged.groupBy(*keys).agg(F.sum("__l").alias("left"), F.sum("__r").alias("right")).where(F.col("left") != F.col("right"))


def export(spark: SparkSession, path: str, tables: Mapping[str, DataFrame], fingerprints: Mapping[str, str]) -> DataFrame:
    """Write a snapshot to a new folder; returns its manifest. ``fingerprints`` name what tables were made with, such as chunker or vector space."""
    for name, df in tables.items():
        df.write.parquet(f"{path}/data/{name}")
    about = [("format", str(FORMAT)), ("tables", "\n".join(sorted(tables))), *((f"fingerprint:{k}", v) for k, v in fingerprints.items())]
    spark.createDataFrame(about, "key string, value string").coalesce(1).write.parquet(f"{path}/about")
    _digests(spark, path, sorted(tables)).coalesce(1).write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def check(spark: SparkSession, path: str, fingerprints: Mapping[str, str]) -> tuple[list[str], list[str]]:
    """(tables, fingerprints that differ) of a snapshot, all of whose files hold what the manifest says, and no others do. Raises if not."""
    about = {r["key"]: r["value"] for r in spark.read.parquet(f"{path}/about").collect()}  # a few rows
    if about.get("format") != str(FORMAT):
        raise SnapshotMismatch(f"format {about.get('format')!r} is not {FORMAT}")
    names = about["tables"].split("\n") if about.get("tables") else []
    wrong = differences(spark.read.parquet(f"{path}/manifest"), _digests(spark, path, names), ["table", "file", "n", "digest"]).take(5)
    if wrong:
        raise SnapshotMismatch("files differ from the manifest: " + ", ".join(sorted({f"{r['table']}/{r['file']}" for r in wrong})))
    return names, sorted(k for k, v in fingerprints.items() if about.get(f"fingerprint:{k}") != v)


def take_over(spark: SparkSession, path: str, target: str, fingerprints: Mapping[str, str], needs: Mapping[str, Sequence[str]], force: bool = False, replace: bool = False) -> list[str]:
    """Check a snapshot, then copy its tables below ``target``; returns those taken. ``needs``: the fingerprints that a table depends on.

    A table whose fingerprints differ is refused, and with ``force`` left out, to be made again here. Tables that exist are replaced only with ``replace``.
    """
    names, differ = check(spark, path, fingerprints)
    stale = [n for n in names if set(needs.get(n, ())) & set(differ)]
    if stale and not force:
        raise SnapshotMismatch(f"{stale} were made with another {differ}")
    taken = [n for n in names if n not in stale]
    for name in taken:
        spark.read.parquet(f"{path}/data/{name}").write.mode("overwrite" if replace else "errorifexists").parquet(f"{target}/{name}")
    return taken
