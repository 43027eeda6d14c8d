"""Readers: Parquet tables, text folders, and the chunk view of a documents table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.functions.text import chunk_id, content_hash


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a folder of Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_folder(spark: SparkSession, path: str) -> DataFrame:
    """source, mtime, content of the .md, .markdown and .txt files below ``path``; ``valid`` is false where bytes are no UTF-8.

    Temporary names (``~`` first, .tmp, .swp, .swo) are left out; a byte-order mark is dropped.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    rows = raw.where(name.rlike(r"(?i)\.(md|markdown|txt)$") & ~name.rlike(r"(?i)^~|\.(tmp|swp|swo)(\.|$)"))
    text = F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "")
    return rows.select(F.col("path").alias("source"), F.col("modificationTime").cast("double").alias("mtime"), F.when(F.is_valid_utf8(F.col("content").cast("string")), text).alias("content"), F.is_valid_utf8(F.col("content").cast("string")).alias("valid"))


def plain_chunks(docs: DataFrame) -> DataFrame:
    """vault, source, chunk_index, content, doc_id, lang of a documents table. A document is one chunk."""
    path = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))
    return docs.select(F.col("source").alias("vault"), path.alias("source"), F.lit(0).alias("chunk_index"), F.coalesce("text", F.lit("")).alias("content"), "doc_id", "lang")


def identified(chunks: DataFrame) -> DataFrame:
    """``chunks`` with chunk_id and content_hash. Both hash the whole content, so do this to the few rows that need them."""
    return chunks.withColumn("chunk_id", chunk_id("source", "chunk_index", "content")).withColumn("content_hash", content_hash("content"))


def document_chunks(docs: DataFrame) -> DataFrame:
    """``plain_chunks`` with chunk_id and content_hash."""
    return identified(plain_chunks(docs))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, or below the warehouse where the session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
    return f"{base.rstrip('/')}/foliary/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so that it is worked out once and its lineage ends."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def overwrite_partitions(rows: DataFrame, path: str, parts: list[str], order: list[str]) -> None:
    """Replace those partitions of the table at ``path`` that ``rows`` has rows of. One task writes a partition; its rows are sorted by ``order``.

    Spark moves the partitions into place when all tasks are done, so the old ones may be read by the same job. One writer at a time.
    """
    ready = rows.repartition(*parts).sortWithinPartitions(*parts, *order)
    ready.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)
