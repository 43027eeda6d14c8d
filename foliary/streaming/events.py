"""Change streams over the events table: windows with watermarks, and incremental upkeep of derived tables.

Every function takes a batch or a streaming DataFrame, so a query can be checked in batch and run as a stream.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def timed(events: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """ts as a timestamp with a watermark (the table has it without a time zone; it is taken as UTC)."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)


def tumbling(events: DataFrame, size: str = "1 hour") -> DataFrame:
    """Counts and sums per window and type."""
    w = timed(events).groupBy(F.window("ts", size).alias("w"), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum(F.round("value", 2).cast("decimal(20,2)")).alias("total")).select(F.unix_seconds("w.start").alias("start_s"), "event_type", "n", F.col("total").cast("double").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of a user: events closer than ``gap``."""
    return timed(events).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.unix_micros("w.start").alias("start_us"), "n")


def first_of_each(events: DataFrame, keys: list[str]) -> DataFrame:
    """Idempotent intake: a key counts once within the lateness. In batch, once at all."""
    e = timed(events)
    return e.dropDuplicatesWithinWatermark(keys) if e.isStreaming else e.dropDuplicates(keys)


def _newest(every: DataFrame) -> DataFrame:
    """Rows of the newest version of each bucket; the table of versions has a row for each bucket."""
    top = every.groupBy("__bucket").agg(F.max("__version").alias("__top"))
    return every.join(F.broadcast(top), "__bucket").where("__version = __top").drop("__top")


def current(spark: SparkSession, path: str, deleted: str = "deleted") -> DataFrame:
    """The rows of an upserted table that are not deleted."""
    return _newest(spark.read.parquet(path)).where(~F.coalesce(F.col(deleted), F.lit(False))).drop("__version", "__bucket")


def _drop_folders(spark: SparkSession, folders: list[str]) -> None:
    """Delete folders through the file system that Spark itself uses for them."""
    for folder in folders:
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def upsert(changes: DataFrame, path: str, key: str, order: str, checkpoint: str, deleted: str = "deleted", buckets: int = 64) -> Callable[[], object]:
    """A stream that keeps the newest change of each key, by ``order``, in Parquet folders ``path``/__version=N/__bucket=B.

    A batch is folded to its newest change per key and merged with the newest version of the buckets of its keys, which are written anew;
    other buckets stay as they are. The newest change wins whichever batch brings it; of equal orders the one that came first stays. A delete is
    kept with its order, so that a late change does not revive the row; ``current`` leaves such rows out. A repeated batch rewrites its own folder.
    Rows without an order are left out. A bucket keeps its newest version and the one before, so neither the table nor a batch grows with the number
    of batches. Every batch but the first needs the table that those before it wrote, and fails without it. Returns a function that starts the query.
    """

    def apply(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        new = batch.where(F.col(order).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
        rows = new.withColumn("__bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        old_folders: list[str] = []
        if n:
            schema = StructType([*batch.schema.fields, StructField("__version", IntegerType()), StructField("__bucket", IntegerType())])
            every = spark.read.schema(schema).parquet(path).where(F.col("__version") < n)  # with a schema, a table without rows is one
            touched = {r["__bucket"] for r in rows.select("__bucket").distinct().collect()}  # at most ``buckets``, as are the versions' buckets
            known = [(r["__bucket"], r["__version"]) for r in every.where(F.col("__bucket").isin(touched)).select("__bucket", "__version").distinct().collect()]
            top = {b: max(v for c, v in known if c == b) for b, _ in known}
            old_folders = [f"{path}/__version={v}/__bucket={b}" for b, v in known if v < top[b]]
            newest = F.lit(False)
            for b, v in top.items():
                newest |= (F.col("__bucket") == b) & (F.col("__version") == v)
            both = rows.withColumn("__age", F.lit(0)).unionByName(every.where(newest).select(*batch.columns, "__bucket", F.lit(1).alias("__age")))
            rows = both.groupBy("__bucket", key).agg(F.max_by(F.struct(*batch.columns), F.struct(order, "__age")).alias("r")).select("__bucket", "r.*")
        rows.write.mode("overwrite").partitionBy("__bucket").parquet(f"{path}/__version={n}")
        _drop_folders(spark, old_folders)  # superseded by the version before this one

    return lambda: changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
