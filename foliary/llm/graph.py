"""Connected components as Spark joins: large-star and small-star rounds to a fixed point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, materialise


def _star(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with, for each u, ``m``: the smallest of u and its neighbours. Hot u are salted."""
    return attach(edges, ["u"], [("m", F.min("v"))], [F.min("m")], F.hash("v")).withColumn("m", F.least("u", "m"))


def _pair(a: Column, b: Column) -> Column:
    return F.struct(a.alias("u"), b.alias("v"))


def _settled(edges: DataFrame) -> bool:
    """Every u hangs on one v, and no v hangs on anything: stars around their smallest nodes, as u > v."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up")), F.struct(F.col("v").alias("x"), F.lit(None).cast("int").alias("up")))).alias("e")).select("e.*")
    twice = ends.groupBy("x").agg(F.count("up").alias("ups"), F.count("*").alias("all")).where("ups > 1 or (ups = 1 and all > 1)")
    return twice.isEmpty()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has an edge; root is the smallest node of its component.

    ``edges`` has columns a and b of one orderable type; loops, repeats, nulls and either direction are fine.
    Each round is written to the shared folder, which cuts the lineage. Edges shrink to stars; no node's
    neighbours are ever gathered, only minima, which combine before the shuffle.
    """
    flat = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    cur = materialise(flat, "edges")
    for _ in range(rounds):
        if _settled(cur):
            break
        both = cur.select(F.explode(F.array(_pair(F.col("u"), F.col("v")), _pair(F.col("v"), F.col("u")))).alias("e")).select("e.*")
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        # small star: the neighbours below u, and u itself, hang on the smallest of them
        small = _star(down).select(F.explode(F.array(_pair(F.col("v"), F.col("m")), _pair(F.col("u"), F.col("m")))).alias("e")).select("e.*").where("u <> v").distinct()
        cur = materialise(small, "edges")
    else:
        raise RuntimeError("components did not settle")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
