"""Paired comparison of rankings, and percentiles, as aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bootstrap_interval(deltas: DataFrame, query: str = "query", delta: str = "delta", rounds: int = 500, seed: int = 17, low: int = 12, high: int = 487) -> DataFrame:
    """n, mean, low, high: the mean of paired differences, and the ``low``-th and ``high``-th (from 0) of the means of ``rounds`` samples with replacement.

    Draw j of round b takes the query of rank md5("seed:b * n + j") mod n, queries in their order, so that every engine and run draws alike. Draws are rows that meet
    the differences by rank, and each round is a partial aggregate. The queries of an evaluation are numbered in one task. Means are of differences to 12
    digits, added exactly. Rows without a query or difference are left out; without any there is no row.
    """
    rows = deltas.where(F.col(query).isNotNull() & F.col(delta).isNotNull())
    ranked = rows.select((F.row_number().over(Window.orderBy(query, delta)) - 1).alias("i"), F.round(delta, 12).cast("decimal(30,12)").alias("d"))
    n = ranked.count()
    if not n:
        return deltas.sparkSession.createDataFrame([], "n bigint, mean double, low double, high double")
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") % n
    draws = deltas.sparkSession.range(rounds * n).select(F.floor(F.col("id") / n).alias("b"), draw.alias("i"))
    means = draws.join(F.broadcast(ranked), "i").groupBy("b").agg((F.sum("d").cast("double") / n).alias("m"))  # an evaluation's queries are few
    line = F.row_number().over(Window.orderBy("m", "b")) - 1
    ends = means.select("m", line.alias("at")).agg(F.max(F.when(F.col("at") == low, F.col("m"))).alias("low"), F.max(F.when(F.col("at") == high, F.col("m"))).alias("high"))
    return ranked.agg(F.count("*").alias("n"), (F.sum("d").cast("double") / n).alias("mean")).crossJoin(ends)  # a row each


def percentiles(rows: DataFrame, by: Sequence[str], value: str, fractions: Sequence[float]) -> DataFrame:
    """by, fraction, value: of n values of a group in order that of place floor((n - 1) * fraction), from 0. Null values are left out.

    Equal values are counted before they meet, so a group's task sees each value once.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__c"))
    line = Window.partitionBy(*by).orderBy(value)
    upto = counts.withColumns({"__to": F.sum("__c").over(line), "__n": F.sum("__c").over(Window.partitionBy(*by))})
    wanted = F.explode(F.array(*[F.lit(float(f)) for f in fractions])).alias("fraction")
    placed = upto.select(*by, value, "__to", "__c", "__n", wanted).withColumn("__at", F.floor((F.col("__n") - 1) * F.col("fraction")))
    return placed.where((F.col("__at") < F.col("__to")) & (F.col("__at") >= F.col("__to") - F.col("__c"))).select(*by, "fraction", value)
