"""Interval algebra on rows (key, start, stop)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.timeunits import us


def consolidate(iv: DataFrame, by: list[str]) -> DataFrame:
    """Merges intervals that overlap or touch."""
    order = W.partitionBy(*by).orderBy("start", "stop")
    before = F.max("stop").over(order.rowsBetween(W.unboundedPreceding, -1))
    opens = F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0)
    grouped = iv.withColumn("_open", opens).withColumn("_grp", F.sum("_open").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return grouped.groupBy(*by, "_grp").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_grp")


def union(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    return consolidate(a.select(*by, "start", "stop").unionByName(b.select(*by, "start", "stop")), by)


def _sweep(sides: list[DataFrame], by: list[str]) -> DataFrame:
    """Stretches between neighbouring ends, with how many intervals of each side cover them.

    One sort per key; no pairs of intervals are formed.
    """
    names = [f"d{i}" for i in range(len(sides))]

    def ends(df, i):
        one = lambda c, v: df.select(*by, F.col(c).alias("t"), *[F.lit(v if j == i else 0).alias(n) for j, n in enumerate(names)])
        return one("start", 1).unionByName(one("stop", -1))

    each = reduce(DataFrame.unionByName, [ends(consolidate(d, by), i) for i, d in enumerate(sides)])
    sums = each.groupBy(*by, "t").agg(*[F.sum(n).alias(n) for n in names])
    order = W.partitionBy(*by).orderBy("t")
    run = order.rowsBetween(W.unboundedPreceding, 0)
    return sums.select(*by, F.col("t").alias("start"), F.lead("t").over(order).alias("stop"), *[F.sum(n).over(run).alias(f"n{i}") for i, n in enumerate(names)])


def intersection(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Time covered by both; pieces of no length vanish."""
    return consolidate(_sweep([a, b], by).filter("n0 > 0 and n1 > 0").select(*by, "start", "stop"), by)


def difference(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Time covered by the first only."""
    return consolidate(_sweep([a, b], by).filter("n0 > 0 and n1 = 0").select(*by, "start", "stop"), by)


def total_duration(iv: DataFrame, by: list[str]) -> DataFrame:
    """Microseconds covered per key."""
    return consolidate(iv, by).groupBy(*by).agg(F.sum(us("stop") - us("start")).cast("long").alias("duration_us"))
