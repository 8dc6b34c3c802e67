"""Aggregations per flight, time bucket and grid cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timeunits import nearest, us
from .keys import TIME

_AGGS = {
    "min": F.min, "max": F.max, "mean": F.avg, "sum": F.sum, "count": F.count, "median": F.median,
    "std": F.stddev_samp, "var": F.var_samp, "nunique": F.count_distinct, "first": F.first, "last": F.last,
}


def feature(name: str) -> Column:
    """``altitude_max`` and the like as an aggregate; unknown names raise AttributeError."""
    col, _, agg = name.rpartition("_")
    if not col or agg not in _AGGS:
        raise AttributeError(name)
    return _AGGS[agg](col).alias(name)


def summary(df: DataFrame, by: list[str], *attributes: str) -> DataFrame:
    """One row per flight: start, stop, duration_us, count, unique values or <feature>_<agg>."""
    known = {"start": F.min(TIME), "stop": F.max(TIME), "duration_us": us(F.max(TIME)) - us(F.min(TIME)), "count": F.count(F.lit(1))}

    def one(a: str) -> Column:
        if a in known:
            return known[a].alias(a)
        if a in df.columns:
            return F.array_sort(F.collect_set(a)).alias(a)
        return feature(a)

    return df.groupBy(*by).agg(*[one(a) for a in attributes])


def unique(c: str) -> Column:
    """The value if a group has one, else null."""
    return F.when(F.count_distinct(c) == 1, F.max(c))


def basic_stats(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), *by)


def agg_time(df: DataFrame, by: list[str], freq="1 min", merge: bool = True, **features) -> DataFrame:
    """Aggregates per nearest time bucket as <col>_<agg>; ``merge`` puts them back on every row.

    The rows are joined with the buckets on the key that both are partitioned
    by, which also serves counts of distinct values.
    """
    df = df.withColumn("rounded", nearest(TIME, freq))
    aggs = [_AGGS[a](c).alias(f"{c}_{a}") for c, names in features.items() for a in ([names] if isinstance(names, str) else names)]
    out = df.groupBy(*by, "rounded").agg(*aggs)
    return df.join(out, [*by, "rounded"]) if merge else out


def agg_xy(df: DataFrame, resolution: float | tuple[float, float], x="x", y="y", **features) -> DataFrame:
    """Aggregates per cell floor(x / r) * r."""
    rx, ry = resolution if isinstance(resolution, tuple) else (resolution, resolution)
    cell = df.withColumns({x: F.floor(F.col(x) / rx) * rx, y: F.floor(F.col(y) / ry) * ry})
    return cell.groupBy(x, y).agg(*[_AGGS[a](c).alias(f"{c}_{a}") for c, names in features.items() for a in ([names] if isinstance(names, str) else names)])


def agg_latlon(df: DataFrame, per_degree: dict[str, int], **features) -> DataFrame:
    """Aggregates per cell rint(r * degrees) / r."""
    cell = df.withColumns({c: F.rint(F.col(c) * r) / r for c, r in per_degree.items()})
    return cell.groupBy(*per_degree).agg(*[_AGGS[a](c).alias(f"{c}_{a}") for c, names in features.items() for a in ([names] if isinstance(names, str) else names)])


def windfield(df: DataFrame, per_degree: dict[str, int]) -> DataFrame:
    return agg_latlon(df, per_degree, wind_u="mean", wind_v="mean", timestamp="count")
