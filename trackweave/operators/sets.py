"""Set operations on collections of flights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def intersect(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    return a.join(b.select(*by), by, "left_semi")


def minus(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    return a.join(b.select(*by), by, "left_anti")


def minus_ids(a: DataFrame, key: str, ids: list) -> DataFrame:
    return a.filter(~F.col(key).isin(ids))


def symmetric(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    return union(minus(a, b, by), minus(b, a, by))


def sample(df: DataFrame, by: list[str], size: int, seed: int = 0) -> DataFrame:
    """Flights of ``size`` keys, the smallest by a seeded hash; reruns agree."""
    ids = df.select(*by).distinct().orderBy(F.xxhash64(F.lit(seed), *by), *by).limit(size)
    return df.join(ids, by, "left_semi")


def drop_duplicates(df: DataFrame, subset: list[str], order: list[str]) -> DataFrame:
    """The first row by ``order`` of each group alike in ``subset``."""
    rest = [c for c in df.columns if c not in subset]
    return df.groupBy(*subset).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*subset, "_r.*").select(*df.columns)
