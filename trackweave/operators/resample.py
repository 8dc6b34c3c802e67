"""Resampling to regular times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.timeunits import floor, from_us, micros, us
from .keys import TIME


def resample(df: DataFrame, by: list[str], rule, interpolate: tuple[str, ...] = (), ffill: tuple[str, ...] = ()) -> DataFrame:
    """One row per ``rule``: the first known value of each bin, then lines or steps between bins.

    Lines have no part before the first known value and hold the last one.
    """
    f = micros(rule)
    cols = [*interpolate, *ffill]
    tie = F.struct(TIME, *(["event_id"] if "event_id" in df.columns else []))
    bins = df.withColumn("_bin", floor(TIME, rule)).groupBy(*by, "_bin").agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), tie)).alias(c) for c in cols])
    w = W.partitionBy(*by).orderBy("_bin")
    upto, after = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(1, W.unboundedFollowing)
    known = {"_next": F.lead("_bin").over(w)}
    for c in cols:
        at = F.when(F.col(c).isNotNull(), us("_bin"))
        known |= {f"_{c}_v0": F.last_value(c, True).over(upto), f"_{c}_t0": F.last_value(at, True).over(upto)}
        if c in interpolate:
            known |= {f"_{c}_v1": F.first_value(c, True).over(after), f"_{c}_t1": F.first_value(at, True).over(after)}
    # The rows up to the next bin are made from what both bins know: no grid to join with.
    rows = bins.withColumns(known).withColumn("_t", F.explode(F.sequence(us("_bin"), F.coalesce(us("_next") - f, us("_bin")), F.lit(f))))

    def value(c: str):
        v0, t0 = F.col(f"_{c}_v0"), F.col(f"_{c}_t0")
        if c not in interpolate:
            return v0.alias(c)
        v1, t1 = F.col(f"_{c}_v1"), F.col(f"_{c}_t1")
        between = v0 + (v1 - v0) * ((F.col("_t") - t0) / (t1 - t0))
        return F.when(v0.isNull() | v1.isNull() | (F.col("_t") == t0), v0).otherwise(between).cast("double").alias(c)

    return rows.select(*by, from_us("_t").alias(TIME), *[value(c) for c in cols])


def resample_points(df: DataFrame, by: list[str], n: int, *cols: str) -> DataFrame:
    """n rows evenly spaced in time, each with the values of the nearest sample (earlier on ties).

    The grid is merged with the samples by one sort per flight.
    """
    ends = df.groupBy(*by).agg(us(F.min(TIME)).alias("_a"), us(F.max(TIME)).alias("_z"))
    step = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.col("_a") + F.floor((F.col("_z") - F.col("_a")) * i / max(1, n - 1)))).alias("i", "_t")
    grid = ends.select(*by, step)
    tie = [F.col("event_id")] if "event_id" in df.columns else []
    s = F.struct(us(TIME).alias("t"), *cols)
    both = df.select(*by, us(TIME).alias("_t"), *tie, F.lit(None).cast("int").alias("i"), s.alias("_s")).unionByName(grid, allowMissingColumns=True)
    w = W.partitionBy(*by).orderBy("_t", F.col("i").asc_nulls_first(), *tie)
    lo = F.last_value("_s", True).over(w.rowsBetween(W.unboundedPreceding, 0))
    hi = F.first_value("_s", True).over(w.rowsBetween(0, W.unboundedFollowing))
    near = both.withColumns({"_lo": lo, "_hi": hi}).filter("i is not null")
    best = F.when(F.col("_hi").isNull() | (F.col("_t") - F.col("_lo.t") <= F.col("_hi.t") - F.col("_t")), F.col("_lo")).otherwise(F.col("_hi"))
    return near.withColumn("_b", best).select(*by, F.col("i").cast("long").alias("i"), from_us("_t").alias(TIME), *[F.col(f"_b.{c}").alias(c) for c in cols])


def resample_projected(df: DataFrame, by: list[str], rule, lat0: float, lon0: float, parallels: tuple[float, float], interpolate: tuple[str, ...] = (), ffill: tuple[str, ...] = ()) -> DataFrame:
    """resample() with positions interpolated on a conic map about (lat0, lon0), so long gaps follow the map's straight lines."""
    x, y = geo.lcc("latitude", "longitude", lat0, lon0, *parallels)
    flat = resample(df.withColumns({"_mx": x, "_my": y}), by, rule, ("_mx", "_my", *interpolate), ffill)
    lat, lon = geo.lcc_inverse("_mx", "_my", lat0, lon0, *parallels)
    return flat.withColumns({"latitude": lat, "longitude": lon}).drop("_mx", "_my")


def resample_sparse(df: DataFrame, by: list[str], rule, longest, **how: str) -> DataFrame:
    """resample() column by column (how: "interpolate" or "ffill"), but a value is made only within ``longest`` of a known one before it."""
    lines = tuple(c for c, h in how.items() if h == "interpolate")
    steps = tuple(c for c, h in how.items() if h == "ffill")
    stamps = {f"_at_{c}": F.when(F.col(c).isNotNull(), us(TIME)) for c in how}
    out = resample(df.withColumns(stamps), by, rule, lines, (*steps, *stamps))
    fresh = lambda c: us(TIME) - F.col(f"_at_{c}") <= micros(longest)
    return out.withColumns({c: F.when(fresh(c), F.col(c)) for c in how}).drop(*stamps)
