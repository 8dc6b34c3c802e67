"""Time slices per flight."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.timeunits import micros, us
from .keys import TIME, ordered


def _literal(t):
    return F.lit(t).cast("timestamp_ntz") if t is not None else None


def between(df: DataFrame, start, stop, strict: bool = True) -> DataFrame:
    """Rows in (start, stop), or [start, stop] if not strict; None leaves an end open."""
    t = F.col(TIME)
    if start is not None:
        df = df.filter(t > _literal(start) if strict else t >= _literal(start))
    if stop is not None:
        df = df.filter(t < _literal(stop) if strict else t <= _literal(stop))
    return df


def _edges(df: DataFrame, by: list[str]):
    w = W.partitionBy(*by)
    return F.min(TIME).over(w), F.max(TIME).over(w)


def _keep(df: DataFrame, condition) -> DataFrame:
    return df.withColumn("_keep", condition).filter("_keep").drop("_keep")


def before(df: DataFrame, time, by: list[str], strict: bool = True) -> DataFrame:
    """Rows before a time; strict leaves out the flight's first row as well."""
    first, _ = _edges(df, by)
    return between(_keep(df, F.col(TIME) > first) if strict else df, None, time, strict)


def after(df: DataFrame, time, by: list[str], strict: bool = True) -> DataFrame:
    """Rows after a time; strict leaves out the flight's last row as well."""
    _, last = _edges(df, by)
    return between(_keep(df, F.col(TIME) < last) if strict else df, time, None, strict)


def first(df: DataFrame, span, by: list[str]) -> DataFrame:
    return _keep(df, us(TIME) < us(_edges(df, by)[0]) + micros(span))


def skip(df: DataFrame, span, by: list[str]) -> DataFrame:
    return _keep(df, us(TIME) >= us(_edges(df, by)[0]) + micros(span))


def last(df: DataFrame, span, by: list[str]) -> DataFrame:
    return _keep(df, us(TIME) > us(_edges(df, by)[1]) - micros(span))


def shorten(df: DataFrame, span, by: list[str]) -> DataFrame:
    return _keep(df, us(TIME) <= us(_edges(df, by)[1]) - micros(span))


def at(df: DataFrame, by: list[str], time=None) -> DataFrame:
    """The rows at a time, or each flight's last row with earlier values filled forward."""
    if time is not None:
        return df.filter(F.col(TIME) == _literal(time))
    w = ordered(df, by).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    filled = [F.last_value(c, True).over(w).alias(c) if c not in by else F.col(c) for c in df.columns]
    return df.select(*filled, F.row_number().over(ordered(df, by)).alias("_n")).filter("_n = 1").drop("_n")


def at_ratio(df: DataFrame, by: list[str], ratio: float = 0.5) -> DataFrame:
    """The last row within the first ``ratio`` of each flight's duration."""
    if not 0 <= ratio <= 1:
        raise ValueError("ratio must be within 0 and 1")
    lo, hi = _edges(df, by)
    inside = _keep(df, us(TIME) <= us(lo) + (us(hi) - us(lo)) * F.lit(float(ratio)))
    w = W.partitionBy(*by).orderBy(F.col(TIME).desc(), *[F.col(c).desc() for c in ("event_id",) if c in df.columns])
    return inside.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def having(df: DataFrame, by: list[str], test) -> DataFrame:
    """Flights whose aggregate ``test`` is true; null counts as false."""
    return df.join(df.groupBy(*by).agg(F.coalesce(test, F.lit(False)).alias("_ok")).filter("_ok").drop("_ok"), by, "left_semi")


def _lasting(df: DataFrame, by: list[str], test) -> DataFrame:
    """Flights by their duration: one window over the flight, no join."""
    lo, hi = _edges(df, by)
    return _keep(df, test(us(hi) - us(lo)))


def longer_than(df: DataFrame, span, by: list[str], strict: bool = True) -> DataFrame:
    return _lasting(df, by, lambda d: d > micros(span) if strict else d >= micros(span))


def shorter_than(df: DataFrame, span, by: list[str], strict: bool = True) -> DataFrame:
    return _lasting(df, by, lambda d: d < micros(span) if strict else d <= micros(span))


def feature_gt(df: DataFrame, agg, value, by: list[str], strict: bool = True) -> DataFrame:
    return having(df, by, agg > value if strict else agg >= value)


def feature_lt(df: DataFrame, agg, value, by: list[str], strict: bool = True) -> DataFrame:
    return having(df, by, agg < value if strict else agg <= value)


def airborne(df: DataFrame) -> DataFrame:
    c = F.col("altitude").isNotNull()
    return df.filter(c & ~F.coalesce("onground", F.lit(False)) if "onground" in df.columns else c)


def onground(df: DataFrame) -> DataFrame:
    c = F.col("altitude").isNull()
    return df.filter(c | F.coalesce("onground", F.lit(False)) if "onground" in df.columns else c)


def inside_bbox(df: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    return df.filter(F.col("longitude").between(west, east) & F.col("latitude").between(south, north))


def clean_invalid(df: DataFrame, by: list[str], count: str, threshold: int = 10) -> DataFrame:
    """Flights with more than ``threshold`` distinct non-null values of a column."""
    return having(df, by, F.count_distinct(count) > threshold)


def emergency(df: DataFrame) -> DataFrame:
    return df.filter(F.col("squawk") == "7700")
